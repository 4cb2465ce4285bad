"""Splitting documents into chunks: one Arrow UDF per format, one row per chunk.

The splitters work on one text at a time, so the job is a scan with no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# fixed values: separators in the order they are tried
TEXT_SEPARATORS = ["\n\n", "\n", " ", ""]
WEB_SEPARATORS = ["\n\n", "\n", "。", ". ", " ", ""]
# fixed values: separators per programming language, published with the text splitter
_BLOCKS = ["\n\n", "\n", " ", ""]
CODE_SEPARATORS = {
    ".py": ["\nclass ", "\ndef ", "\n\tdef ", *_BLOCKS],
    ".js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ",
            "\ncase ", "\ndefault ", *_BLOCKS],
    ".ts": ["\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ",
            "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", *_BLOCKS],
    ".java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ",
              "\nswitch ", "\ncase ", *_BLOCKS],
    ".go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", *_BLOCKS],
    ".rs": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", "\nconst ", *_BLOCKS],
    ".cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ",
             "\ncase ", *_BLOCKS],
    ".cs": ["\ninterface ", "\nenum ", "\nimplements ", "\ndelegate ", "\nevent ", "\nclass ", "\nabstract ",
            "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nreturn ", "\nif ", "\ncontinue ", "\nfor ",
            "\nforeach ", "\nwhile ", "\nswitch ", "\nbreak ", "\ncase ", "\nelse ", "\ntry ", "\nthrow ",
            "\nfinally ", "\ncatch ", *_BLOCKS],
}
CODE_SEPARATORS[".c"] = CODE_SEPARATORS[".cpp"]
# fixed values: file extension to strategy; every other extension is split as plain text
STRATEGY_BY_EXTENSION = {
    "markdown": [".md", ".markdown"],
    "html": [".html", ".htm"],
    "word": [".docx", ".doc"],
    "code": [".py", ".js", ".ts", ".java", ".go", ".rs", ".cpp", ".c", ".cs"],
}

CHUNK = "array<struct<content:string,heading_path:string,kind:string>>"


def strategy_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit("recursive")
    for name, exts in STRATEGY_BY_EXTENSION.items():
        out = F.when(ext.isin(exts), F.lit(name)).otherwise(out)
    return out


def split_recursive(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters cut at the coarsest separator present.

    A separator stays at the head of the piece that follows it. Neighbouring pieces
    are joined up to ``size``; a new chunk starts with up to ``overlap`` characters
    of pieces from the end of the one before.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1:]
    if sep == "":
        pieces = list(text)
    else:
        head, *rest = text.split(sep)
        pieces = ([head] if head else []) + [sep + r for r in rest]
    chunks: list[str] = []
    window: deque[str] = deque()
    held = 0

    def close() -> None:
        joined = "".join(window).strip()
        if joined:
            chunks.append(joined)

    for piece in pieces:
        if len(piece) >= size and finer:
            if window:
                close()
                window.clear()
                held = 0
            chunks.extend(split_recursive(piece, finer, size, overlap))
            continue
        if len(piece) >= size:
            if window:
                close()
                window.clear()
                held = 0
            chunks.append(piece)
            continue
        if held + len(piece) > size and window:
            close()
            while held > overlap or (held + len(piece) > size and held > 0):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        close()
    return chunks


def _with_heading(path: str, body: str) -> str:
    return f"{path}\n{body}" if path else body


class _Sections:
    """Collects chunks of one document under the current heading path."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.out: list[tuple[str, str, str]] = []

    def add(self, body: str, path: str, kind: str) -> None:
        self.out.append((_with_heading(path, body), path, kind))

    def add_text(self, body: str, path: str) -> None:
        body = body.strip()
        if not body:
            return
        parts = [body] if len(body) <= self.size else split_recursive(body, TEXT_SEPARATORS, self.size, self.overlap)
        for part in parts:
            self.add(part, path, "text")


_HEADING = re.compile(r"^(#{1,3})\s+(.+)$")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_RULE = re.compile(r"^\s*\|[\s:|-]+\|\s*$")


def _markdown_blocks(text: str) -> Iterator[tuple[str, list[str]]]:
    """(kind, lines): heading, fence, table or text, in document order."""
    lines = text.split("\n")
    plain: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        kind, stop = "text", i + 1
        if _HEADING.match(line):
            kind = "heading"
        elif line.strip().startswith("```"):
            kind = "fence"
            while stop < len(lines) and not lines[stop].strip().startswith("```"):
                stop += 1
            stop += 1
        elif _ROW.match(line) and i + 1 < len(lines) and _RULE.match(lines[i + 1]):
            kind, stop = "table", i + 2
            while stop < len(lines) and _ROW.match(lines[stop]):
                stop += 1
        if kind == "text":
            plain.append(line)
        else:
            if plain:
                yield "text", plain
                plain = []
            yield kind, lines[i:stop]
        i = stop
    if plain:
        yield "text", plain


def split_markdown(text: str, size: int, overlap: int) -> list[tuple[str, str, str]]:
    """Heading-aware chunks: fences whole, one chunk per table row, text re-split."""
    doc = _Sections(size, overlap)
    titles = ["", "", ""]
    for kind, lines in _markdown_blocks(text):
        path = " > ".join(t for t in titles if t)
        if kind == "heading":
            marks, title = _HEADING.match(lines[0]).groups()
            level = len(marks)
            titles = [*titles[:level - 1], title.strip(), *[""] * (3 - level)]
        elif kind == "table":
            for row in lines[2:]:
                doc.add(f"{lines[0]}\n{row.strip()}", path, "table_row")
        elif kind == "fence":
            whole = "\n".join(lines)
            if len(whole) <= max(size, 2000):
                doc.add(whole, path, "code")
                continue
            closed = lines[-1].strip().startswith("```")
            segment: list[str] = []
            length = -1
            for line in [*(lines[1:-1] if closed else lines[1:]), None]:
                if line is not None:
                    segment.append(line)
                    length += len(line) + 1
                if segment and (line is None or length >= size):
                    doc.add("\n".join([lines[0], *segment, lines[-1]]), path, "code")
                    segment, length = [], -1
        else:
            doc.add_text("\n".join(lines), path)
    return doc.out


_SKIPPED_TAGS = {"script", "style", "nav", "footer", "aside", "header"}
_BLOCK_TAGS = {"p", "div", "li", "ul", "ol", "br", "tr", "td", "th", "section", "article", "main", "h4", "h5", "h6",
               "blockquote", "pre", "dl", "dt", "dd", "form"}


class _BodyText(HTMLParser):
    """Text nodes outside of page furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipping: list[str] = []
        self.nodes: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED_TAGS:
            self.skipping.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skipping:
            while self.skipping.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skipping:
            self.nodes.append(data)


def html_body(html: str) -> str:
    """One line per text node, stripped, blanks left out."""
    parser = _BodyText()
    parser.feed(html or "")
    parser.close()
    lines = (line.strip() for node in parser.nodes for line in node.splitlines())
    return "\n".join(line for line in lines if line)


class _SectionParser(HTMLParser):
    """Heading levels h1-h3, running text, and tables as rows of cells."""

    def __init__(self, doc: _Sections):
        super().__init__(convert_charrefs=True)
        self.doc = doc
        self.titles = ["", "", ""]
        self.level = 0
        self.title = ""
        self.text: list[str] = []
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.in_table = 0
        self.in_head = False
        self.skip = 0

    @property
    def path(self) -> str:
        return " > ".join(t for t in self.titles if t)

    def flush(self) -> None:
        lines = (line.strip() for line in "".join(self.text).split("\n"))
        body = "\n".join(line for line in lines if line)
        self.text = []
        flat = body.replace(" ", "")
        if flat and not (self.path and flat in self.path.replace(" ", "")):
            self.doc.add_text(body, self.path)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3") and not self.in_table:
            self.flush()
            self.level, self.title = int(tag[1]), ""
        elif tag == "table":
            self.flush()
            self.in_table += 1
            self.rows = []
        elif tag == "tr" and self.in_table:
            self.rows.append([])
        elif tag in ("td", "th") and self.in_table:
            self.cell = []
        elif tag in _BLOCK_TAGS and not self.in_table:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3") and self.level:
            keep = self.titles[:self.level - 1]
            self.titles = [*keep, " ".join(self.title.split()), *[""] * (3 - self.level)]
            self.level = 0
        elif tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None
        elif tag == "table" and self.in_table:
            self.in_table -= 1
            self.close_table()
        elif tag in _BLOCK_TAGS and not self.in_table:
            self.text.append("\n")

    def close_table(self) -> None:
        rows = [r for r in self.rows if r]
        shown = ["| " + " | ".join(r) + " |" for r in rows]
        if len(rows) == 1:
            self.doc.add(" ".join(c for c in rows[0] if c), self.path, "table_row")
        for row in shown[1:]:
            self.doc.add(f"{shown[0]}\n{row}", self.path, "table_row")
        self.rows = []

    def handle_data(self, data):
        if self.skip:
            return
        if self.level:
            self.title += data
        elif self.in_table:
            if self.cell is not None:
                self.cell.append(data)
        else:
            self.text.append(data)


def split_html(html: str, size: int, overlap: int) -> list[tuple[str, str, str]]:
    doc = _Sections(size, overlap)
    parser = _SectionParser(doc)
    parser.feed(html)
    parser.close()
    parser.flush()
    return doc.out


def split_elements(elements: list[tuple[str, str]], size: int, overlap: int) -> list[tuple[str, str, str]]:
    """Chunks of an element stream (category, text): titles stack, tables stay whole.

    A title after body text opens a section beside the current one, otherwise below it.
    """
    doc = _Sections(size, overlap)
    titles: list[str] = []
    body: list[str] = []

    def path() -> str:
        return " > ".join(titles[:3])

    def flush() -> None:
        doc.add_text("\n".join(body), path())
        body.clear()

    for category, text in elements:
        text = (text or "").strip()
        if not text or category in ("Header", "Footer"):
            continue
        if category == "Title":
            flush()
            if titles and doc.out and doc.out[-1][1] == " > ".join(titles):
                titles.pop()
            titles.append(text)
        elif category == "Table":
            flush()
            doc.add(text, path(), "table")
        else:
            body.append(text)
    flush()
    return doc.out


def _splitter(strategy: str, extension: str, size: int, overlap: int):
    if strategy == "markdown":
        return lambda t: split_markdown(t, size, overlap)
    if strategy == "html":
        return lambda t: split_html(t, size, overlap)
    seps = CODE_SEPARATORS.get(extension, TEXT_SEPARATORS) if strategy == "code" else (
        WEB_SEPARATORS if strategy == "web" else TEXT_SEPARATORS)
    return lambda t: [(c, "", "text") for c in split_recursive(t, seps, size, overlap)]


def chunk_documents(docs: DataFrame, key: str, text_col: str = "text", strategy: Column | None = None,
                    extension: Column | None = None, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk_index, total_chunks, content, heading_path, kind, chunk_strategy)."""
    strategy = F.lit("recursive") if strategy is None else strategy
    extension = F.lit("") if extension is None else extension

    @F.pandas_udf(CHUNK)
    def split(text: pd.Series, how: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([_splitter(h, e, size, overlap)(t or "") for t, h, e in zip(text, how, ext)])

    rows = docs.select(F.col(key), strategy.alias("chunk_strategy"), split(F.col(text_col), strategy, extension).alias("c"))
    return rows.select(key, "chunk_strategy", F.size("c").alias("total_chunks"), F.posexplode_outer("c").alias("chunk_index", "x")).filter(
        F.col("chunk_index").isNotNull()).select(
        key, "chunk_index", "total_chunks", "x.content", "x.heading_path", "x.kind", "chunk_strategy")


def chunk_elements(elements: DataFrame, key: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Element rows (key, pos, category, text) to chunks; one document is one group."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = split_elements(list(zip(pdf["category"], pdf["text"])), size, overlap)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "chunk_index": range(len(out)), "content": [c[0] for c in out],
                             "heading_path": [c[1] for c in out], "kind": [c[2] for c in out]})

    return elements.select(F.col(key).cast("string").alias("doc"), "pos", "category", "text").groupBy("doc").applyInPandas(
        split, "doc string, chunk_index int, content string, heading_path string, kind string").withColumnRenamed("doc", key)


def chunk_summary(chunks: DataFrame, key: str) -> DataFrame:
    """Per strategy: documents, chunks, chunks per document, size percentiles, deepest heading."""
    depth = F.when(F.col("heading_path") == "", 0).otherwise(F.size(F.split("heading_path", " > ")))
    size = F.length("content")
    return chunks.groupBy("chunk_strategy").agg(
        F.count_if(F.col("chunk_index") == 0).alias("documents"), F.count(F.lit(1)).alias("chunks"),
        F.round(F.count(F.lit(1)) / F.count_if(F.col("chunk_index") == 0), 4).alias("chunks_per_document"),
        F.percentile_approx(size, 0.5).alias("size_p50"), F.percentile_approx(size, 0.95).alias("size_p95"),
        F.max(size).alias("size_max"), F.max(depth).alias("heading_depth"))


def line_chunks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Non-blank lines of a text as chunks, numbered by their place among them."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select(F.col(key).alias("document_id"), F.posexplode_outer(lines).alias("chunk_index", "content")).filter(
        F.col("content").isNotNull()).withColumn(
        "chunk_index", F.col("chunk_index").cast("long"))
