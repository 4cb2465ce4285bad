"""File scans: texts, CSV and JSON as texts, folders with a record of what failed, data sets."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docweave.operators.chunking import html_body

# fixed values: extensions a folder scan keeps
EXTENSIONS = [".txt", ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".md", ".markdown", ".csv", ".json", ".html", ".htm", ".epub"]

Parser = Callable[[bytes], list[str]]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one row per file, UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def read_csv_texts(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """(source, row, text): every non-empty row as ``column: value`` lines.

    Rows are paired with the header up to the shorter of both; ``row`` counts from 1 within
    a file. Files are parsed whole because a quoted value may hold line breaks.
    """
    return _parse(spark.read.format("binaryFile").load(path).select("path", "content"), {"": _csv_rows(header)}).select(
        F.col("path").alias("source"), F.col("part").alias("row"), "text")


def _csv_rows(header: list[str] | None) -> Parser:
    def parse(content: bytes) -> list[str]:
        rows = list(csv.reader(io.StringIO(content.decode("utf-8"), newline="")))
        names, body = (header, rows) if header else (rows[0] if rows else [], rows[1:])
        return ["\n".join(f"{n}: {v}" for n, v in zip(names, row)) if row else "" for row in body]

    return parse


def _strings(data) -> Iterator[str]:
    """String values, depth first, in document order."""
    if isinstance(data, str):
        yield data
    elif isinstance(data, dict):
        for v in data.values():
            yield from _strings(v)
    elif isinstance(data, list):
        for v in data:
            yield from _strings(v)


def json_text(content: bytes) -> list[str]:
    return ["\n".join(_strings(json.loads(content.decode("utf-8"))))]


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): the string values of every JSON file, one per line."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _parse(files, {"": json_text}).select(F.col("path").alias("source"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _plain(content: bytes) -> list[str]:
    return [content.decode("utf-8")]


PARSERS: dict[str, Parser] = {
    ".txt": _plain, ".md": _plain, ".markdown": _plain, ".csv": _csv_rows(None), ".json": json_text,
    ".html": _plain, ".htm": _plain,
}

PARSED = "path string, part int, text string, error string"


def _parse(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """(path, part, text, error): a file that cannot be parsed becomes one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                ext = next((e for e in parsers if e and path.lower().endswith(e)), "")
                parser = parsers.get(ext)
                try:
                    if parser is None:
                        raise ValueError("no parser for this file type")
                    rows.extend((path, i, text, None) for i, text in enumerate(parser(content), start=1) if text)
                except Exception as e:  # one bad file must not fail the folder
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "part", "text", "error"]).astype({"part": "Int32"})

    return files.mapInPandas(run, PARSED)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def read_folder(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, errors) of a folder and all below it, supported extensions only.

    ``parsers`` adds plug-ins for formats that need a library: bytes to texts.
    """
    table = {**PARSERS, **(parsers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(
        extension_of(F.col("path")).isin(EXTENSIONS)).select("path", "content")
    parsed = _parse(files, table)
    ok = F.col("error").isNull()
    return parsed.filter(ok).select("path", "part", "text"), parsed.filter(~ok).select("path", "error")


def page_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``content``: readable text of an HTML page."""

    @F.pandas_udf(T.StringType())
    def body(html: pd.Series) -> pd.Series:
        return html.map(html_body)

    return pages.withColumn("content", body(F.col(html_col)))


def list_objects(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(key, size) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    base = (root or path).rstrip("/") + "/"
    return files.select(F.expr(f"substring(path, locate({_quoted(base)}, path) + {len(base)})").alias("key"), F.col("length").alias("size"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


CACHE_ENTRY = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("created_at", T.DoubleType()),
    T.StructField("kb_ids", T.ArrayType(T.StringType())),
    T.StructField("sources", T.ArrayType(T.StructType([
        T.StructField("document_id", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("source_kind", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType())])


def decode_cache(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, count of undecodable ones). ``raw``: scope_key, field, value (JSON)."""
    j = raw.withColumn("e", F.from_json("value", CACHE_ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("e").isNull() | F.col("e._corrupt_record").isNotNull()
    good = j.filter(~bad).select("scope_key", "field", F.concat("scope_key", F.lit("#"), "field").alias("entry_id"), "e.question", "e.answer",
                                 F.timestamp_micros((F.col("e.created_at") * 1e6).cast("long")).alias("created_at"), "e.kb_ids", "e.sources")
    return good, j.filter(bad).agg(F.count(F.lit(1)).alias("undecodable"))
