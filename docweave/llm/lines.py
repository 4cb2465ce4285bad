"""Repeated and nearly repeated lines across documents: a segment-partition edit-distance join."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.llm.links import components
from docweave.llm.neardup import ODD, mix
from docweave.llm.tokens import slices, text_of
from docweave.operators.sizing import broadcast_if_small, salted_join
from docweave.session import cut_lineage


class Rule(NamedTuple):
    """Lines of at least ``words`` words count; those of at least ``chars`` code points may differ by ``edits``, others not at all."""

    edits: int = 2
    words: int = 5
    chars: int = 40


#: Every line that is not empty counts; only those of 40 code points may differ.
EVERY = Rule(words=1)
#: Code points hashed at once, cells of a verification, members of a bucket compared in one task.
POINTS, CELLS, GROUP_BLOCK = 1_000_000, 2_000_000, 2048
#: Bytes of text whose lines are in memory at once.
SLICE_BYTES = 8_000_000
#: Candidate pairs of a bucket that are verified together.
PAIRS = 20_000
TRIM = "\t\n\x0b\x0c\r "
_powers: dict = {}


def distinct_lines(texts: pa.Array, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, line number, place among the distinct lines) of the lines that count, trimmed, and the distinct ones."""
    cut = pc.split_pattern(texts, "\n")
    bounds = cut.offsets.to_numpy().astype(np.int64)
    coded = pc.ascii_trim_whitespace(cut.flatten()).dictionary_encode()
    if rule.words == 1:
        enough = pc.not_equal(coded.dictionary, "")
    else:
        enough = pc.greater_equal(pc.count_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]+"), rule.words)
    counts, code = enough.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    number = np.arange(len(code)) - (bounds - bounds[0])[doc] if len(code) else np.empty(0, np.int64)
    on = counts[code]
    return doc[on], number[on], (np.cumsum(counts) - 1)[code[on]], coded.dictionary.filter(enough)


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of part ``i`` of lines of ``length``; parts differ by one at most, later ones are longer."""
    base, extra = length // parts, length % parts
    late = np.maximum(0, i - (parts - extra))
    return base * i + late, base + (i >= parts - extra)


def hashed(size: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start, sums) of lines that lie one after the other in ``points``; sums of hashed points weighted by their place in the line."""
    longest = int(size.max(initial=0)) + 1
    if len(_powers.get("up", ())) < longest:
        steps = np.full(max(10_000, 2 * longest), 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _powers["up"] = np.cumprod(steps)
        steps[1:] = pow(0x9E3779B97F4A7C15, -1, 2 ** 64)
        _powers["down"] = np.cumprod(steps)
    if "mixed" not in _powers:
        _powers["mixed"] = mix(np.arange(2 ** 16, dtype=np.uint64) + ODD[0])
    start = np.cumsum(size) - size
    mixed = _powers["mixed"][points] if len(points) and int(points.max()) < 2 ** 16 else mix(points.astype(np.uint64) + ODD[0])
    mixed *= _powers["up"][np.arange(len(points)) - np.repeat(start, size)]
    return size, start, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])


def content(start: np.ndarray, sums: np.ndarray, which: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of ``count`` points from ``at`` on of the lines ``which``."""
    lo = start[which] + at
    return (sums[lo + count] - sums[lo]) * _powers["down"][at]


def key_of(found: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return mix(found ^ mix(length.astype(np.uint64) * ODD[1] + np.uint64(i + 1)))


def room(at: np.ndarray, i: int, less: np.ndarray | int, edits: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start in a longer line that leave room for the edits before and behind segment ``i``."""
    low = np.maximum(np.maximum(at - i, at + less - (edits - i)), 0)
    return low, np.minimum(np.minimum(at + i, at + less + (edits - i)), last)


def first_keys(size: np.ndarray, start: np.ndarray, sums: np.ndarray, left: np.ndarray, right: np.ndarray, edits: int) -> np.ndarray:
    """Least key (as signed) of the segments of one line of each pair that the other line probes; a pair counts in that bucket only."""
    out = np.full(len(left), np.iinfo(np.int64).max)
    for a, b in ((left, right), (right, left)):
        on = np.flatnonzero((size[b] >= size[a]) & (size[b] <= size[a] + edits))
        a, b = a[on], b[on]
        for i in range(edits + 1):
            at, count = segment(size[a], i, edits + 1)
            found = content(start, sums, a, at, count)
            keys = key_of(found, size[a], i).astype(np.int64)
            low, high = room(at, i, size[b] - size[a], edits, size[b] - count)
            for shift in range(2 * edits + 1):
                some = np.flatnonzero(low + shift <= high)
                same = some[content(start, sums, b[some], (low + shift)[some], count[some]) == found[some]]
                out[on[same]] = np.minimum(out[on[same]], keys[same])
    return out


def segment_rows(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, index) of the rows of some lines.

    A line is indexed by each of its edits + 1 segments, keyed by segment number, line length and content.
    It probes the lengths from its own down to ``edits`` less, each segment only at starts that
    leave room for the edits before and behind it. Substrings are hashed from prefix sums. An index row is
    a probe of its own length at its own place, too, and is not said twice.
    """
    size, start, sums = hashed(np.array([len(x) for x in lines], np.int64), points_of("".join(lines)))
    place, keys, index = [], [], []

    def add(which: np.ndarray, at: np.ndarray, count: np.ndarray, length: np.ndarray, i: int, own: bool) -> None:
        keys.append(key_of(content(start, sums, which, at, count), length, i))
        place.append(which)
        index.append(np.full(len(which), own))

    parts, all_ = edits + 1, np.arange(len(lines))
    for i in range(parts):
        for less in range(edits + 1):
            at, count = segment(size - less, i, parts)
            if less == 0:
                add(all_, at, count, size, i, True)
            low, high = room(at, i, less, edits, size - count)
            for shift in range(2 * edits + 1):
                on = np.flatnonzero((low + shift <= high) & ((low + shift != at) | (less > 0)))
                if len(on):
                    add(on, (low + shift)[on], count[on], (size - less)[on], i, False)
    return np.concatenate(place), np.concatenate(keys), np.concatenate(index)


def points_of(line: str) -> np.ndarray:
    """Code points, from 1 on."""
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)


def within(codes: list[np.ndarray], left: np.ndarray, right: np.ndarray, edits: int) -> np.ndarray:
    """True for each pair of places in ``codes`` whose edit distance is at most ``edits``.

    Bit o of state d says that d edits reach the diagonal o - edits; a band of 2 x edits + 1
    diagonals is all that matters, so a pair takes one small word per state, and many pairs step
    through their characters together until they end or no state is left.
    """
    out, size = np.zeros(len(left), bool), np.array([len(x) for x in codes], np.int64)
    band, one = 2 * edits + 1, np.uint64(1)
    near = np.flatnonzero(np.abs(size[left] - size[right]) <= edits)
    near = near[np.argsort(size[right[near]], kind="stable")]
    full, lo = np.uint64((1 << band) - 1), 0
    while lo < len(near):
        hi = min(len(near), lo + max(1, CELLS // int(size[right[near[lo]]] + band)))
        while hi > lo + 1 and int(size[right[near[hi - 1]]]) > 2 * int(size[right[near[lo]]]) + 64:
            hi = lo + max(1, (hi - lo) // 2)
        some = near[lo:hi]
        lo = hi
        used, place = np.unique(np.concatenate([left[some], right[some]]), return_inverse=True)
        width = int(size[used].max()) + 1
        table = np.zeros((len(used), edits + width + band), np.uint32)
        for row, k in enumerate(used.tolist()):
            table[row, edits:edits + size[k]] = codes[k]
        table = np.ascontiguousarray(table.T)
        a, b, ends = place[:len(some)], place[len(some):], size[right[some]]
        state = [np.full(len(some), sum(1 << (edits + x) for x in range(d + 1)), np.uint64) for d in range(edits + 1)]
        live = np.arange(len(some))
        for j in range(width):
            ended = ends == j
            if ended.any() or j % 16 == 15:
                shift = (edits + size[left[some[live[ended]]]] - j).astype(np.uint64)
                out[some[live[ended]]] = (state[edits][ended] >> shift) & one == one
                on = ~ended & (state[edits] != 0)
                a, b, ends, live, state = a[on], b[on], ends[on], live[on], [x[on] for x in state]
            if not len(live):
                break
            text, match = table[edits + j][b], np.zeros(len(live), np.uint64)
            for o in range(band):
                match |= (table[j + o][a] == text).astype(np.uint64) << np.uint64(o)
            new = [state[0] & match]
            for d in range(1, edits + 1):
                new.append(((state[d] & match) | state[d - 1] | (state[d - 1] >> one) | (new[d - 1] << one)) & full)
            state = new
    return out


def bags(codes: list[np.ndarray]) -> np.ndarray:
    """Counts of characters in 32 classes: lines within k edits differ by 2k at most."""
    owner = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
    return np.bincount(owner * 32 + np.concatenate(codes) % 32, minlength=32 * len(codes)).reshape(-1, 32).astype(np.int32)


def _lids(lines: pa.Array) -> list[bytes]:
    """16 bytes for each line."""
    return [xxhash.xxh3_128_digest(x) for x in lines.cast(pa.large_binary()).to_pylist()]


def _short(lids: list[bytes]) -> np.ndarray:
    """The first half of each lid as a number."""
    return np.frombuffer(b"".join(lids), "<i8")[::2].astype(np.int64)


def _long(lines: pa.Array, rule: Rule) -> pa.Array:
    return lines.filter(pc.greater_equal(pc.utf8_length(lines), rule.chars))


def text_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows of one id apart by a hash of their texts."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))


def line_rows(docs: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """(doc_id, row, line, lid): the lines that count; equal lines share a 16-byte lid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            doc, number, place, lines = distinct_lines(text_of(batch), rule)
            lids = pa.array(_lids(lines), pa.binary()).take(pa.array(place))
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["row"].take(of), pa.array(number.astype(np.int32)), lids], names=["doc_id", "row", "line", "lid"])

    return text_rows(docs, key, text).mapInArrow(run, "doc_id long, row long, line int, lid binary")


def segment_table(docs: DataFrame, rule: Rule, text: str) -> DataFrame:
    """(key, id, index): index and probe rows of the lines long enough to differ; id is an 8-byte hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            found = _long(distinct_lines(text_of(batch), rule)[3], rule)
            ids, lines = _short(_lids(found)), found.to_pylist()
            ends = np.cumsum([len(x) for x in lines])
            lo = 0
            while lo < len(lines):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POINTS, "right")))
                place, keys, index = segment_rows(lines[lo:hi], rule.edits)
                for s in range(0, len(keys), 100_000):
                    part = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].astype(np.int64)), pa.array(ids[lo:hi][place[part]]), pa.array(index[part])], names=["key", "id", "index"])
                lo = hi

    return docs.selectExpr(f"`{text}` text").mapInArrow(run, "key long, id long, index boolean")


def line_texts(docs: DataFrame, ids: DataFrame, rule: Rule, text: str) -> DataFrame:
    """(id, lid, text): the distinct lines whose short hash is in ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            lines = _long(distinct_lines(text_of(batch), rule)[3], rule)
            lids = _lids(lines)
            short = _short(lids)
            for s in range(0, len(lines), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(short[s:s + 10_000]), pa.array(lids[s:s + 10_000], pa.binary()), lines.slice(s, 10_000).cast(pa.string())], names=["id", "lid", "text"])

    found = docs.selectExpr(f"`{text}` text").mapInArrow(run, "id long, lid binary, text string")
    return found.join(broadcast_if_small(ids, 2_000_000), "id", "left_semi").groupBy("lid").agg(F.first("id").alias("id"), F.first("text").alias("text"))


def _linked(rule: Rule):
    """Of some buckets (or two blocks of one): links (a, b, 0) that join what they join, and (line, null, number of its pairs whose first bucket this is)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "lid"])
        lid, seen, line = np.unique(pdf["lid"].to_numpy(), return_index=True, return_inverse=True)
        codes = [points_of(x) for x in pdf["text"].to_numpy()[seen]]
        bag, (size, start, sums) = bags(codes), hashed(np.array([len(x) for x in codes], np.int64), np.concatenate(codes))
        _, rank = np.unique(pdf["key"].to_numpy(), return_inverse=True)
        place = rank * (int(size.max()) + rule.edits + 1) + size[line]
        order = np.argsort(place, kind="stable")
        place, line, key, block = place[order], line[order], pdf["key"].to_numpy()[order], pdf["block"].to_numpy()[order]
        after = np.searchsorted(place, place + rule.edits, "right") - np.arange(len(place)) - 1
        two, ends = pdf["i"].iloc[0] != pdf["j"].iloc[0], np.cumsum(after)
        near, root, a, b, left, right, waiting, lo = np.zeros(len(lid), np.int64), np.arange(len(lid)), [], [], [], [], 0, 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 5 * PAIRS, "right")))
            one = np.repeat(np.arange(lo, hi), after[lo:hi])
            other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            if two:
                across = block[one] != block[other]
                one, other = one[across], other[across]
            x, y = line[one], line[other]
            on = np.flatnonzero(np.abs(bag[x] - bag[y]).sum(axis=1) <= 2 * rule.edits)
            on = on[first_keys(size, start, sums, x[on], y[on], rule.edits) == key[one[on]]]
            left.append(x[on])
            right.append(y[on])
            waiting += len(on)
            lo = hi
            if waiting >= PAIRS or waiting and lo == len(place):
                x, y = np.concatenate(left), np.concatenate(right)
                ok = within(codes, x, y, rule.edits)
                x, y = x[ok], y[ok]
                near += np.bincount(x, minlength=len(lid)) + np.bincount(y, minlength=len(lid))
                while len(x):
                    open_ = root[x] != root[y]
                    x, y = x[open_], y[open_]
                    if len(x):
                        a.append(lid[x[0]])
                        b.append(lid[y[0]])
                        root[root == root[y[0]]] = root[x[0]]
                left, right, waiting = [], [], 0
        some = np.flatnonzero(near)
        return pd.DataFrame({"a": a + lid[some].tolist(), "b": b + [None] * len(some), "n": np.concatenate([np.zeros(len(a), np.int64), near[some]])})

    return run


def line_links(docs: DataFrame, rule: Rule, text: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), enough of them to make the same components as all links within ``rule.edits``, and (lid, near): how many distinct lines are within them."""
    table = segment_table(docs, rule, text)
    of = W.partitionBy("key")
    kept = table.select("key", "id", F.min("id").over(of).alias("lo"), F.max("id").over(of).alias("hi"), F.max("index").over(of).alias("indexed"))
    buckets = cut_lineage(kept.filter("lo != hi and indexed").groupBy("key", "id").agg(F.lit(1).alias("one")).select("key", "id"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    buckets = cut_lineage(buckets.join(sizes, "key"))
    texts = cut_lineage(line_texts(docs, buckets.select("id").distinct(), rule, text))
    blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    named = buckets.join(texts, "id").withColumn("block", F.pmod(F.xxhash64("lid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # small buckets share a task's work, about GROUP_BLOCK rows at a time; one of several blocks is by itself
    groups = max(1, (buckets.filter(blocks == 1).count()) // GROUP_BLOCK)
    found = cut_lineage(named.select("key", "block", "lid", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (blocks == 1).alias("small"),
                                     F.when(blocks == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key")).alias("g")).groupBy(
        "small", "g", "i", "j").applyInPandas(_linked(rule), "a binary, b binary, n long"))
    return found.filter("b is not null").select("a", "b"), found.filter("b is null").groupBy(F.col("a").alias("lid")).agg(F.sum("n").alias("near"))


def line_classes(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, line, first_doc, first_row, first_line, exact, near): every line of a class of more than one, with the place of the class's first line.

    Lines are split at ``\\n`` and trimmed of ASCII white space; those that count (``Rule``) form the
    components of equal and nearly equal lines, the classes. ``exact`` tells whether a line is equal to the
    first by document id, then line number; ``near`` is the number of distinct other lines within the edits.
    Candidates for edits share a segment (at least one of edits + 1 is untouched); every candidate pair
    is verified once, in the first bucket it shares.

    Null texts have no lines; null ids come before others; rows of one id with different texts are told apart by ``row``, a hash
    of the text, and are documents of their own, while repeated rows (id and text) are one document; an empty table
    gives no rows; other columns are not read.
    """
    rows = cut_lineage(line_rows(docs, rule, key, text))
    lines = rows.groupBy("lid").agg(F.min(F.struct("doc_id", "line", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    links, near = line_links(docs, rule, text)
    rooted = components(links)
    classed = lines.join(rooted.withColumnRenamed("node", "lid"), "lid", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "lid"))
    classed = cut_lineage(classed.join(near, "lid", "left").withColumn("near", F.coalesce("near", F.lit(0))))
    stays = classed.groupBy("root").agg(F.min(F.struct("first", "lid")).alias("stay"))
    target = salted_join(classed.select("lid", "root", "near"), stays, ["root"], ["lid"]).select("lid", "stay", "near")
    return salted_join(rows, target, ["lid"], ["doc_id", "line"]).select(
        "doc_id", "row", "line", F.col("stay.first.doc_id").alias("first_doc"), F.col("stay.first.row").alias("first_row"), F.col("stay.first.line").alias("first_line"),
        (F.col("lid") == F.col("stay.lid")).alias("exact"), "near")


def is_first() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("row") == F.col("first_row")) & (F.col("line") == F.col("first_line"))


def repeated_lines(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``line_classes`` that repeat an earlier line; the first line of each class stays."""
    return line_classes(docs, rule, key, text).filter(~is_first())


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (with _id and _row) left joined with ``found`` (doc_id, row, ...); null ids meet."""
    return docs.join(found, docs["_id"].eqNullSafe(found["doc_id"]) & (docs["_row"] == found["row"]), "left").drop(found["doc_id"], found["row"])


def line_report(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, links, leads) per row.

    ``links`` are (line, first_doc, first_line, exact, near) of removed lines, ``leads`` (line, near) of lines that stay for their class.
    """
    gone = line_classes(docs, rule, key, text).withColumn("stays", is_first()).groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set(F.when(~F.col("stays"), F.struct("line", "first_doc", "first_line", "exact", "near")))).alias("links"),
        F.array_sort(F.collect_set(F.when(F.col("stays"), F.struct("line", "near")))).alias("leads"))
    all_ = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_row"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    removed = F.coalesce(F.size("links"), F.lit(0)).cast("long")
    near = F.coalesce(F.size(F.filter("links", lambda x: ~x["exact"])), F.lit(0)).cast("long")
    return with_found(all_, gone).select(F.col("_id").alias("doc_id"), "n_lines", removed.alias("n_removed"), near.alias("n_near"), "links", "leads")


def without_lines(text: Column, removed: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i)), "\n")


def drop_repeated_lines(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts; all rows and columns stay (a text may become empty).

    The first line of each class stays in every copy of its row; rows of one id with other texts are judged each, as are rows without an id.
    """
    gone = repeated_lines(docs, rule, key, text).groupBy("doc_id", "row").agg(F.collect_set("line").alias("_gone")).withColumnsRenamed({"doc_id": "_gone_id", "row": "_gone_row"})
    edited = F.when(F.col("_gone").isNotNull(), without_lines(F.col(text), F.col("_gone"))).otherwise(F.col(text))
    same = docs[key].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs[text]) == gone["_gone_row"])
    return docs.join(gone, same, "left").withColumn(text, edited).select(*docs.columns)
