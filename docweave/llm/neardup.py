"""Near-duplicate documents: DartMinHash signatures of word shingles, banded, and checked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.llm.links import components
from docweave.llm.tokens import slices, spread, text_of
from docweave.operators.sizing import broadcast_if_small, salted_join
from docweave.session import cut_lineage


class Shape(NamedTuple):
    """Shingles of ``words`` words; ``bands`` x ``rows`` coordinates; links from ``similarity`` on.

    ``weighted`` compares multisets (sum of least over sum of largest counts) instead of sets.
    Pairs of a band that are not linked yet are checked if their signatures agree in at least
    ``plausible`` of the coordinates, four standard deviations below ``similarity``.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    weighted: bool = False

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def plausible(self) -> float:
        return self.similarity - 4 * math.sqrt(self.similarity * (1 - self.similarity) / self.size)


GROUP_BLOCK = 2048
#: Bytes of text whose shingles are in memory at once; each word takes some hundred bytes meanwhile.
SLICE_BYTES = 4_000_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Shares of the Poisson law of mean 1, as thresholds of a 64-bit number.
POISSON = np.minimum(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)]) * 2.0 ** 64, 2.0 ** 64 - 4096).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def share(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the distinct shingles of each text, ordered; a text of fewer words is one shingle."""
    cut = pc.ascii_split_whitespace(texts)
    bounds = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if not len(coded):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    n = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(n) - n
    place = np.arange(len(doc)) - start[doc]
    at = np.flatnonzero(place <= (n[doc] - words))
    total = np.zeros(len(at), np.uint64)
    for j in range(words):
        total = mix(total ^ (word[at + j] * ODD[j % len(ODD)]))
    short = np.flatnonzero((n > 0) & (n < words))
    rest = np.array([xxhash.xxh3_64_intdigest(word[start[d]:start[d] + n[d]].tobytes()) for d in short.tolist()], np.uint64)
    owner, value = np.concatenate([doc[at], short]), np.concatenate([total, rest])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    where = np.flatnonzero(first)
    return owner[where], value[where], np.diff(np.append(where, len(owner)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """``size`` coordinates of 16 bits for each weighted set; two sets agree in one with the chance of their weighted Jaccard similarity.

    Darts are a fixed random rain on (weight, rank) of each element, thrown cell by cell from
    hashes: on average one to a cell of area 1. A set catches the darts below its elements'
    weights and its own rank bound, about size x (ln size + 2) in all however large it is; each
    dart has a coordinate, and the one of least rank stays. Sets with a coordinate left empty
    are done again with twice the bound.
    """
    best = np.full(n_docs * size, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    darts = size * (math.log(size) + 2)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(n_docs)
    bound[todo] = darts / total[todo]
    while len(todo):
        active = np.zeros(n_docs, bool)
        active[todo] = True
        mine = active[doc]
        d, e, w = doc[mine], element[mine], weight[mine]
        level = 0
        while len(d):
            low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            cells = np.ceil(bound[d] * width).astype(np.int64)
            owner = np.repeat(np.arange(len(d)), cells)
            cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
            seed = mix(e[owner] ^ mix(cell.astype(np.uint64) * ODD[0] + np.uint64(level * int(ODD[1]) % 2 ** 64)))
            count = np.searchsorted(POISSON, seed, "right")
            for i in range(int(count.max(initial=0))):
                hit = np.flatnonzero(count > i)
                dart = mix(seed[hit] + np.uint64((i + 1) * int(ODD[2]) % 2 ** 64))
                second = mix(dart ^ ODD[3])
                rank = (cell[hit] + share(second)) / width
                who = owner[hit]
                ok = (rank < bound[d[who]]) & (low + width * share(mix(second ^ ODD[4])) < w[who])
                coordinate = ((dart[ok] >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
                packed = ((rank[ok] * 2.0 ** 32).astype(np.uint64) << np.uint64(16)) | (dart[ok] & np.uint64(0xFFFF))
                np.minimum.at(best, d[who[ok]] * size + coordinate.astype(np.int64), packed)
            level += 1
            left = w > (2.0 ** (level - 1))
            d, e, w = d[left], e[left], w[left]
        empty = (best.reshape(n_docs, size) == np.iinfo(np.uint64).max).any(axis=1)
        todo = todo[empty[todo]]
        bound[todo] *= 2
    return (best & np.uint64(0xFFFF)).astype("<u2").reshape(n_docs, size)


def _identity(doc: np.ndarray, value: np.ndarray, times: np.ndarray, n_docs: int) -> list[bytes]:
    """16 bytes that equal sets (with equal counts, if asked) share."""
    out = np.zeros((n_docs, 2), np.uint64)
    for i in (0, 1):
        np.add.at(out[:, i], doc, mix(value * ODD[i] + times.astype(np.uint64) * ODD[5] + ODD[i + 2]))
    return [r.tobytes() for r in out]


def text_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows of one id apart by a hash of their texts."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))


def signatures(docs: DataFrame, shape: Shape, key: str, text: str) -> DataFrame:
    """(doc_id, row, rid, sig): identity and signature of each row's set of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            doc, value, times = shingles(text_of(batch), shape.words)
            times = times if shape.weighted else np.ones_like(times)
            sig = dart_signatures(doc, value, times.astype(np.float64), len(batch), shape.size)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(_identity(doc, value, times, len(batch)), pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                                             names=["doc_id", "row", "rid", "sig"])

    return text_rows(docs, key, text).mapInArrow(run, "doc_id long, row long, rid binary, sig binary")


def sets(docs: DataFrame, ids: DataFrame, shape: Shape, key: str, text: str) -> DataFrame:
    """(rid, hashes, times) of the sets whose first row is in ``ids`` (doc_id, row, rid)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            doc, value, times = shingles(text_of(batch), shape.words)
            times = times if shape.weighted else np.ones_like(times)
            at = np.searchsorted(doc, np.arange(len(batch) + 1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(_identity(doc, value, times, len(batch)), pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                                              pa.array([times[a:b].astype("<u4").tobytes() if shape.weighted else b"" for a, b in zip(at, at[1:])], pa.binary())],
                                             names=["rid", "hashes", "times"])

    first = ids.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    rows = text_rows(docs, key, text)
    rows = rows.join(broadcast_if_small(first, 2_000_000), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["row"] == F.col("_row")), "left_semi").select("text")
    out = rows.mapInArrow(run, "rid binary, hashes binary, times binary")
    return out.join(ids.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("hashes").alias("hashes"), F.first("times").alias("times"))


def checked(pairs: DataFrame, held: DataFrame, shape: Shape) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are at least ``shape.similarity`` alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            cols = [batch[c] for c in ("ah", "at", "bh", "bt")]
            for ah, at, bh, bt in zip(*cols):
                x, y = np.frombuffer(ah.as_buffer(), np.uint64), np.frombuffer(bh.as_buffer(), np.uint64)
                if not len(x) or not len(y):
                    keep.append(len(x) == len(y))
                    continue
                spot = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = x[spot] == y
                if shape.weighted:
                    u, v = np.frombuffer(at.as_buffer(), "<u4").astype(np.int64), np.frombuffer(bt.as_buffer(), "<u4").astype(np.int64)
                    both, all_ = int(np.minimum(u[spot[same]], v[same]).sum()), int(u.sum() + v.sum())
                else:
                    both, all_ = int(same.sum()), len(x) + len(y)
                keep.append(both >= shape.similarity * (all_ - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = held.select(F.col("rid").alias("a"), F.col("hashes").alias("ah"), F.col("times").alias("at"))
    right = held.select(F.col("rid").alias("b"), F.col("hashes").alias("bh"), F.col("times").alias("bt"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ah", "at", "bh", "bt").mapInArrow(run, "a binary, b binary")


def _across(shape: Shape):
    """Links in one bucket (or between two blocks of it) that join different components.

    Each pair is looked at in the first band that it shares, and only while its members are in
    different components; plausible ones are checked on the whole sets, counted for one member at a time.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        sig = np.stack([np.frombuffer(s, "<u2") for s in pdf["sig"]])
        _, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
        block, i, j, band, rid = pdf["block"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["band"].iloc[0], pdf["rid"].to_numpy()
        sets_ = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
        times = [np.frombuffer(t, "<u4").astype(np.int64) if shape.weighted else np.ones(len(h), np.int64) for t, h in zip(pdf["times"], sets_)]
        names, code = np.unique(np.concatenate(sets_), return_inverse=True)
        count, bounds = np.concatenate(times), np.concatenate([[0], np.cumsum([len(h) for h in sets_])])
        total = np.array([t.sum() for t in times])
        mine = np.zeros(len(names), np.int64)
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for at in rows.tolist():
            near = np.minimum(total[cols], total[at]) >= shape.similarity * np.maximum(total[cols], total[at]) - 1e-9
            other = cols[near & (root[cols] != root[at]) & ((cols > at) if i == j else True)]
            same = sig[other] == sig[at]
            first = same.reshape(len(other), shape.bands, shape.rows).all(axis=2).argmax(axis=1)
            other = other[(same.sum(axis=1) >= shape.plausible * shape.size) & (first == band)]
            if not len(other):
                continue
            own = slice(bounds[at], bounds[at + 1])
            mine[code[own]] = count[own]
            owner, member = spread(bounds, other)
            both = np.bincount(owner, weights=np.minimum(mine[code[member]], count[member]), minlength=len(other))
            mine[code[own]] = 0
            for o in other[both >= shape.similarity * (total[other] + total[at] - both) - 1e-9].tolist():
                if root[o] != root[at]:
                    a.append(rid[at])
                    b.append(rid[o])
                    root[root == root[o]] = root[at]
        return pd.DataFrame({"a": a, "b": b})

    return run


def near_classes(docs: DataFrame, shape: Shape, key: str, text: str) -> DataFrame:
    """(doc_id, row, stay, class_size): each row, the row of its class that has the least id (none: null, where no other row is in the class), and how many rows that class has.

    Classes are the components of the links between texts of similarity at least
    ``shape.similarity``; links are found with the chance of the bands (at the threshold, all but
    about 1 in 10,000) and every one is checked on the whole sets. Equal sets are one node from
    the start. In each bucket of a band, members are first compared with the one most often met
    in large buckets, then whatever pairs of the bucket are still in different components are
    compared by signature, in blocks within a task, and the plausible ones exactly. Rows are members and
    links that join components, never pairs, so a large group of copies costs its members, not their square.

    Words are separated by blank and ASCII white space. Texts of fewer than ``shape.words`` words are one shingle; texts
    without words (also null) are copies of each other. Null ids come last, are linked like others, and name a class only if
    it has no other id (then null); rows of one id with different texts are judged each, so an id may come with two classes; repeated
    rows share a class; an empty table gives no rows; other columns are not read.
    """
    signed = cut_lineage(signatures(docs, shape, key, text))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    copies = cut_lineage(signed.groupBy("rid").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))
    width = 2 * shape.rows
    spots = F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(shape.bands)]))
    rows = copies.select("rid", spots.alias("band", "bucket"))
    buckets = cut_lineage(rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("bucket"))).filter("n > 1"))
    met = buckets.groupBy("rid").agg(F.sum("n").alias("met"))
    lead = buckets.join(met, "rid").groupBy("bucket").agg(F.max(F.struct("met", "rid"))["rid"].alias("lead"))
    stars = buckets.join(lead, "bucket").filter("rid != lead").select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b")).distinct()
    stars = cut_lineage(stars, small=True)
    wanted = met.select("rid").join(copies.select("rid", "at.doc_id", "at.row"), "rid")
    held = cut_lineage(sets(docs, cut_lineage(wanted, small=True), shape, key, text))
    links = cut_lineage(checked(stars, held, shape))
    rooted = components(links)
    labelled = buckets.join(rooted.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
    open_ = labelled.join(mixed, "bucket").join(copies.select("rid", "sig"), "rid").join(held, "rid")
    blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
        "i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rest = open_.groupBy("bucket", "i", "j").applyInPandas(_across(shape), "a binary, b binary")
    links = links.unionByName(rest)
    rooted = components(links)
    sizes = copies.select("rid", "at", "n").join(rooted.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    classes = sizes.groupBy("root").agg(F.min("at").alias("stay"), F.sum("n").alias("class_size"))
    shared = sizes.join(classes.filter("class_size > 1"), "root").select("rid", "stay", "class_size")
    return salted_join(signed.select("doc_id", "row", "rid"), shared, ["rid"], ["doc_id", "row"], how="left").select("doc_id", "row", "stay", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def near_duplicates(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size): the class of every row, named by its least doc_id; see ``near_classes``."""
    name = F.when(F.col("stay").isNull(), F.col("doc_id")).otherwise(F.col("stay.doc_id"))
    return near_classes(docs, shape, key, text).select("doc_id", name.alias("class_id"), "class_size")


def drop_near_duplicates(docs: DataFrame, shape: Shape = Shape(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least id; all columns stay.

    Rows are told apart by id and text, so a row goes only if another of its own class stays, whatever other rows have its id.
    Rows without an id stay only if their class has no row with one, and then one does. Of repeated rows of one id and text one
    stays. Only the ids and text hashes of rows to drop meet the texts, broadcast while they are few.
    """
    found = near_classes(docs, shape, key, text).filter("class_size > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("row") == F.col("stay.row"))
    counted = cut_lineage(found.withColumn("stays", stays).groupBy("doc_id", "row", "stays").agg(F.count(F.lit(1)).alias("n")), small=True)
    out = counted.filter("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    twice = counted.filter("stays and n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    same = docs[key].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_row"))
    left = docs.join(broadcast_if_small(out, 2_000_000), same, "left_anti")
    return left.unionByName(docs.join(broadcast_if_small(twice, 2_000_000), same, "left_semi").dropDuplicates([key, text]))
