"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from docweave.llm.tokens import slices, spread, text_of, units
from docweave.session import cut_lineage

LETTERS = regex.compile(r"\p{L}+")
PREFIXES = (3, 4, 5)


class Settings(NamedTuple):
    """``examples``: labelled rows at most, taken by the hash of their id; ``terms``: selected terms at most.

    A term is selected if at least ``least`` and ``support`` of the toxic examples have it, most
    examples that have it are toxic, and its chi-square is beyond what the best of all terms would
    reach by luck with probability ``chance``.
    ``neighbours`` vote with the square of their cosine; ``doubt`` is the weight of the vote of
    texts without any selected term.
    """

    examples: int = 10_000
    terms: int = 512
    least: int = 3
    support: float = 0.01
    chance: float = 0.05
    neighbours: int = 10
    doubt: float = 0.5
    threshold: float = 0.3


class Index(NamedTuple):
    """Unit vectors of the examples that have a selected term, in blocks of BLOCK with the largest weight of each term."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    vectors: np.ndarray
    most: np.ndarray
    rest: float


BLOCK = 64


def terms_of(unit: str) -> list[str]:
    """Lower-case words of letters, and their beginnings, marked by a hyphen."""
    out = []
    for word in LETTERS.findall(unit.lower()):
        out.append(word)
        out += [word[:n] + "-" for n in PREFIXES if len(word) > n]
    return out


def _rows(texts: pa.Array, terms: dict[str, int] | None):
    """(text, term, times) of a batch; ``terms`` None: all terms, as strings."""
    cut = units(texts)
    place: dict[str, int] = {} if terms is None else terms
    codes, sizes = [], []
    for unit in cut.words:
        found = [place.setdefault(t, len(place)) for t in terms_of(unit)] if terms is None else [place[t] for t in terms_of(unit) if t in place]
        codes += found
        sizes.append(len(found))
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(cut.bounds))
    at, member = spread(bounds, cut.codes)
    keys, times = np.unique(doc[at] * max(1, len(place)) + np.array(codes, np.int64)[member], return_counts=True)
    return keys // max(1, len(place)), keys % max(1, len(place)), times, list(place)


def examples(docs: DataFrame, labels: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """(doc_id, toxic, text) of the labelled rows to learn from; equal texts of a label count once."""
    label = labels.select(F.col(key).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    label = label.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.examples)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = rows.groupBy("toxic", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "toxic", "text")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def select_terms(rows: DataFrame, settings: Settings) -> tuple[list[str], int, int]:
    """The selected terms and the numbers of toxic and other examples."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            toxic = batch["toxic"].to_numpy()
            doc, term, _, names = _rows(text_of(batch), None)
            for y in (0, 1):
                held[y].update({names[t]: int(n) for t, n in enumerate(np.bincount(term[toxic[doc] == y], minlength=len(names))) if n})
        names = list(held[0] | held[1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "n0": pa.array([held[0][t] for t in names], pa.int64()), "n1": pa.array([held[1][t] for t in names], pa.int64())})

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all0, all1 = size.get(0, 0), size.get(1, 0)
    found = rows.mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b, c, d = F.col("n1").cast("double"), F.col("n0").cast("double"), all1 - F.col("n1"), all0 - F.col("n0")
    chi = (all0 + all1) * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * float(max(1, all0)) * float(max(1, all1)), F.lit(1.0))
    luck = 2 * math.log(max(1, found.count()) / settings.chance)
    kept = found.filter(F.col("n1") >= max(settings.least, settings.support * all1)).filter("n1 > n0").withColumn("chi", chi).filter(F.col("chi") >= luck)
    return [r["term"] for r in kept.orderBy(F.col("chi").desc(), "term").limit(settings.terms).collect()], all1, all0


def document_frequencies(docs: DataFrame, terms: dict[str, int], text: str) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(terms), np.int64), 0
        for batch in slices(batches):
            _, term, _, _ = _rows(text_of(batch), terms)
            held += np.bincount(term, minlength=len(terms))
            n += len(batch)
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, len(terms), dtype=np.int64), "n": np.concatenate([[n], held])})

    rows = docs.selectExpr(f"`{text}` text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return np.array([found.get(i, 0) for i in range(len(terms))], np.float64), found.get(-1, 0)


def weights(doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1, a row for each of ``n`` texts (zero: no term)."""
    out = np.zeros((n, len(idf)))
    out[doc, term] = (1 + np.log(times)) * idf[term]
    length = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Index:
    """Selects terms on the bounded sample, counts them in all documents, and indexes the examples."""
    rows = cut_lineage(examples(docs, labels, settings, key, text), small=True)
    names, n1, n0 = select_terms(rows, settings)
    terms = {t: i for i, t in enumerate(names)}
    found, total = document_frequencies(docs, terms, text)
    idf = np.log((total + 1) / (found + 1)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, term, times, _ = _rows(text_of(batch), terms)
            some, doc = np.unique(doc, return_inverse=True)
            out = weights(doc, term, times, len(some), idf)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(some)), batch["toxic"].take(pa.array(some)), pa.array(list(out), pa.list_(pa.float64()))], names=["doc_id", "toxic", "v"])

    held = rows.mapInArrow(vectors, "doc_id long, toxic int, v array<double>").orderBy("doc_id").collect() if terms else []
    toxic = np.array([r["toxic"] for r in held], np.int64)
    v = np.array([r["v"] for r in held], np.float64).reshape(len(held), len(terms))
    order = np.lexsort((np.arange(len(v)), v.argmax(axis=1))) if len(v) else np.arange(0)
    ids, toxic, v = np.array([r["doc_id"] for r in held], np.int64)[order], toxic[order], v[order]
    most = np.array([v[i:i + BLOCK].max(axis=0) for i in range(0, len(v), BLOCK)]) if len(v) else np.zeros((0, len(terms)))
    empty1, empty0 = n1 - int(toxic.sum()), n0 - int((1 - toxic).sum())
    return Index(terms, idf, ids, toxic, v, most, (empty1 + 0.5 * n1 / max(1, n1 + n0)) / (empty1 + empty0 + 0.5))


def nearest(index: Index, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, places) of the ``k`` nearest examples of each row, exactly; place -1: none.

    The bound of a block is the product with its largest weights. Rows visit blocks by falling
    bound and stop when the bound is below their k-th cosine; ties go to the smaller id.
    """
    bound = asked @ index.most.T
    order = np.argsort(-bound, axis=1, kind="stable")
    cos, place = np.zeros((len(asked), k)), np.full((len(asked), k), -1)
    live = np.arange(len(asked))
    for step in range(bound.shape[1]):
        block = order[live, step]
        reach = bound[live, block]
        on = (reach > 0) & (reach >= cos[live, -1] - 1e-12)
        live, block = live[on], block[on]
        for b in np.unique(block).tolist():
            some = live[block == b]
            at = np.arange(b * BLOCK, min((b + 1) * BLOCK, len(index.vectors)))
            found = asked[some] @ index.vectors[at].T
            scores = np.hstack([cos[some], found])
            places = np.hstack([place[some], np.broadcast_to(at, found.shape)])
            ids = np.where(places >= 0, index.ids[places], np.iinfo(np.int64).max)
            top = np.lexsort((ids, -np.round(scores, 12)), axis=1)[:, :k]
            cos[some], place[some] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(places, top, axis=1)
    place[cos <= 0] = -1
    return cos, place


def votes(index: Index, texts: pa.Array, settings: Settings) -> tuple[np.ndarray, list]:
    """Scores of the texts and their evidence: (example id, cosine, label) of the neighbours."""
    scores, evidence = np.full(len(texts), index.rest), [[] for _ in range(len(texts))]
    if not len(index.vectors):
        return scores, evidence
    doc, term, times, _ = _rows(texts, index.terms)
    some, doc = np.unique(doc, return_inverse=True)
    edges = np.searchsorted(doc, np.arange(0, len(some) + 1024, 1024))
    for i, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        part = some[1024 * i:1024 * (i + 1)]
        cos, place = nearest(index, weights(doc[lo:hi] - 1024 * i, term[lo:hi], times[lo:hi], len(part), index.idf), settings.neighbours)
        w = np.where(place >= 0, cos, 0) ** 2
        scores[part] = ((w * index.toxic[place]).sum(axis=1) + settings.doubt * index.rest) / (w.sum(axis=1) + settings.doubt)
        for d, c, p in zip(part.tolist(), cos, place):
            evidence[d] = [{"doc_id": int(index.ids[x]), "cosine": float(y), "toxic": int(index.toxic[x])} for x, y in zip(p, c) if x >= 0]
    return scores, evidence


EVIDENCE = "array<struct<doc_id: long, cosine: double, toxic: int>>"


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs``.

    Labels come only from rows whose crc32 of the id leaves no 2 modulo 4. The examples are at most
    ``settings.examples`` labelled documents; document frequencies count all documents. Every
    text is compared with the examples through a block-max index that every task holds (at most
    ``examples`` x ``terms`` numbers), and the votes of its nearest ones, weighted by squared cosine, and a
    small vote of the texts without any selected term make a score between 0 and 1.

    Null texts are empty and get the score of texts without selected terms, as do all texts if there
    are no labels of both kinds; null ids stay null and are not held out; labels that are null or
    not 0 or 1 teach nothing, of several labels of an id the largest counts; repeated rows give a row each;
    an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, settings, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, evidence = votes(shared.value, text_of(batch), settings)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= settings.threshold).astype(np.int32)),
                 pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))],
                names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out(F.col(key).cast("long")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, evidence {EVIDENCE}")


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, settings, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            scores, _ = votes(shared.value, text_of(batch, text), settings)
            yield batch.filter(pc.less(pa.array(scores), settings.threshold))

    return docs.mapInArrow(run, docs.schema)
