"""Inner-product search and similarity joins by bounded matrix blocks.

Inside a task numpy multiplies one block of vectors with another; Spark decides
which blocks meet. No route builds a pair row that is not part of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.operators.sizing import BROADCAST_ROWS, DENSE_QUERY_BYTES, at_most, salt_of, salted_join
from docweave.session import cut_lineage

BLOCK_ROWS = 4096
SCORE_CELLS = 16_000_000

# fixed values of the search: queries that travel to all tasks, queries and chunks of one task of the grid, chunks of one tile
FEW_QUERIES = 2048
QUERY_BLOCK, CHUNK_BLOCK = 32_768, 65_536
TILE_ROWS = 8192
#: Stands for a null id inside a block; it comes before all others, as a null does.
NO_ID = np.iinfo(np.int64).min


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _slices(pdf: pd.DataFrame, other_rows: int) -> Iterator[pd.DataFrame]:
    """Pieces of a batch small enough that its score matrix stays near 128 MB."""
    step = max(1, SCORE_CELLS // max(1, other_rows))
    for start in range(0, len(pdf), step):
        yield pdf.iloc[start:start + step]


def _dimension(frame: DataFrame, vec_col: str) -> int:
    """Length of one vector; blocks of unequal vectors fail when they are stacked."""
    row = frame.select(vec_col).first()
    return len(row[0]) if row else 0


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 6).desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true; faster than numpy's search of a matrix."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


class _Top:
    """The k best chunks so far of a block of queries, by score rounded to six digits, ties by id.

    Chunks come in tiles. Single precision rules out every pair that, by the bound of its rounding error, can't be
    better than the k-th so far; the few others are scored in double precision.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.vectors, self.k, self.own = ids, vectors, k, exclude_self
        self.at = np.arange(len(ids))
        self.rough, self.slack = self._rough(vectors)
        self.shown = np.full((len(ids), k), -np.inf)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros((len(ids), k), bool)

    @staticmethod
    def _rough(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in single precision, and their lengths times the relative error of a product."""
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((vectors * vectors).sum(axis=1))
            error = length * math.sqrt((vectors.shape[1] + 8) * 2.0 ** -23)
            return vectors.astype(np.float32), error

    def add(self, ids: np.ndarray, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        """``only``: places of the queries that these chunks meet, where not all do."""
        rough, slack = self._rough(vectors)
        safe = all(len(x) == 0 or np.nanmax(x, initial=0) < 1e12 for x in (slack, self.slack)) and np.isfinite(vectors).all()
        at = 0
        while at < len(ids):
            # the first tiles are small: they set a bound for the others
            size = min(TILE_ROWS, max(256, at))
            tile = slice(at, at + size)
            at += size
            step = max(1, min(1024, SCORE_CELLS // 2 // size))
            for start in range(0, len(self.ids if only is None else only), step):
                rows = slice(start, start + step)
                self._tile(rows if only is None else only[rows], ids[tile], vectors[tile], rough[tile], slack[tile], safe)

    def _tile(self, rows: slice | np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, slack: np.ndarray, safe: bool) -> None:
        low = np.where(self.filled[rows, -1], self.shown[rows, -1], -np.inf)
        cells = len(low) * len(ids)
        x = y = None
        if safe and np.isfinite(low).all():
            least = low - 1e-6 - self.slack[rows] * (slack.max() if len(slack) else 0)
            x, y = _hits(self.rough[rows] @ rough.T >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
        if x is None or len(x) * 16 > cells:
            # no bound yet, or too many near it: the whole tile in double precision
            scores = self.vectors[rows] @ vectors.T
            shown = np.round(scores, 6)
            if self.own:
                shown[(self.ids[rows][:, None] == ids[None, :]) & (ids != NO_ID)[None, :]] = np.nan
            last = self.found[rows, -1]
            good = (shown > low[:, None]) | ((shown == low[:, None]) & (ids[None, :] < last[:, None]))
            if len(ids) > 2 * self.k:
                floor = -np.partition(np.where(good, -shown, np.inf), self.k - 1, axis=1)[:, self.k - 1]
                good &= shown >= floor[:, None]
            x, y = _hits(good)
            scores, shown = scores[x, y], shown[x, y]
        else:
            scores = np.einsum("ij,ij->i", self.vectors[rows][x], vectors[y])
            shown = np.round(scores, 6)
            good = (shown > low[x]) | ((shown == low[x]) & (ids[y] < self.found[rows, -1][x]))
            if self.own:
                good &= (self.ids[rows][x] != ids[y]) | (ids[y] == NO_ID)
            x, y, scores, shown = x[good], y[good], scores[good], shown[good]
        if len(x):
            self._merge(self.at[rows][x], ids[y], scores, shown)

    def _merge(self, x: np.ndarray, ids: np.ndarray, scores: np.ndarray, shown: np.ndarray) -> None:
        touched = np.unique(x)
        held = self.filled[touched]
        row = np.concatenate([x, np.broadcast_to(touched[:, None], held.shape)[held]])
        ids, scores, shown = (np.concatenate([new, old[touched][held]]) for new, old in ((ids, self.found), (scores, self.score), (shown, self.shown)))
        order = np.lexsort((ids, -shown, row))
        row, ids, scores, shown = row[order], ids[order], scores[order], shown[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        keep = place < self.k
        row, place = row[keep], place[keep]
        self.found[row, place], self.score[row, place], self.shown[row, place], self.filled[row, place] = ids[keep], scores[keep], shown[keep], True

    def rows(self) -> pa.Table:
        n = self.filled.sum(axis=1)
        key = lambda ids: pa.array(ids, pa.int64(), mask=ids == NO_ID)
        return pa.table({"query_id": key(np.repeat(self.ids, n)), "id": key(self.found[self.filled]), "score": pa.array(self.score[self.filled], pa.float64())})


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table (id, v), in order of the ids."""
    lists = table["v"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids = np.asarray(table["id"].fill_null(NO_ID).to_numpy())
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    width = len(flat) // max(1, len(ids))
    if lists.null_count or (pc.list_value_length(lists).to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("vectors of unequal length")
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), width)[order]


FOUND = "query_id long, id long, score double"


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, query_key: str, key: str,
                vec_col: str = "embedding", exclude_self: bool = False,
                query_bytes: int = DENSE_QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank): exact k largest inner products per query.

    A query table of checked size, ``FEW_QUERIES`` at most, travels to the tasks as one matrix; every task
    keeps k rows per query, so only queries x k x tasks rows are shuffled. A larger
    query table meets the chunks in a grid of bounded blocks instead.
    """
    dim = _dimension(queries, vec_col)
    limit = max(1, min(FEW_QUERIES, query_bytes // max(1, 8 * dim)))
    asked = queries.select(F.col(query_key).cast("long").alias("id"), F.col(vec_col).alias("v"))
    head = asked.limit(limit + 1).toArrow()
    if head.num_rows > limit:
        return _grid_top_k(queries, chunks, k, query_key, key, vec_col, exclude_self)
    packed = chunks.sparkSession.sparkContext.broadcast(_block(head))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(*packed.value, k, exclude_self)
        for batch in batches:
            if batch.num_rows and len(top.ids):
                top.add(*_block(pa.Table.from_batches([batch])))
        yield from top.rows().to_batches()

    found = chunks.select(F.col(key).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(scan, FOUND)
    return _rank(found, k)


def _blocks(n_rows: int, rows: int | None = None) -> int:
    return max(1, math.ceil(n_rows / (rows or BLOCK_ROWS)))


def _grid_top_k(queries: DataFrame, chunks: DataFrame, k: int, query_key: str, key: str,
                vec_col: str, exclude_self: bool) -> DataFrame:
    """Blocks of queries meet blocks of chunks, both as large as one task may hold while there is a task for every core."""
    n, m = queries.count(), chunks.count()
    cores = max(2, queries.sparkSession.sparkContext.defaultParallelism)
    nc = _blocks(m, CHUNK_BLOCK)
    nq = max(_blocks(n, QUERY_BLOCK), min(_blocks(2 * cores, nc), _blocks(n)))
    left = queries.select(F.col(query_key).cast("long").alias("id"), F.col(vec_col).alias("v"))
    right = chunks.select(F.col(key).cast("long").alias("id"), F.col(vec_col).alias("v"))
    left = left.withColumn("i", salt_of(F.col("id"), buckets=nq)).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = right.withColumn("j", salt_of(F.col("id"), buckets=nc)).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        top = _Top(*_block(a), k, exclude_self)
        top.add(*_block(b))
        return top.rows()

    # one block pair a task: what many of them hold in turn would be the memory of a task
    tasks = nq * nc
    cell = (F.col("i") * nc + F.col("j")).alias("cell")
    found = left.select("id", "v", cell).repartition(tasks, "cell").groupBy("cell").cogroup(
        right.select("id", "v", cell).repartition(tasks, "cell").groupBy("cell")).applyInArrow(meet, FOUND)
    return _rank(found, k)


class _CellTop(_Top):
    """The k best of a block of queries; of a block of chunks in cells the most promising come first, then those the k-th score so far doesn't rule out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool, centres: np.ndarray, probes: int):
        super().__init__(ids, vectors, k, exclude_self)
        self.centres, self.length = centres, np.linalg.norm(vectors, axis=1)
        step = max(1, SCORE_CELLS // 4 // len(centres))
        middle = (vectors[at:at + step] @ centres.T for at in range(0, len(ids), step))
        self.first = np.vstack([np.argsort(-m, axis=1, kind="stable")[:, :probes] for m in middle])

    def meet(self, cells: list[int], sizes: list[int], radii: list[float], ids: np.ndarray, vectors: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        for probing in (True, False):
            for cell, size, radius, end in zip(cells, sizes, radii, ends):
                own = slice(end - size, end)
                self.visit(probing, cell, radius, ids[own], vectors[own])

    def visit(self, probing: bool, cell: int, radius: float, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Chunks of one cell, none farther from its centre than ``radius``. No score is above that of the centre plus query length times radius."""
        wanted = (self.first == cell).any(axis=1)
        if not probing:
            centre = self.centres[cell]
            with np.errstate(over="ignore", invalid="ignore"):
                best = self.vectors @ centre + self.length * radius
                best += 1e-6 + 1e-12 * self.length * (np.linalg.norm(centre) + radius)
            wanted = ~wanted & ~(best < self.shown[:, -1])
        bound = self.filled[:, -1]
        for rows in (np.flatnonzero(wanted & ~bound), np.flatnonzero(wanted & bound)):
            if len(rows):
                self.add(ids, vectors.astype(np.float64), rows)


def _packed(frame: DataFrame, key: str, vec_col: str, blocks: int, rows: int, centres: np.ndarray | None = None) -> DataFrame:
    """(part, ids, vectors, cells, sizes, radii): a row for each of ``blocks`` blocks of about ``rows`` rows, more rows only if copies fill a block.

    With ``centres`` the rows are in order of the nearest one; cells, sizes and radii tell where each begins and how far its rows lie from it.
    """
    dealt = frame.select(F.col(key).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).repartitionById(
        blocks, salt_of(F.col("id"), F.col("v"), buckets=blocks))

    def one(part: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, vectors = _block(pa.Table.from_batches(batches))
        cells, sizes, radii = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if centres is not None:
            half = (centres ** 2).sum(axis=1) / 2
            step = max(1, SCORE_CELLS // 4 // len(centres))
            near = np.concatenate([(vectors[at:at + step] @ centres.T - half).argmax(axis=1) for at in range(0, len(ids), step)])
            order = np.argsort(near, kind="stable")
            ids, vectors = ids[order], vectors[order]
            gap = np.linalg.norm(vectors - centres[near[order]], axis=1)
            cells, first, sizes = np.unique(near[order], return_index=True, return_counts=True)
            radii = np.maximum.reduceat(gap, first)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.astype(np.float32).tobytes()], pa.binary()),
            "cells": pa.array([cells], pa.list_(pa.int32())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "radii": pa.array([radii], pa.list_(pa.float64()))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = 0, []
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * rows:
                yield one(part, held)
                part, held = part + 1, []
        if held:
            yield one(part, held)

    return dealt.mapInArrow(pack, "part int, ids binary, vectors binary, cells array<int>, sizes array<int>, radii array<double>")


def _unpacked(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    keys, flat = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), np.float32)
    return keys, flat.reshape(len(keys), len(flat) // max(1, len(keys)))


def dense_top_k_cells(queries: DataFrame, chunks: DataFrame, k: int, query_key: str, key: str, vec_col: str = "embedding",
                      cells: int = 64, probes: int = 4, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact k best for query tables that grow with the data.

    Chunks are dealt to the nearest of ``cells`` centre vectors. Of every block of chunks a query first visits its
    ``probes`` most promising cells. Its k-th score so far then rules out every cell whose best possible score, centre
    score plus query length times cell radius, is lower; only the rest are visited too. The tighter the data is
    clustered, the fewer vectors meet.

    Queries and chunks are shuffled once, into packed blocks. A task holds one block of queries and reads the kept
    blocks of chunks one after the other, so disk grows with the rows and not with the pairs of blocks, and k rows
    per query leave a task. Chunks are divided among tasks only while there are fewer blocks of queries than cores.
    """
    centre_rows = chunks.select(F.col(vec_col).alias("v")).orderBy(F.xxhash64(F.col(key))).limit(cells).collect()
    if not centre_rows:
        return _rank(queries.sparkSession.createDataFrame([], FOUND), k)
    centres = np.unique(np.vstack([np.asarray(r[0], dtype=np.float64) for r in centre_rows]), axis=0)
    most = max(1, DENSE_QUERY_BYTES // max(1, 8 * centres.shape[1]))
    query_rows, chunk_rows = min(QUERY_BLOCK, most), min(CHUNK_BLOCK, most)
    n, cores = queries.count(), max(2, queries.sparkSession.sparkContext.defaultParallelism)
    nq = max(_blocks(n, query_rows), min(2 * cores, _blocks(n)))
    nc = _blocks(chunks.count(), chunk_rows)
    left = cut_lineage(_packed(chunks, key, vec_col, nc, chunk_rows, centres)).coalesce(min(nc, _blocks(2 * cores, nq)))
    right = _packed(queries, query_key, vec_col, nq, query_rows).select(*[F.col(c).alias(f"q_{c}") for c in ("part", "ids", "vectors")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, _CellTop] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch[name][row] for name in batch.schema.names}
                part = at["q_part"].as_py()
                if part not in tops:
                    asked, vectors = _unpacked(at["q_ids"], at["q_vectors"])
                    tops[part] = _CellTop(asked.copy(), vectors.astype(np.float64), k, exclude_self, centres, probes)
                tops[part].meet(*(at[c].as_py() for c in ("cells", "sizes", "radii")), *_unpacked(at["ids"], at["vectors"]))
        for top in tops.values():
            yield from top.rows().to_batches()

    # the hint: pairs of blocks are read where they lie, neither side is sent to all tasks at once
    return _rank(left.drop("part").crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(search, FOUND), k)


def unlike_existing(candidates: DataFrame, existing: DataFrame, key: str, existing_key: str, threshold: float = 0.92,
                    vec_col: str = "embedding") -> DataFrame:
    """Candidates whose best inner product with an existing vector stays under the threshold."""
    best = dense_top_k(candidates, existing, 1, key, existing_key, vec_col)
    return candidates.join(best.filter(F.col("score") >= threshold).select(F.col("query_id").alias(key)), key, "left_anti")


def distinct_vectors(frame: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """(id, embedding, copies): one row per distinct vector, led by its smallest key.

    Collapsing exact copies first keeps a hot group of copies from being paired
    with itself; membership is the join of the vector with this table.
    """
    return frame.groupBy(vec_col).agg(
        F.min(F.col(key).cast("long")).alias("id"), F.count(F.lit(1)).alias("copies"))


def members(frame: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """(copy, id, n): every row with a vector that is not zero, the first of the n rows of equal vectors, and n."""
    rep = cut_lineage(distinct_vectors(frame, key, vec_col).filter(F.exists(vec_col, lambda x: x != 0)).select("id", F.col("copies").alias("n"), F.col(vec_col).alias("_v")))
    alone, again = rep.filter("n = 1").select(F.col("id").alias("copy"), "id", "n"), rep.filter("n > 1")
    rows = frame.select(F.col(key).cast("long").alias("copy"), F.col(vec_col).alias("_v"))
    # only vectors with copies meet the rows
    both = rows.join(F.broadcast(again), "_v") if at_most(again, BROADCAST_ROWS) else salted_join(rows, again, ["_v"], ["copy"])
    return alone.unionByName(both.select("copy", "id", "n"))


def class_pairs(pairs: DataFrame) -> DataFrame:
    """(id, other, score, n, m): ``pairs`` of similar_pairs in both directions, with the copies of each side."""
    ways = [F.struct(F.col(x).alias("id"), F.col(y).alias("other"), "score", F.col(f"copies_{x}").alias("n"), F.col(f"copies_{y}").alias("m")) for x, y in ("ab", "ba")]
    return pairs.select(F.explode(F.array(*ways)).alias("x")).select("x.*")


def all_pairs(pairs: DataFrame, frame: DataFrame, key: str, vec_col: str = "embedding", buckets: int = 16) -> DataFrame:
    """(id, other, score): ``pairs`` of similar_pairs in both directions, for all copies on both sides, and the copies with each other.

    A result row for every ordered pair of rows, so a group of n copies has n x (n - 1) of them; members of
    such groups, and only they, are spread over ``buckets`` tasks. Where classes and members are enough, use
    ``class_pairs`` and ``members``. A zero vector is similar to nothing.
    """
    member = members(frame, key, vec_col).withColumn("salt", F.when(F.col("n") > 1, salt_of(F.col("copy"), buckets=buckets)).otherwise(F.lit(0))).drop("n")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.when(F.col(n) > 1, buckets - 1).otherwise(0))).alias("salt")
    own = member.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.col("id").alias("other"), F.lit(1.0).alias("score"), "n", F.col("n").alias("m"))
    both = class_pairs(pairs).unionByName(own)
    left = both.select("*", every("n")).join(member, ["id", "salt"]).select(F.col("copy").alias("from"), F.col("other").alias("id"), "score", "m")
    return left.select("*", every("m")).join(member, ["id", "salt"]).filter("from != copy").select(F.col("from").alias("id"), F.col("copy").alias("other"), "score")


def similar_pairs(frame: DataFrame, key: str, threshold: float, vec_col: str = "embedding",
                  strict: bool = True, blocks: int | None = None) -> DataFrame:
    """(a, b, score, copies_a, copies_b), a < b: distinct vectors with cosine above a threshold.

    Vectors are scaled to length 1 and dealt to hash blocks of about 4096 rows. Each
    pair of blocks is one task that multiplies two matrices and returns only the
    pairs above the threshold. The number of blocks follows the number of rows, so
    a block never grows; work is quadratic in rows as the exact answer demands.
    """
    rep = distinct_vectors(frame, key, vec_col)
    n = blocks or _blocks(rep.count())
    home = rep.select("id", "copies", F.col(vec_col).alias("v"), salt_of(F.col("id"), buckets=n).alias("h"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda o: F.struct(F.least(F.col("h"), o).alias("i"), F.greatest(F.col("h"), o).alias("j")))
    spread = home.select("id", "copies", "v", "h", F.explode(cells).alias("cell")).select(
        "id", "copies", "v", "h", "cell.i", "cell.j")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["h"] == i], pdf[pdf["h"] == j]
        cols = {"a": [], "b": [], "score": [], "copies_a": [], "copies_b": []}
        if not len(a) or not len(b):
            return pd.DataFrame(cols)

        def unit(part: pd.DataFrame) -> np.ndarray:
            m = _matrix(part["v"])
            length = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

        scores = unit(a) @ unit(b).T
        rounded = np.round(scores, 6)
        x, y = np.nonzero(rounded > threshold if strict else rounded >= threshold)
        ia, ib = a["id"].to_numpy()[x], b["id"].to_numpy()[y]
        keep = ia < ib if i == j else ia != ib
        x, y, ia, ib = x[keep], y[keep], ia[keep], ib[keep]
        ca, cb = a["copies"].to_numpy()[x], b["copies"].to_numpy()[y]
        swap = ia > ib
        return pd.DataFrame({
            "a": np.where(swap, ib, ia), "b": np.where(swap, ia, ib), "score": scores[x, y],
            "copies_a": np.where(swap, cb, ca), "copies_b": np.where(swap, ca, cb)})

    return spread.groupBy("i", "j").applyInPandas(
        meet, "a long, b long, score double, copies_a long, copies_b long")


def best_class(queries: DataFrame, examples: DataFrame, query_key: str, example_key: str, class_col: str,
               vec_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, label, score): largest cosine per query and class of the examples.

    Examples are a rule table of checked size, carried to every task as one matrix;
    each query row is finished inside its task and nothing is shuffled.
    """
    dim = _dimension(examples, vec_col)
    limit = max(1, DENSE_QUERY_BYTES // max(1, 8 * dim))
    head = examples.select(F.col(example_key).cast("long").alias("e"), F.col(class_col).cast("string").alias("c"),
                           F.col(vec_col).alias("v")).limit(limit + 1)
    if head.count() > limit:
        return _best_class_grid(queries, examples, query_key, example_key, class_col, vec_col, exclude_self)
    local = head.toPandas()
    matrix = _matrix(local["v"])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
    packed = queries.sparkSession.sparkContext.broadcast((local["e"].to_numpy(), local["c"].to_numpy(), matrix))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, classes, mat = packed.value
        for pdf in (part for batch in batches for part in _slices(batch, len(ids))):
            m = _matrix(pdf["v"])
            size = np.linalg.norm(m, axis=1, keepdims=True)
            scores = np.divide(m, size, out=np.zeros_like(m), where=size > 0) @ mat.T
            if exclude_self:
                scores[pdf["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            for label in np.unique(classes):
                best = scores[:, classes == label].max(axis=1)
                keep = np.isfinite(best)
                yield pd.DataFrame({"query_id": pdf["id"].to_numpy()[keep], "label": label, "score": best[keep]})

    return queries.select(F.col(query_key).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInPandas(
        scan, "query_id long, label string, score double")


def _best_class_grid(queries, examples, query_key, example_key, class_col, vec_col, exclude_self) -> DataFrame:
    """Examples too many for one matrix: hash blocks of them, one pass each, then the max."""
    n = _blocks(examples.count())
    parts = None
    for i in range(n):
        block = examples.filter(salt_of(F.col(example_key), buckets=n) == i)
        part = best_class(queries, block, query_key, example_key, class_col, vec_col, exclude_self)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "label").agg(F.max("score").alias("score"))
