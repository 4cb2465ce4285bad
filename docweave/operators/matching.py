"""One-to-one matching by vectors, in the order of the candidates, from short lists of bounded blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.operators.sequential import numbered_in_order
from docweave.operators.sizing import broadcast_if_small
from docweave.session import cut_lineage

# fixed values: rows of lists that one task holds, classes listed for a candidate at first, candidates and classes of one cell, scores at once
ENTRIES, LISTED = 2_000_000, 64
BLOCK, SHELVES, CELLS = 8192, 32_768, 8_000_000


def _unit(lists: pa.ChunkedArray) -> np.ndarray:
    """The vectors, each scaled to length 1."""
    flat = lists.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    width = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    if (width != width[0]).any():
        raise ValueError("vectors of unequal length")
    m = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), int(width[0]))
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def nearest_in_turn(wanted: DataFrame, queues: DataFrame, vectors: DataFrame, threshold: float,
                    entries: int = ENTRIES, listed: int = LISTED) -> DataFrame:
    """(kb_id, cand_id, page_id): what each candidate takes when they choose one after the other by ``pos``.

    ``wanted``: kb_id, pos, cand_id, cand_class; ``queues``: kb_id, class_id, page_id; ``vectors``: id of a class, v. A candidate
    takes the class of largest cosine (six digits, the threshold at least) with a page left, of equally good ones that whose next page
    comes first; a class gives its pages in order.

    In each round the next candidates of every base are listed their ``k`` best classes with a page left: blocks of
    candidates meet blocks of classes, and only k rows per candidate leave a task. The lists of a base are then read in turn. A
    candidate whose whole list has been taken by those before it ends the round, for it and those after it are listed again; all
    before it are settled, and the first one always is. A base that gets through less than half of its candidates has its
    lists doubled, and no more than ``entries`` rows are listed at once, so a list is in the end longer than the candidates are many.
    """
    kb, cand, page = (f.schema[c].dataType.simpleString() for f, c in ((wanted, "kb_id"), (wanted, "cand_id"), (queues, "page_id")))
    wanted, queues = (f.filter(F.col("kb_id").isNotNull()) for f in (wanted, queues))
    queue = cut_lineage(numbered_in_order(queues.select("kb_id", "class_id", "page_id"), ["kb_id", "class_id"], "page_id").select("kb_id", "class_id", "page_id", "n"))
    turns = numbered_in_order(wanted.select("kb_id", "pos", "cand_id").distinct(), ["kb_id"], "pos")
    asked = cut_lineage(turns.join(wanted, ["kb_id", "pos", "cand_id"]).join(vectors.withColumnRenamed("id", "cand_class"), "cand_class").select(
        "kb_id", "n", "cand_id", "cand_class", "v"))
    shelves = cut_lineage(queue.groupBy("kb_id", "class_id").agg(F.count(F.lit(1)).alias("size")).join(vectors.withColumnRenamed("id", "class_id"), "class_id"))
    most = math.isqrt(entries) + 1
    fronts = cut_lineage(asked.groupBy("kb_id").agg((F.max("n") + 1).alias("end")).select("kb_id", F.lit(0).cast("long").alias("front"), "end", F.lit(min(listed, most)).alias("k")))
    taken = queue.select("kb_id", F.lit(None).cast(cand).alias("cand_id"), "class_id", "page_id").filter("false")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if a.num_rows and b.num_rows:
            b = b.sort_by("page_id")
            k, own, ids = a["k"][0].as_py(), a["cand_class"].to_numpy(), b["class_id"].to_numpy()
            left, right = _unit(a["v"]), _unit(b["v"])
            step = max(1, CELLS // len(right))
            for start in range(0, len(left), step):
                scores = np.round(left[start:start + step] @ right.T, 6)
                scores[own[start:start + step, None] == ids[None, :]] = 1.0
                good = scores >= threshold
                if len(right) > k:
                    good &= scores >= -np.partition(np.where(good, -scores, np.inf), k - 1, axis=1)[:, k - 1:k]
                x, y = np.nonzero(good)
                order = np.lexsort((y, -scores[x, y], x))
                x, y = x[order], y[order]
                keep = np.arange(len(x)) - np.searchsorted(x, x) < k
                for part, new in zip(out, (x[keep] + start, y[keep], scores[x[keep], y[keep]])):
                    part.append(new)
        x, y, score = (np.concatenate(p) if p else np.empty(0, np.int64) for p in out[:3])
        x, y = pa.array(x, pa.int64()), pa.array(y, pa.int64())
        return pa.table({**{c: a[c].take(x) for c in ("kb_id", "n", "cand_id", "k")}, **{c: b[c].take(y) for c in ("class_id", "page_id")}, "score": pa.array(score, pa.float64())}
                        ).select(["kb_id", "n", "cand_id", "k", "class_id", "page_id", "score"])

    def in_turn(lists: pa.Table, stock: pa.Table) -> pa.Table:
        """Rows of what is taken, and one without a class where the round ends before its last candidate."""
        lists = lists.sort_by([("n", "ascending"), ("score", "descending"), ("page_id", "ascending")])
        stock = stock.sort_by([("class_id", "ascending"), ("m", "ascending")])
        if not lists.num_rows:
            return lists.select(["kb_id", "n", "cand_id", "class_id", "page_id"])
        names, first = np.unique(stock["class_id"].to_numpy(), return_index=True)
        code, score, n = np.searchsorted(names, lists["class_id"].to_numpy()).tolist(), lists["score"].to_pylist(), lists["n"].to_numpy()
        at, last = first.tolist(), [*first[1:].tolist(), stock.num_rows]
        place = pc.rank(stock["page_id"], tiebreaker="dense").to_pylist()
        begin, k, row, got, stop = at.copy(), lists["k"][0].as_py(), [], [], None
        starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(n)]):
            chosen, i = None, lo
            while i < hi:
                j = i
                while j < hi and score[j] == score[i]:
                    c = code[j]
                    if at[c] < last[c] and (chosen is None or place[at[c]] < place[at[chosen]]):
                        chosen = c
                    j += 1
                if chosen is not None:
                    break
                i = j
            # a full list says nothing of what comes after its end
            beyond = chosen is None or score[i] == score[hi - 1] and place[at[chosen]] > place[begin[code[hi - 1]]]
            if hi - lo >= k and beyond:
                stop = lo
                break
            if chosen is not None:
                row.append(lo)
                got.append(at[chosen])
                at[chosen] += 1
        found = lists.take(pa.array(row, pa.int64())).select(["kb_id", "n", "cand_id"])
        given = stock.take(pa.array(got, pa.int64()))
        out = found.append_column("class_id", given["class_id"]).append_column("page_id", given["page_id"])
        if stop is None:
            return out
        end = lists.slice(stop, 1).select(["kb_id", "n", "cand_id"])
        return pa.concat_tables([out, end.append_column("class_id", pa.nulls(1, out.schema.field("class_id").type)).append_column("page_id", pa.nulls(1, out.schema.field("page_id").type))])

    while True:
        block = F.least(F.floor(F.lit(entries) / F.col("k")), F.col("end") - F.col("front"))
        given = cut_lineage(taken.groupBy("kb_id", "class_id").agg(F.count(F.lit(1)).alias("c")))
        none = F.coalesce("c", F.lit(0)).cast("long")
        left = shelves.join(given, ["kb_id", "class_id"], "left").withColumn("c", none).filter("c < size")
        sizes = left.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / SHELVES).cast("int").alias("nb"))
        sizes = cut_lineage(fronts.filter("front < end").join(sizes, "kb_id").withColumn("block", block).withColumn("na", F.ceil(F.col("block") / BLOCK).cast("int")))
        cells = sizes.agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
        if not cells:
            return taken.select("kb_id", "cand_id", "page_id")
        small = broadcast_if_small(sizes)
        next_page = queue.withColumnRenamed("n", "c")
        a = asked.join(small, "kb_id").filter("n >= front and n < front + block").select(
            "kb_id", F.floor((F.col("n") - F.col("front")) / BLOCK).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "n", "cand_id", "cand_class", "k", "v")
        b = left.join(next_page, ["kb_id", "class_id", "c"]).join(small, "kb_id").select(
            "kb_id", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), F.pmod(F.xxhash64("class_id"), F.col("nb")).cast("int").alias("j"), "class_id", "page_id", F.col("v").alias("v"))
        keys, tasks = ["kb_id", "i", "j"], min(int(cells), 2000)
        met = a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
            meet, f"kb_id {kb}, n long, cand_id {cand}, k int, class_id long, page_id {page}, score double")
        best = W.partitionBy("kb_id", "n").orderBy(F.col("score").desc(), "page_id")
        lists = cut_lineage(met.withColumn("_r", F.row_number().over(best)).filter("_r <= k").drop("_r"))
        # no class gives more pages than candidates list it
        demand = lists.groupBy("kb_id", "class_id").agg(F.count(F.lit(1)).alias("d")).join(given, ["kb_id", "class_id"], "left").withColumn("c", none)
        stock = queue.withColumnRenamed("n", "m").join(demand, ["kb_id", "class_id"]).filter("m >= c and m < c + d").select("kb_id", "class_id", "m", "page_id")
        found = cut_lineage(lists.groupBy("kb_id").cogroup(stock.groupBy("kb_id")).applyInArrow(
            in_turn, f"kb_id {kb}, n long, cand_id {cand}, class_id long, page_id {page}"))
        taken = taken.unionByName(found.filter("class_id is not null").select("kb_id", "cand_id", "class_id", "page_id"))
        stops = found.filter("class_id is null").select("kb_id", F.col("n").alias("stop"))
        short = F.col("stop").isNotNull() & ((F.col("stop") - F.col("front")) * 2 < F.col("block"))
        fronts = cut_lineage(sizes.join(stops, "kb_id", "left").select(
            "kb_id", F.coalesce("stop", F.col("front") + F.col("block")).alias("front"), "end", F.when(short, F.least(F.col("k") * 2, F.lit(most))).otherwise(F.col("k")).alias("k")))
