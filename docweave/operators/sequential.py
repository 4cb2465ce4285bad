"""Rules that must read the rows of a key in order, without holding a key in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.session import cut_lineage

Rows = dict[str, np.ndarray]


def scan_groups(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any],
                step: Callable[[Any, Rows], tuple[Sequence, ...] | None], schema: str) -> DataFrame:
    """Feed the rows of every key, in order, to ``step(state, rows) -> output columns``.

    Rows are hashed on the keys and sorted (spilling) inside each task, then read as
    Arrow batches: a key of any size costs its state, not its rows. ``start()`` makes
    a fresh state per key; ``rows`` holds one array per column and may be a part of a
    key. A rule that falls apart into independent stretches should put the stretch into
    ``keys`` (see ``segments``), so a hot key is many groups.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            change = np.zeros(len(pdf), bool)
            change[0] = True
            missing = {k: pdf[k].isna().to_numpy() for k in keys}
            for k in keys:
                change[1:] |= (cols[k][1:] != cols[k][:-1]) & ~(missing[k][1:] & missing[k][:-1])
            bounds = [*change.nonzero()[0], len(pdf)]
            out: list[list] = [[] for _ in names]
            for lo, hi in zip(bounds, bounds[1:]):
                key = tuple(None if missing[k][lo] else cols[k][lo] for k in keys)
                if key != current:
                    current, state = key, start()
                for held, new in zip(out, step(state, {c: v[lo:hi] for c, v in cols.items()}) or ()):
                    held.extend(new)
            if out[0]:
                yield pd.DataFrame(dict(zip(names, out)))

    names = [part.split()[0] for part in schema.split(", ")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def segments(df: DataFrame, keys: list[str], at: str, gap: float, slice_width: float, tie: list[str],
             name: str = "segment_start", strict: bool = True) -> DataFrame:
    """Adds the start of the stretch each row is in; a stretch ends where the next row of
    the key is more than ``gap`` away (at least, when not ``strict``).

    ``at`` is numeric; a null key is a key like others. Rows are windowed per (key, slice), so one key is spread over its
    slices; what crosses a slice border is carried through one row per slice.
    """
    sliced = df.withColumn("_s", F.floor(F.col(at) / slice_width))
    inside = W.partitionBy(*keys, "_s").orderBy(at, *tie)
    along = W.partitionBy(*keys).orderBy("_s")
    edges = sliced.groupBy(*keys, "_s").agg(F.max(at).alias("_max")).select(
        *keys, "_s", F.lag("_max").over(along).alias("_before"))
    prev = F.coalesce(F.lag(at).over(inside), F.col("_before"))
    far = (F.col(at) - F.col("_prev") > gap) if strict else (F.col(at) - F.col("_prev") >= gap)
    rows = null_safe_join(sliced, edges, [*keys, "_s"]).withColumn("_prev", prev).withColumn(
        "_open", F.when(F.col("_prev").isNull() | far, F.col(at)))
    running = F.last("_open", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_run", running)
    carried = rows.groupBy(*keys, "_s").agg(F.max("_open").alias("_last")).select(
        *keys, "_s", F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    return null_safe_join(rows, carried, [*keys, "_s"]).withColumn(name, F.coalesce("_run", "_carry")).drop(
        "_s", "_before", "_prev", "_open", "_run", "_carry")


def in_ranges(rows: DataFrame, cols: list[str], name: str = "_range") -> DataFrame:
    """``rows`` dealt by ranges of ``cols``, cut by a sample of their values so that ranges hold about as many rows each, with the number of the range.

    Numbers rise with the columns. Neither one key with most rows nor one value far from the others makes a large range.
    """
    return cut_lineage(rows.repartitionByRange(*cols).withColumn(name, F.spark_partition_id()))


def numbered_in_order(rows: DataFrame, keys: list[str], order: str, name: str = "n") -> DataFrame:
    """Adds the number of each row, from 0, within its keys by ``order``; a key with any number of rows is many tasks."""
    ranged = in_ranges(rows, [*keys, order])
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    start = F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    return ranged.withColumn("_i", inside).join(sizes.withColumn("_start", start), [*keys, "_range"]).withColumn(name, (F.col("_i") + F.col("_start")).cast("long")).drop("_i", "_start", "_c", "_range")


def seconds(ts: Column) -> Column:
    """Timestamp as seconds with microseconds."""
    return F.unix_micros(ts) / 1e6
