"""Size checks that decide between broadcasting a side and shuffling it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000
DENSE_QUERY_BYTES = 64 * 1024 * 1024


def at_most(df: DataFrame, rows: int) -> bool:
    """True when the frame holds no more than ``rows`` rows; reads at most rows+1."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side proven small; otherwise the planner's own join stays."""
    return F.broadcast(df) if at_most(df, rows) else df


def salt_of(*cols: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def salted_join(big: DataFrame, other: DataFrame, on: list[str], spread: list[str],
                buckets: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are spread over ``buckets`` tasks.

    ``big`` may hold one key a third of all times: its rows get a salt derived from
    ``spread``; ``other`` is repeated once per salt. ``how`` is inner or left (the
    salted side is the left one).
    """
    left = big.withColumn("_salt", salt_of(*[F.col(c) for c in spread], buckets=buckets))
    right = other.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(buckets)])))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
