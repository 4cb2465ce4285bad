"""Deletions along a graph of references between tables."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from docweave.operators.sizing import at_most
from docweave.session import cut_lineage


class Reference(NamedTuple):
    """Rows of ``child`` whose ``columns`` equal the ``parent_columns`` of a row of ``parent`` refer to it; null refers to nothing.

    ``rule`` says what becomes of a row that refers to a deleted one: ``row`` deletes it; ``any`` and ``every`` are for a single column
    that holds an array of ids: with ``any`` one deleted id deletes the row, with ``every`` the row loses the ids
    that are gone and is deleted with the last of them.
    """

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    rule: str = "row"


class Deletion(NamedTuple):
    """The rows left of each table, the keys deleted from each, and (table, deleted, rewritten, left) as one frame."""

    left: dict[str, DataFrame]
    gone: dict[str, DataFrame]
    counts: DataFrame


def waves(tables: Iterable[str], references: list[Reference]) -> list[list[str]]:
    """The tables in an order in which parents come before children; tables that refer to each other in a ring are one group."""
    below: dict[str, set[str]] = {t: {t} for t in tables}
    for _ in below:
        for r in references:
            below[r.parent] |= below[r.child]
    rings = {t: frozenset(u for u in below if u in below[t] and t in below[u]) for t in below}
    ordered = sorted(set(rings.values()), key=lambda ring: (-len(below[next(iter(ring))]), sorted(ring)))
    return [sorted(ring) for ring in ordered]


def referring(rows: DataFrame, reference: Reference, gone: DataFrame) -> DataFrame:
    """The rows that ``reference`` deletes because of the deleted ``gone``; each row of ``gone`` is met once."""
    targets = gone.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(reference.parent_columns)]).dropna().distinct()
    if reference.rule == "row":
        same: Column = F.lit(True)
        for i, c in enumerate(reference.columns):
            same = same & (rows[c] == F.col(f"_p{i}"))
        return rows.join(targets, same, "left_semi")
    listed, key = reference.columns[0], [c for c in rows.columns if c != reference.columns[0]]
    ids = rows.select(*key, listed, F.explode(F.array_distinct(F.col(listed))).alias("_id"))
    if reference.rule == "any":
        return ids.join(targets, ids["_id"] == F.col("_p0"), "left_semi").drop("_id").dropDuplicates(key)
    met = ids.join(targets, ids["_id"] == F.col("_p0"), "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("_met"), F.first(listed).alias(listed))
    return met.filter(F.col("_met") == F.size(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())))).select(*rows.columns)


def rewritten(rows: DataFrame, key: tuple[str, ...], reference: Reference, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without the deleted ids in their list, and the keys of the rows that lost some."""
    listed = reference.columns[0]
    targets = gone.select(F.col(reference.parent_columns[0]).alias("_id")).dropna().distinct()
    ids = rows.select(*key, F.explode(F.array_distinct(F.col(listed))).alias("_id"))
    lost = ids.join(targets, "_id", "left_semi").groupBy(*key).agg(F.collect_set("_id").alias("_lost"))
    out = rows.join(lost, list(key), "left").withColumn(listed, F.when(F.col("_lost").isNull(), F.col(listed)).otherwise(F.array_except(listed, F.col("_lost"))))
    return out.select(*rows.columns), lost.select(*key)


def cascade(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], references: list[Reference], roots: dict[str, DataFrame]) -> Deletion:
    """Deletes the rows of ``roots`` (frames with the key of their table) and all that refers to them, directly or through other tables.

    Deleted rows travel as the few columns that references read, so each reference is one semi-join whose
    right side has every deleted row once; only tables in a ring of references are repeated, with the newly
    deleted rows of the last round, until no more rows refer to them. Tables that nothing deletes from are left as they are.
    Keys must be unique and not null; ids to delete that are not there delete nothing.
    """
    read = {t: list(dict.fromkeys([*keys[t], *(c for r in references if r.parent == t for c in r.parent_columns), *(c for r in references if r.child == t for c in r.columns)])) for t in tables}
    gone: dict[str, DataFrame] = {}

    def found(name: str, by: dict[str, DataFrame]) -> list[DataFrame]:
        rows = tables[name].select(*read[name])
        return [referring(rows, r, by[r.parent]) for r in references if r.child == name and r.parent in by]

    def united(name: str, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(list(keys[name])) if len(parts) > 1 else out

    for ring in waves(tables, references):
        fresh: dict[str, DataFrame] = {}
        for name in ring:
            start = [tables[name].select(*read[name]).join(roots[name].select(*keys[name]).distinct(), list(keys[name]), "left_semi").select(*read[name])] if name in roots else []
            parts = start + found(name, {p: g for p, g in gone.items() if p not in ring})
            if parts:
                fresh[name] = united(name, parts)
        turning = any(r.child in ring and r.parent in ring for r in references)
        while turning and fresh:
            fresh = {n: cut_lineage(f) for n, f in fresh.items()}
            fresh = {n: f for n, f in fresh.items() if not at_most(f, 0)}
            for n, f in fresh.items():
                gone[n] = cut_lineage(gone[n].unionByName(f)) if n in gone else f
            after = {n: found(n, fresh) for n in ring}
            fresh = {n: united(n, parts).join(gone[n].select(*keys[n]), list(keys[n]), "left_anti").select(*read[n]) if n in gone else united(n, parts) for n, parts in after.items() if parts}
        if not turning:
            gone |= fresh
    left, counts = {}, None
    for name, rows in tables.items():
        key, lost = list(keys[name]), None
        left[name] = rows.join(gone[name].select(*key), key, "left_anti").select(*rows.columns) if name in gone else rows
        for r in references:
            if r.child == name and r.rule == "every" and r.parent in gone:
                left[name], some = rewritten(left[name], keys[name], r, gone[r.parent])
                lost = some if lost is None else lost.unionByName(some).distinct()
        number = lambda df, column: df.agg(F.count(F.lit(1)).alias(column)) if df is not None else None
        row = number(left[name], "left").select(F.lit(name).alias("table"), "left")
        for column, part in (("deleted", gone.get(name)), ("rewritten", lost)):
            row = row.withColumn(column, number(part, column).scalar() if part is not None else F.lit(0).cast("long"))
        row = row.select("table", "deleted", "rewritten", "left")
        counts = row if counts is None else counts.unionByName(row)
    return Deletion(left, {n: g.select(*keys[n]) for n, g in gone.items()}, counts)
