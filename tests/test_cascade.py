"""Deletions along references against a row-by-row fixpoint."""

import random

import pytest

from docweave.operators.cascade import Reference, cascade, waves


def brute(tables, keys, references, roots):
    """Repeats over all rows until nothing more goes."""
    gone = {n: {tuple(r[c] for c in keys[n]) for r in rows if tuple(r[c] for c in keys[n]) in roots.get(n, set())} for n, rows in tables.items()}
    of = lambda n, r: tuple(r[c] for c in keys[n])
    while True:
        before = sum(map(len, gone.values()))
        for r in references:
            dead = {tuple(x[c] for c in r.parent_columns) for x in tables[r.parent] if of(r.parent, x) in gone[r.parent]}
            for row in tables[r.child]:
                if r.rule == "row":
                    hit = None not in (v := tuple(row[c] for c in r.columns)) and v in dead
                else:
                    ids = {i for i in row[r.columns[0]] or [] if i is not None}
                    hits = {i for i in ids if (i,) in dead}
                    hit = bool(hits) if r.rule == "any" else bool(hits) and hits == ids
                if hit:
                    gone[r.child].add(of(r.child, row))
        if sum(map(len, gone.values())) == before:
            return gone


def check(spark, schemas, tables, keys, references, roots):
    frames = {n: spark.createDataFrame([tuple(r.values()) for r in rows], schemas[n]) for n, rows in tables.items()}
    starts = {n: spark.createDataFrame([*ids], ", ".join(x for x in schemas[n].split(", ") if x.split()[0] in keys[n])) for n, ids in roots.items()}
    got, want = cascade(frames, keys, references, starts), brute(tables, keys, references, roots)
    counts = {r["table"]: r for r in got.counts.collect()}
    for n, rows in tables.items():
        left = {tuple(r[c] for c in keys[n]): r for r in got.left[n].collect()}
        assert set(left) == {tuple(r[c] for c in keys[n]) for r in rows} - want[n], n
        assert (counts[n].deleted, counts[n].left) == (len(want[n]), len(left)), n
        assert {tuple(r) for r in got.gone[n].collect()} == want[n] if n in got.gone else not want[n]
        changed = 0
        for r in rows:
            if (k := tuple(r[c] for c in keys[n])) in left:
                new = dict(r)
                for x in references:
                    if x.child == n and x.rule == "every" and r[x.columns[0]] is not None:
                        dead = {p[x.parent_columns[0]] for p in tables[x.parent] if tuple(p[c] for c in keys[x.parent]) in want[x.parent]}
                        new[x.columns[0]] = [i for i in r[x.columns[0]] if i not in dead]
                assert left[k].asDict() == new
                changed += new != r
        assert counts[n].rewritten == changed


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_lists_and_pairs_of_columns(spark, seed):
    rng = random.Random(seed)
    ids = lambda n: [rng.choice([None, *range(30)]) for _ in range(n)]
    tables = {
        "a": [{"id": i, "owner": i % 3} for i in range(30)],
        "b": [{"id": i, "a": x, "owner": rng.choice([0, 1, 2, None])} for i, x in enumerate(ids(60))],
        "c": [{"id": i, "b": x} for i, x in enumerate(ids(80))],
        "d": [{"id": i, "x": rng.choice([None, sorted(set(range(40)) & {rng.randrange(40) for _ in range(3)})])} for i in range(50)],
        "e": [{"k": i, "n": j, "x": [rng.randrange(30)] * 2} for i in range(8) for j in range(5)],
        "f": [{"id": i, "d": rng.randrange(60)} for i in range(40)]}
    schemas = {"a": "id long, owner long", "b": "id long, a long, owner long", "c": "id long, b long", "d": "id long, x array<long>", "e": "k long, n int, x array<long>", "f": "id long, d long"}
    keys = {n: ("id",) for n in tables} | {"e": ("k", "n")}
    links = [Reference("b", ("a", "owner"), "a", ("id", "owner")), Reference("c", ("b",), "b", ("id",)), Reference("c", ("b",), "a", ("id",)),
             Reference("d", ("x",), "b", ("id",), "every"), Reference("e", ("x",), "b", ("id",), "any"), Reference("f", ("d",), "d", ("id",))]
    check(spark, schemas, tables, keys, links, {"a": {(i,) for i in range(0, 30, 2)} | {(99,)}, "e": {(1, 1)}})


def test_rings_end(spark):
    """Pages name each other and their folders, folders lie in folders and have a cover page."""
    tables = {"page": [{"id": i, "next": (i * 7 + 1) % 40 if i % 5 else None, "folder": i % 12} for i in range(40)],
              "folder": [{"id": i, "up": i // 2 if i else None, "cover": i * 3} for i in range(12)], "note": [{"id": i, "page": i} for i in range(60)]}
    schemas = {"page": "id long, next long, folder long", "folder": "id long, up long, cover long", "note": "id long, page long"}
    links = [Reference("page", ("next",), "page", ("id",)), Reference("page", ("folder",), "folder", ("id",)), Reference("folder", ("up",), "folder", ("id",)),
             Reference("folder", ("cover",), "page", ("id",)), Reference("note", ("page",), "page", ("id",))]
    keys = {n: ("id",) for n in tables}
    assert waves(tables, links) == [["folder", "page"], ["note"]]
    check(spark, schemas, tables, keys, links, {"folder": {(11,)}})
    check(spark, schemas, tables, keys, links, {"folder": {(77,)}})
