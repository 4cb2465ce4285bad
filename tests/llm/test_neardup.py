"""Near-duplicate classes against all pairs."""

import random

import numpy as np
import pytest

from docweave.llm import links, neardup

SCHEMA = "doc_id long, text string, class_id string, n int"


def brute(rows, shape):
    def bag(t):
        w = [x for x in (t or "").split() if x]
        out = {}
        for i in range(max(1, len(w) - shape.words + 1) if w else 0):
            out[tuple(w[i:i + shape.words])] = out.get(tuple(w[i:i + shape.words]), 0) + 1
        return out if shape.weighted else dict.fromkeys(out, 1)

    sets = [(i, bag(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = sum(min(a[s], b[s]) for s in a if s in b)
            all_ = sum(a.values()) + sum(b.values()) - both
            if (not a and not b) or (all_ and both >= shape.similarity * all_):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def corpus():
    rng = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 160))]
        rows.append(" ".join(text))
        for _ in range(rng.randrange(6)):
            other = list(text)
            for _ in range(rng.randrange(1, 6)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append("  ".join(other) + "\n")
    hot = [rng.choice(words) for _ in range(120)]
    for n in range(80):
        other = list(hot)
        for _ in range(n % 4):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows.append(" ".join(other))
    rows += ["", None, "   ", "one", "one", "two words", "a b c d", "a b c d", "a b c d e", "rep " * 300, "rep " * 250, "x y " * 60, "x y " * 55, " ".join(words * 12)]
    return list(enumerate(rows))


@pytest.mark.parametrize("weighted, block", [(False, 2048), (True, 2048), (False, 16)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, weighted, block):
    monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
    rows, shape = corpus(), neardup.Shape(weighted=weighted)
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(table, shape).collect()}
    assert got == brute(rows, shape)


def test_signature_agreement_is_weighted_similarity():
    rng = np.random.default_rng(1)
    shared, mine, other = (rng.integers(0, 2 ** 62, n).astype(np.uint64) for n in (200, 60, 80))
    u, v = rng.integers(1, 20, 260).astype(float), rng.integers(1, 20, 280).astype(float)
    both = np.minimum(u[:200], v[:200]).sum()
    doc = np.repeat([0, 1], [260, 280])
    sig = neardup.dart_signatures(doc, np.concatenate([shared, mine, shared, other]), np.concatenate([u, v]), 2, 6000)
    assert abs((sig[0] == sig[1]).mean() - both / (u.sum() + v.sum() - both)) < 0.03


def test_one_row_of_a_class_stays(spark):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(7, text), (3, text), (9, text + " more"), (9, text + " more"), (3, text), (5, "other text of its own"), (None, "no id here"), (None, None)]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(3, text), (5, "other text of its own"), (None, "no id here"), (None, None)], key=str)
    assert neardup.near_duplicates(table.filter("false")).count() == 0
    assert neardup.drop_near_duplicates(table.filter("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(n, n + 1) for n in range(1, 40)] + [(100, n) for n in range(101, 160)] + [(500, 500), (601, 600), (600, 601)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 1 for n in range(1, 41)}, **{n: 100 for n in range(100, 160)}, 600: 600, 601: 600}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(text, times):
    words = text.split()
    for k in range(times):
        words[7 + 23 * k] = f"changed{k}"
    return " ".join(words)


def test_rows_are_dropped_by_row_not_by_id(spark):
    a, b = (" ".join(f"{x}{n}" for n in range(120)) for x in "ab")
    rows = [(3, a), (7, near(a, 1)), (7, b), (None, near(b, 1)), (None, near(b, 2)), (7, b)]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(table).collect()) == [(3, a), (7, b)]


def test_rows_without_an_id_are_linked(spark):
    a = " ".join(f"a{n}" for n in range(160))
    table = spark.createDataFrame([(None, near(a, k), "clash", 1) for k in range(3)], SCHEMA)
    assert [(r.class_id, r.class_size) for r in neardup.near_duplicates(table).collect()] == [(None, 3)] * 3
    assert neardup.drop_near_duplicates(table).count() == 1
    both = table.unionByName(spark.createDataFrame([(9, near(a, 1), "clash", 1)], SCHEMA))
    assert {(r.class_id, r.class_size) for r in neardup.near_duplicates(both).collect()} == {(9, 4)}
    assert [r.doc_id for r in neardup.drop_near_duplicates(both).collect()] == [9]
