import random

import pytest
from pyspark.sql import functions as F

from docweave.functions.numbers import closest_reference
from docweave.operators import evaluate as ev, experiments as ex, graph
from docweave.operators.sequential import in_ranges, numbered_in_order


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


PAGE = "id string, kb_id string, page_type string, title string, content string, links array<string>, source_doc_ids array<string>, status string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([
        ("a", "k", "entity", "Alpha", "x" * 300 + " Be ta first, gamma", ["Beta", "Nope"], ["1"], "active"), ("b", "k", "topic", "Be ta", "short", [], [], "active"),
        ("c", "k", "entity", "Gamma", "y" * 20001, [], ["2"], "active"), ("d", "k", "entity", "Delta", "z" * 300, [], ["2"], "deleted"),
        ("i", "k", "index", "Index", "[[Alpha]] [[Delta]]", [], [], "active")], PAGE)


def test_lint(pages):
    got = set(rows(graph.lint_pages(pages), "id", "rule", "level"))
    assert got == {("a", "broken_link", "error"), ("b", "missing_in_index", "warning"), ("b", "empty_source", "warning"), ("b", "abnormal_size", "info"),
                   ("c", "orphan_page", "warning"), ("c", "missing_in_index", "warning"), ("c", "abnormal_size", "info")}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_title_links_in_both_routes(pages, bound, monkeypatch):
    monkeypatch.setattr(graph, "TITLE_ROWS", bound)
    got = set(rows(graph.fill_links(pages), "id", "title", "place"))
    assert got == {("a", "Be ta", 1), ("a", "Gamma", 2), ("i", "Alpha", 1)}
    marked = graph.marked_links(pages.filter("status = 'active'"))
    assert set(rows(marked, "id", "target")) == {("i", "Alpha")}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_title_search_returns_no_more_than_wanted_from_a_task(spark, bound, monkeypatch):
    monkeypatch.setattr(graph, "TITLE_ROWS", bound)
    monkeypatch.setattr(graph, "PAGE_GROUP", 7)
    monkeypatch.setattr(graph, "TITLE_GROUP", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    data = [(i, rng.choice(["k", "z"]), rng.choice([word(), word().title()]), " ".join(word() for _ in range(30))) for i in range(40)]
    pages = spark.createDataFrame(data, "id long, kb_id string, title string, content string").withColumn("status", F.lit("active"))
    want = set()
    for i, kb, title, content in data:
        names = {}
        for _, k, other, _ in data:
            if k == kb and len(other) >= 2 and other.lower() != title.lower():
                names[other.lower()] = min(other, names.get(other.lower(), other))
        hits = sorted((content.replace(" ", "").find(n) + 1, names[n]) for n in names if n in content.replace(" ", ""))
        want |= {(i, name, at, place) for place, (at, name) in enumerate(hits[:8], 1)}
    assert {tuple(r) for r in graph.fill_links(pages).collect()} == want


def test_a_page_gives_its_first_titles_only(spark):
    titles = [(a + b).lower() for a in "abcdef" for b in "abcdef"]
    names = {2: {t: t.upper() for t in titles}}
    text = "".join(titles)
    assert graph.first_mentions(text, "aa", names, 3) == graph.first_mentions(text * 20, "aa", names, 3) == sorted((text.find(n) + 1, n.upper()) for n in titles if n != "aa")[:3]
    body = spark.createDataFrame([(i, "k", text, "") for i in range(5)], "id long, kb_id string, hay string, own string")
    t = spark.createDataFrame([("k", n, n.upper()) for n in titles], "kb_id string, norm string, title string")
    rows_ = [("k", n, n.upper()) for n in titles]
    assert graph._mentions_in_task(body, rows_, 2).count() == graph._mentions_by_base(body, t, 2).count() == 10


def test_navigation(spark):
    e = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, page_id string, rank int")
    l = spark.createDataFrame([("a", "x", 0), ("a", "b", 1), ("a", "y", 2), ("b", "z", 0), ("c", "x", 0), ("c", "w", 1)], "page_id string, target_id string, place int")
    assert rows(graph.navigate(e, l, 2, 9).orderBy("rank"), "page_id") == [("a",), ("x",), ("b",), ("c",), ("w",)]
    assert graph.navigate(e, l, 2, 2).count() == 2
    df = spark.createDataFrame([(["a", "b", "a", "c"],)], "l array<string>")
    assert df.select(graph.related_line(F.col("l"), F.array(F.lit("b")))).first()[0] == "Related: [[a]] [[c]]"


def test_title_matching_is_greedy_in_order(spark):
    c = spark.createDataFrame([("k", "c1", 1, "Same"), ("k", "c2", 2, "x"), ("k", "c3", 3, "y")], "kb_id string, cand_id string, pos int, title string")
    p = spark.createDataFrame([("k", "p1", "s ame"), ("k", "p2", "q"), ("k", "p3", "r")], "kb_id string, page_id string, title string")
    s = spark.createDataFrame([("k", "c2", "p1", 0.99), ("k", "c2", "p2", 0.9), ("k", "c3", "p2", 0.95), ("k", "c3", "p3", 0.86)], "kb_id string, cand_id string, page_id string, score double")
    assert set(rows(graph.match_titles(c, p, s), "cand_id", "page_id", "how")) == {("c1", "p1", "title"), ("c2", "p2", "vector"), ("c3", "p3", "vector")}


def test_recommend_graph_compare(spark):
    h = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.5), (1, "b", 0.8), (1, "", 1.0)], "query_id int, kb_id string, score double")
    pr = spark.createDataFrame([(1, "b", 0.0)], "query_id int, kb_id string, prior double")
    assert rows(graph.recommend_bases(h, pr).orderBy("rank"), "kb_id", "relevance_score", "matched_chunks") == [("a", 0.7, 2), ("b", pytest.approx(0.56), 1)]
    docs = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "doc_id int, kb_id string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.2])], "doc_id int, embedding array<float>")
    nodes, edges = graph.knowledge_graph(docs, vec)
    assert nodes.count() == 4
    assert {(r["source"], r["target"]) for r in edges.filter("type <> 'contains'").collect()} == {("doc:1", "doc:2"), ("doc:1", "doc:3")}
    ans = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "a", [1.0, 0.0])], "question_id int, kb_id string, embedding array<float>")
    assert set(rows(graph.compare_answers(ans), "question_id", "similarity_score", "consistency")) == {(1, 0.0, "low"), (2, 1.0, "high")}


def test_variants_and_votes(spark):
    import hashlib

    u = spark.createDataFrame([(f"u{i}", "e") for i in range(200)], "user_id string, experiment_id string")
    v = spark.createDataFrame([("e", 0, "a", 0.3), ("e", 1, "b", 0.3)], "experiment_id string, pos int, variant_id string, weight double")
    for r in ex.assign_variants(u, v).collect():
        h = int(hashlib.md5(f"{r['user_id']}-e".encode()).hexdigest(), 16) / 2 ** 128
        assert r["variant_id"] == ("a" if h <= 0.3 else "b" if h <= 0.6 else None)
    votes = spark.createDataFrame([(1, "k", True, 0.3, 1.0), (2, "k", True, 0.9, 1.0), (2, "c", False, 0.8, 1.0), (3, "k", True, 1.0, 1.0)], "execution_id int, strategy string, result boolean, confidence double, weight double")
    got = {r["execution_id"]: (r["decision"], round(r["confidence"], 6)) for r in ex.fuse_votes(votes).collect()}
    assert got == {1: (False, 0.0), 2: (True, 0.55), 3: (True, 0.99)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "x", 1)], "query_id int, document_id string, rank int")
    golden = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "query_id int, document_id string")
    assert set(rows(ev.golden_metrics(ranked, golden, 2), "query_id", "hit", "mrr", "recall")) == {(1, 1.0, 0.5, 0.5), (2, 0.0, 0.0, 0.0)}
    hits = spark.createDataFrame([(1, 1, True), (1, 2, True)], "query_id int, rank int, relevant boolean")
    exp = spark.createDataFrame([(1, 1)], "query_id int, expected int")
    assert rows(ev.row_metrics(hits, exp), "precision", "recall") == [(1.0, 2.0)]
    a = spark.createDataFrame([(i, float(i < 6)) for i in range(20)], "query_id int, hit double")
    b = spark.createDataFrame([(i, float(i >= 5)) for i in range(21)], "query_id int, hit double")
    r = ev.compare_arms(a, b).first()
    assert (r["n"], r["only_a"], r["only_b"], r["delta_pp"]) == (20, 5, 14, 45.0) and r["p_value"] == pytest.approx(0.063568, abs=1e-5)
    assert rows(ev.compare_arms(a, a), "p_value") == [(1.0,)]


def test_order_statistics_follow_the_definitions(spark):

    rng = random.Random(2)
    vals = [(g, round(rng.expovariate(0.01), 1)) for g in range(3) for _ in range([1, 21, 100][g])]
    df = spark.createDataFrame(vals, "g int, v double")
    for fn, pick in ((ev.p95_floor, lambda s: s[int(0.95 * (len(s) - 1))]), (ev.p95_capped, lambda s: s[min(len(s) - 1, len(s) * 95 // 100)])):
        got = {r["g"]: r["p"] for r in ev.order_statistic(df, ["g"], "v", fn, "p").collect()}
        assert got == {g: pick(sorted(v for k, v in vals if k == g)) for g in range(3)}


def test_facts_and_faithfulness(spark):
    t = spark.createDataFrame([(1, "Use Docker Compose v2"), (2, "nothing")], "query_id int, content string")
    f = spark.createDataFrame([(1, "docker  compose|podman"), (1, "missing"), (2, "a b")], "query_id int, fact string")
    assert dict(rows(ev.fact_coverage(t, f, loose=True), "query_id", "coverage")) == {1: 0.5, 2: 0.0}
    assert dict(rows(ev.fact_coverage(t, f), "query_id", "coverage")) == {1: 0.0, 2: 0.0}
    q = spark.createDataFrame([(1, "保修期为 3 年，支持退货。", "保修期为 3 年 支持退货"), (2, "保修期为 30 年。", "保修期为 3 年"), (3, "无法找到相关信息", "x"), (4, "有内容的答案", "")], "id int, a string, c string")
    got = dict(rows(ev.lexical_faithfulness(q, ["id"], F.col("a"), F.col("c")), "id", "faithfulness"))
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    cl = spark.createDataFrame([(1, "x1", "abc"), (1, "x2", "n 5")], "sample_id int, clause_id string, clause string")
    sup = spark.createDataFrame([("x1", 0.8), ("x2", 0.9)], "clause_id string, score double")
    num = spark.createDataFrame([(1, ["6"])], "sample_id int, numbers array<string>")
    assert rows(ev.semantic_faithfulness(cl, sup, num), "score") == [(0.5,)]


def test_trajectories_and_gates(spark):
    run = "id string, tools array<string>, final_answer string, expected_tools array<string>, expected_points array<string>, max_steps int, require_all boolean"
    df = spark.createDataFrame([("ok", ["kb"], "答案包含要点", ["kb"], ["要点"], 3, False), ("half", ["kb"], "无法找到", ["kb", "web"], [], 3, False), ("all", ["kb"], "x", ["kb", "web"], None, 3, True), ("none", [], "", None, None, 3, False), ("long", ["a"] * 6, "x", [], [], 3, False)], run)
    got = {r["id"]: (r["tool_selection"], r["step_efficiency"], r["info_coverage"], r["compliance"]) for r in ev.trajectory_scores(df).collect()}
    assert got == {"ok": (1, 1, 1, 1), "half": (0.5, 1, 1, 0.5), "all": (0, 1, 1, 1), "none": (1, 0.5, 1, 0), "long": (1, 0, 1, 1)}
    cur = spark.createDataFrame([("n", 5.0), ("fast", 3.0), ("slow", 20.0)], "metric string, value double")
    base = spark.createDataFrame([("n", 5.0), ("fast", 1.0), ("slow", 10.0), ("gone", 1.0)], "metric string, value double")
    assert dict(rows(ev.regression_gate(cur, base, ["n"]), "metric", "verdict")) == {"n": "ok", "fast": "warn", "slow": "fail", "gone": "missing"}


def test_one_outlier_moves_no_value_into_one_task(spark):
    """Most values lie close together in one group, and one lies a billion times further; ranges stay even."""
    rng = random.Random(8)
    rows = [("hot", rng.random()) for _ in range(6000)] + [("hot", 1e12), ("hot", -1e300)] + [("cold", float(n)) for n in range(40)] + [(None, 3.0), (None, 5.0), ("cold", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = in_ranges(df.filter("v is not null"), ["g", "v"]).groupBy("_range").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2.5 * len(rows) / len(sizes)
    got = {r["g"]: (r["n"], r["p"]) for r in ev.order_statistic(df, ["g"], "v", ev.p95_floor, "p").collect()}
    for g in ("hot", "cold", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == (len(values), values[95 * (len(values) - 1) // 100])
    refs = spark.createDataFrame([("hot", 0.5), ("hot", 1e12), ("hot", 0.5), ("cold", 7.0), (None, 4.0)], "g string, value double")
    out = closest_reference(df.filter("v is not null").withColumnRenamed("v", "value"), refs, ["g"]).collect()
    known = {"hot": [0.5, 1e12], "cold": [7.0], None: [4.0]}
    assert len(out) == len(rows) - 1 and all(r.closest == min(known[r.g], key=lambda x: (abs(x - r.value), x)) for r in out)


def test_numbers_in_order_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaaaab"), x) for x in rng.sample(range(10_000), 3000)]
    got = numbered_in_order(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()
    want = {(k, v): n for k in "ab" for n, v in enumerate(sorted(v for q, v in rows if q == k))}
    assert {(r.k, r.v): r.n for r in got} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_in_rounds_is_matching_in_turn(spark, monkeypatch, seed):
    """One base has nearly all candidates, classes have many pages, scores tie; candidates are counted in short stretches."""
    monkeypatch.setattr(graph, "STRETCH", 7)
    rng = random.Random(seed)
    offers = {(kb, c): {k: rng.choice([0.5, 0.6, 0.7, 0.8]) for k in rng.sample(range(12), rng.randrange(1, 7))} for kb, n in (("hot", 90), ("cold", 6)) for c in range(n)}
    queues = {(kb, p): rng.randrange(12) for kb in ("hot", "cold") for p in range(60)}
    got = graph.first_come(spark.createDataFrame([(kb, c * 3, f"c{c}", k, s) for (kb, c), x in offers.items() for k, s in x.items()], "kb_id string, pos int, cand_id string, class_id int, score double"),
                           spark.createDataFrame([(kb, k, p) for (kb, p), k in queues.items()], "kb_id string, class_id int, page_id int")).collect()
    want, left = set(), {}
    for (kb, p), k in sorted(queues.items()):
        left.setdefault((kb, k), []).append(p)
    for (kb, c), x in sorted(offers.items()):
        best = min(((-s, left[kb, k][0], k) for k, s in x.items() if left.get((kb, k))), default=None)
        if best:
            want.add((kb, f"c{c}", left[kb, best[2]].pop(0)))
    assert {(r.kb_id, r.cand_id, r.page_id) for r in got} == want and len(want) > 30
    assert graph.first_come(spark.createDataFrame([], "kb_id string, pos int, cand_id string, class_id int, score double"), spark.createDataFrame([], "kb_id string, class_id int, page_id int")).count() == 0
