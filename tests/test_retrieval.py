import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import context, dense, fusion, lexical
from docweave.operators.sequential import null_safe_join
from docweave.plans import retrieval
from docweave.plans.retrieve import RetrievalConfig, hashing_embedder, retrieve

RANKED = "query_id int, channel string, document_id string, chunk_index int, rank int, score double"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_rrf_adds_ranks_and_keeps_first_seen_order(spark):
    df = spark.createDataFrame([
        (1, "dense", "a", 0, 1, 0.9), (1, "dense", "b", 0, 2, 0.8),
        (1, "sparse", "b", 0, 1, 7.0), (1, "sparse", "c", 0, 2, 5.0)], RANKED)
    out = fusion.reciprocal_rank_fusion(df, ["dense", "sparse"]).orderBy("rank")
    got = rows(out, "document_id", "rrf_score", "dense_score", "sparse_score")
    assert [g[0] for g in got] == ["b", "a", "c"]
    assert got[0][1] == pytest.approx(1 / 62 + 1 / 61)
    assert got[0][2:] == (0.8, 7.0) and got[1][2:] == (0.9, 0.0)


def test_rrf_ties_by_first_appearance_and_empty_channel(spark):
    df = spark.createDataFrame([(1, "dense", "z", 0, 1, 0.9), (1, "sparse", "a", 0, 1, 7.0)], RANKED)
    assert rows(fusion.reciprocal_rank_fusion(df, ["dense", "sparse"]).orderBy("rank"), "document_id") == [("z",), ("a",)]
    only = df.filter("channel = 'sparse'")
    assert rows(fusion.reciprocal_rank_fusion(only, ["dense", "sparse"]), "document_id") == [("a",)]


def test_minmax_flat_channel_counts_full(spark):
    df = spark.createDataFrame([(1, "dense", "a", 0, 1, 0.5), (1, "dense", "b", 0, 2, 0.5), (1, "sparse", "b", 0, 1, 3.0), (1, "sparse", "a", 0, 2, 1.0)], RANKED)
    got = dict(rows(fusion.minmax_fusion(df, {"dense": 0.5, "sparse": 0.5}), "document_id", "fused_score"))
    assert got == {"a": pytest.approx(0.75), "b": pytest.approx(1.0)}


def test_rerank_falls_back_for_the_whole_query_on_one_null(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, 1, 0.03, 0.1), (1, "b", 0, 2, 0.02, 0.9), (2, "a", 0, 1, 0.03, 0.9), (2, "b", 0, 2, 0.02, None)],
        "query_id int, document_id string, chunk_index int, rank int, rrf_score double, s double")
    out = fusion.rerank(df, F.col("s"), k=2, window=2).orderBy("query_id", "rank")
    assert rows(out, "query_id", "document_id", "rerank_score", "rerank_fallback") == [
        (1, "b", 0.9, False), (1, "a", 0.1, False), (2, "a", 0.03, True), (2, "b", 0.02, True)]


def test_rerank_cuts_before_scoring_and_drops_low_scores(spark):
    df = spark.createDataFrame([(1, "a", 0, 1, 0.3, 0.2), (1, "b", 0, 2, 0.2, 0.6), (1, "c", 0, 3, 0.1, 0.99)],
                               "query_id int, document_id string, chunk_index int, rank int, rrf_score double, s double")
    assert rows(fusion.rerank(df, F.col("s"), k=1, window=2, min_score=0.5), "document_id") == [("b",)]


def test_fold_keeps_first_row_of_a_table_only(spark):
    table = "T\n| a | b |\n| 1 | 2 |"
    data = [(1, "d", 1, table), (1, "d", 2, "T\n| a | b |\n| 3 | 4 |"), (1, "e", 3, table), (1, "d", 4, "text"), (1, "d", 5, "text"),
            (1, "d", 6, "| a |\n|---|\n| 1 |\n| 2 |")]
    df = spark.createDataFrame(data, "query_id int, document_id string, rank int, content string")
    out = fusion.fold_table_rows(df).orderBy("rank")
    assert [r[0] for r in rows(out, "content")] == [table, table, "text", "text", data[5][3]]
    assert rows(out, "rank") == [(i,) for i in range(1, 6)]


CHUNKS = "document_id string, chunk_index int, content string, heading_path string"


def test_neighbors_respect_document_index_heading_and_budget(spark):
    chunks = spark.createDataFrame([
        ("d", 0, "a" * 10, "H1"), ("d", 1, "b" * 10, "H1"), ("d", 2, "c" * 50, "H1"), ("d", 3, "d" * 5, "H2"), ("d", 4, "e" * 10, "H2"),
        ("e", 0, "x" * 10, "")], CHUNKS)
    base = spark.createDataFrame([(1, "d", 1, 1, 0.9, "b" * 10, "H1"), (1, "d", 4, 2, 0.5, "e" * 10, "H2")],
                                 "query_id int, document_id string, chunk_index int, rank int, score double, content string, heading_path string")
    every = rows(context.expand_neighbors(base, chunks).orderBy("rank"), "chunk_index", "score", "neighbor_expand")
    assert every == [(1, 0.9, False), (4, 0.5, False), (0, 0.9, True), (2, 0.9, True), (3, 0.5, True)]
    # 20 used; 10 fits, 50 does not, 5 after it still does
    some = rows(context.expand_neighbors(base, chunks, budget_chars=40).orderBy("rank"), "chunk_index")
    assert some == [(1,), (4,), (0,), (3,)]
    # the base stays whole even above the budget
    assert context.expand_neighbors(base, chunks, budget_chars=1).count() == 2


def test_neighbor_of_another_section_is_dropped(spark):
    chunks = spark.createDataFrame([("d", 0, "a", "H1"), ("d", 1, "b", "H1"), ("d", 2, "c", "H2"), ("d", 3, "f", "")], CHUNKS)
    base = spark.createDataFrame([(1, "d", 1, 1, 0.9, "b", "H1")], "query_id int, document_id string, chunk_index int, rank int, score double, content string, heading_path string")
    assert rows(context.expand_neighbors(base, chunks).orderBy("rank"), "chunk_index") == [(1,), (0,)]
    assert context.expand_neighbors(base, chunks, same_heading=False).count() == 3


def test_gate_ignores_neighbors_and_fallback(spark):
    df = spark.createDataFrame([
        (1, 0.1, False, False), (1, 0.9, True, False), (2, 0.01, False, True), (3, 0.9, True, False), (4, 0.3, False, False)],
        "query_id int, rerank_score double, neighbor_expand boolean, rerank_fallback boolean")
    got = {r["query_id"]: (r["passed"], r["chunks"]) for r in context.relevance_gate(df, 0.3).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (True, 1), 4: (True, 1)}


def test_empty_scope_means_nothing_and_ids_are_checked(spark):
    df = spark.createDataFrame([("00000000-0000-0000-0000-000000000001", "raw"), ("00000000-0000-0000-0000-000000000002", "wiki")], "kb_id string, source_kind string")
    assert df.filter(context.retrieval_filter()).count() == 2
    assert df.filter(context.retrieval_filter(kb_ids=[], document_ids=[])).count() == df.count()
    assert df.filter(context.retrieval_filter(exclude_kinds=context.excluded_kinds())).count() == 1
    with pytest.raises(ValueError):
        context.retrieval_filter(kb_ids=["x' or 1=1"])
    with pytest.raises(ValueError):
        context.retrieval_filter(source_kind="bad kind!")


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, "d", i, i, s, "w " * n) for i, (s, n) in enumerate([(0.9, 5), (0.8, 50), (0.7, 3)], 1)],
                               "query_id int, document_id string, chunk_index int, rank int, score double, content string")
    out = context.pack_context(df, budget=40, reserve=0)
    assert rows(out.orderBy("position"), "chunk_index") == [(1,), (3,)]


@pytest.mark.parametrize("n,want", [(1, [1]), (2, [1, 2]), (5, [1, 5, 2, 4, 3]), (6, [1, 6, 2, 5, 3, 4])])
def test_lost_in_the_middle(spark, n, want):
    df = spark.createDataFrame([(1, i) for i in range(1, n + 1)], "query_id int, position int")
    assert [r[0] for r in rows(context.lost_in_the_middle(df).orderBy("position"), "source_index")] == want


def test_dense_exact_in_both_routes(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(3)
    m32 = m.astype(np.float32).astype(np.float64)
    scores = m32 @ m32.T
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-scores[i])[:4]}
    small = dense.dense_top_k(df, df, 4, "id", "id")
    large = dense.dense_top_k(df, df, 4, "id", "id", query_bytes=64)
    assert set(rows(small, "query_id", "id")) == want == set(rows(large, "query_id", "id"))


def test_dense_blocks_and_tiles_keep_ties_copies_and_null_ids(spark, monkeypatch):
    for name, value in (("FEW_QUERIES", 5), ("QUERY_BLOCK", 64), ("CHUNK_BLOCK", 90), ("TILE_ROWS", 32)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(400, 6)).astype(np.float32)
    m[50:350:3] = m[7]  # many copies: ties by id
    m[60] = m[7] * np.float32(1 + 1e-7)
    m[61] = 1e20
    ids = [*range(398), 3, None]
    schema = "id long, embedding array<float>"
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], schema).repartition(3)
    scores = np.round(m.astype(float) @ m.astype(float).T, 6)
    want = {q: [i for _, i in sorted((-scores[q, c], -1 if i is None else i) for c, i in enumerate(ids) if i != q)[:4]] for q in range(398) if q != 3}
    few = df.filter("id % 100 = 7")
    for asked in (df, few):
        got = {}
        for r in dense.dense_top_k(asked, df, 4, "id", "id", exclude_self=True).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(-1 if r["id"] is None else r["id"])
        keys = [q for q in want if asked is df or q % 100 == 7]
        assert {q: got[q] for q in keys} == {q: want[q] for q in keys}
        assert asked is few or len(got[None]) == 4 and len(got[3]) == 4


def test_cells_are_exact_on_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    m = (rng.normal(size=(6, 8))[rng.integers(0, 6, 150)] + 0.05 * rng.normal(size=(150, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(3)
    want = {tuple(r) for r in dense.dense_top_k(df, df, 5, "id", "id").select("query_id", "id", "rank").collect()}
    got = dense.dense_top_k_cells(df, df, 5, "id", "id", cells=8, probes=1)
    assert {tuple(r) for r in got.select("query_id", "id", "rank").collect()} == want


def shuffled_rows(df):
    """Rows written to the shuffles of a frame whose rows were collected."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            return walk(node.plan() if name.endswith("QueryStageExec") else node.executedPlan())
        metric = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (metric.get().value() if metric.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_cells_keep_ties_copies_and_null_ids_and_shuffle_each_row_once(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("QUERY_BLOCK", 32), ("CHUNK_BLOCK", 50), ("TILE_ROWS", 32)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(12)
    m = (rng.normal(size=(6, 6))[rng.integers(0, 6, 400)] + 0.3 * rng.normal(size=(400, 6))).astype(np.float32)
    m[50:200:3] = m[7]  # many copies: ties by id
    m[60] = m[7] * np.float32(1 + 1e-7)
    ids = [*range(396), 3, None, 5, 5]
    m[398:] = m[5]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "id long, embedding array<float>").repartition(3)
    scores = np.round(m.astype(float) @ m.astype(float).T, 6)
    want = {}
    for q in {*ids}:
        found = sorted((-scores[row, c], -1 if i is None else i) for row in range(400) if ids[row] == q for c, i in enumerate(ids) if i is None or i != q)
        want[q] = [i for _, i in found[:4]]
    for probes in (1, 2, 9):
        top = dense.dense_top_k_cells(df, df, 4, "id", "id", cells=8, probes=probes, exclude_self=True)
        got = {}
        for r in sorted(top.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(-1 if r["id"] is None else r["id"])
        assert got == want
        # the frame's own shuffle, a row per vector, and k per vector for the rank, however many blocks meet
        assert 800 < shuffled_rows(top) <= 400 * (2 + 4)
    assert dense.dense_top_k_cells(df.limit(0), df, 4, "id", "id").count() == dense.dense_top_k_cells(df, df.limit(0), 4, "id", "id").count() == 0


def test_cells_are_skipped_and_a_full_block_is_split(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("QUERY_BLOCK", 64), ("CHUNK_BLOCK", 64)):
        monkeypatch.setattr(dense, name, value)
    rng = np.random.default_rng(4)
    near = (np.eye(8)[rng.integers(0, 8, 300)] + 0.01 * rng.normal(size=(300, 8))).astype(np.float32)
    top = dense._CellTop(np.arange(300), near.astype(float), 5, False, np.eye(8), 1)
    met = []
    monkeypatch.setattr(top, "add", lambda ids, vectors, rows, add=top.add: met.append(len(ids) * len(rows)) or add(ids, vectors, rows))
    cell = near.argmax(axis=1)
    radius = [np.linalg.norm(near[cell == c] - np.eye(8)[c], axis=1).max() for c in range(8)]
    for probing in (True, False):
        for c in range(8):
            top.visit(probing, c, radius[c], np.flatnonzero(cell == c), near[cell == c].astype(float))
    assert sum(met) == sum((cell == c).sum() ** 2 for c in range(8))
    # equal rows go to one block, which may not grow
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 700 + [(2, [0.0, 1.0])], "id long, embedding array<float>").repartition(20)
    sizes = [len(r["ids"]) // 8 for r in dense._packed(df, "id", "embedding", 2, 64).collect()]
    assert sum(sizes) == 701 and max(sizes) <= 3 * 64
    assert rows(dense.dense_top_k_cells(df, df, 3, "id", "id", cells=2, exclude_self=True).orderBy("query_id", "rank"), "query_id", "id") == [(1, 2)] * 3 + [(2, 1)] * 3


def test_similar_pairs_blocks_and_copies(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 4)).astype(np.float32)
    m[7] = m[3]
    m[9] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    u = m.astype(float) / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    keep = [i for i in range(40) if i not in (7, 9)]
    want = {(a, b) for a in keep for b in keep if a < b and round(sims[a, b], 6) > 0.7}
    got = dense.similar_pairs(df, "id", 0.7, blocks=3).collect()
    assert {(r["a"], r["b"]) for r in got} == want
    assert all(r["copies_a"] == 3 for r in got if r["a"] == 3)


def test_frozen_vocabulary_ignores_new_terms(spark):
    old = spark.createDataFrame([(i, "alpha beta" if i == 0 else "gamma delta") for i in range(5)], "doc_id int, text string")
    vocab = lexical.fit_vocabulary(old)
    new = spark.createDataFrame([(9, "alpha omega omega")], "doc_id int, text string")
    got = {r["term"] for r in lexical.weighted_postings(new, ["doc_id"], vocabulary=vocab).collect()}
    assert got == {"alpha"}
    # gamma is in over half of the corpus: negative weight, never written
    assert {r["term"] for r in vocab.filter("idf > 0").collect()} == {"alpha", "beta"}


def test_query_without_known_term_returns_nothing(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "five six")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "nothing here"), (2, "five")], "q int, text string")
    assert rows(lexical.bm25_top_k(docs, q, ["doc_id"], "q", 3), "q", "doc_id") == [(2, 3)]


def test_bm25_in_tasks_gives_what_the_join_gives(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 50)
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, n) % 60)
    data = [(i // 3, str(i % 3), text(rng.integers(0, 12))) for i in range(150)]
    data += [(60 + i, "a", "w3 w9 w9") for i in range(40)] + [data[5], data[7], data[7], (None, "x", "w1 w9"), (None, "x", "w1 w9"), (None, None, "w3"), (200, "z", None)]
    docs = spark.createDataFrame(data, "d long, c string, text string").repartition(4)
    q = spark.createDataFrame([(i, text(6)) for i in range(30)] + [(4, "w3"), (None, "w9"), (77, "zzz")], "q long, text string")
    frozen = lexical.fit_vocabulary(docs.filter("d < 40"))
    for vocabulary in (None, frozen):
        want = lexical.top_k(lexical.bm25_scores(docs, q, ["d", "c"], "q", vocabulary=vocabulary), "q", ["d", "c"], 5)
        got = lexical.bm25_top_k(docs, q, ["d", "c"], "q", 5, vocabulary=vocabulary)
        plain = lambda df: sorted(repr((r["q"], r["rank"], r["d"], r["c"], round(r["score"], 6))) for r in df.collect())
        assert plain(got) == plain(want)
    # no words and no pairs leave a task: k rows per query of each task at most
    asked = [(r["q"], r["term"]) for r in lexical.query_terms(q, "q").collect()]
    many = docs.unionByName(docs.withColumn("d", F.col("d") + 1000))
    assert lexical._scored_in_task(many, asked, q.schema["q"], ["d", "c"], 2, "text", None).groupBy("q", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2


def test_evenly_spaced_rows_sort_only_keys_that_hold_one(spark, monkeypatch):
    rows_ = [(d, i, "x") for d in [*range(0, 3000, 7), 10 ** 12] for i in range(d % 4 + 1)]
    df = spark.createDataFrame(rows_, "document_id long, chunk_index long, content string").repartition(5)
    keys = sorted((d, i) for d, i, _ in rows_)
    for n in (1, 9, len(keys), 2 * len(keys)):
        got = retrieval.evenly_spaced(df, ["document_id", "chunk_index"], n)
        assert rows(got.orderBy("document_id", "chunk_index"), "document_id", "chunk_index") == keys[::max(len(keys) // n, 1)][:n]
    # texts go into a sort for the few wanted keys only
    seen = []
    monkeypatch.setattr(retrieval, "null_safe_join", lambda left, right, on: seen.append(right.count()) or null_safe_join(left, right, on))
    retrieval.evenly_spaced(df, ["document_id", "chunk_index"], 9)
    assert seen == [9]


def test_containing_documents_short_and_long(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox yy"), (2, "the quick brown"), (3, "no")], "d int, text string")
    p = spark.createDataFrame([(1, "the quick brown fox"), (2, "no"), (3, "e quick brown f")], "p int, text string")
    assert set(rows(lexical.containing_documents(docs, p, "d", "p"), "p", "d")) == {(1, 1), (2, 3), (3, 1)}


def test_link_expansion(spark):
    pages = spark.createDataFrame([("p1", "k", "One", ["Two", "Three", "One"], "active"), ("p2", "k", "T w o", [], "active"),
                                   ("p3", "k", "Three", [], "deleted"), ("p4", "z", "Two", [], "active")],
                                  "id string, kb_id string, title string, links array<string>, status string")
    hits = spark.createDataFrame([(1, "p1", 1, "wiki"), (1, "raw1", 2, "raw")], "query_id int, document_id string, rank int, source_kind string")
    chunks = spark.createDataFrame([("p2", i, f"c{i}") for i in range(4)], "document_id string, chunk_index int, content string")
    out = context.expand_links(hits, pages, chunks).orderBy("position")
    assert rows(out, "document_id", "chunk_index", "score") == [("p2", 0, 0.0), ("p2", 1, 0.0)]


def test_chain_end_to_end(spark):
    embed = hashing_embedder()
    chunks = spark.createDataFrame([("a", 0, "the cat sat on the mat", "", "raw"), ("b", 0, "stock prices fell", "", "raw"),
                                    ("c", 0, "a page on cats", "", "wiki"), ("d", 0, "rain in spain", "", "raw"), ("e", 0, "green tea", "", "raw")],
                                   CHUNKS + ", source_kind string").withColumn("embedding", embed(F.col("content")))
    q = spark.createDataFrame([(1, "where is the cat"), (2, "zzz")], "query_id int, text string").withColumn("embedding", embed(F.col("text")))
    out = retrieve(q, chunks, RetrievalConfig(k=2)).collect()
    assert {r["query_id"] for r in out} == {1} and out[0]["document_id"] in {"a", "b", "d", "e"}
    assert "a" in {r["document_id"] for r in out} and "c" not in {r["document_id"] for r in out}


def test_table_refill_stays_in_budget(spark):
    row = lambda i: f"| a |\n| {i} |"
    chunks = spark.createDataFrame([("d", i, row(i), "") for i in range(6)], CHUNKS)
    base = spark.createDataFrame([(1, "d", 2, 1, row(2))], "query_id int, document_id string, chunk_index int, rank int, content string")
    out = context.table_refill(base, chunks, fusion.table_header(F.col("content")), budget_chars=4 * len(row(0)))
    assert rows(out.orderBy("position"), "chunk_index") == [(0,), (1,), (3,)]
