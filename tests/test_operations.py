import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from docweave.operators import lifecycle as lc, reconcile, usage

CALL = ("ts timestamp, provider_id string, model_id string, task string, currency string, latency_ms double, success boolean, "
        "input_tokens int, output_tokens int, in_price double, out_price double, error string")
T0 = dt.datetime(2024, 1, 2, 3, 4, 5)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_usage_prices_failures_and_currencies(spark):
    calls = spark.createDataFrame([
        (T0, "p", "m", "t", "usd", 10.0, True, 1000, 500, 0.5, 1.0, None),
        (T0, "p", "m", "t", "USD", 10.0, True, 1000, 500, None, None, None),
        (T0, "p", "m", "t", "USD", 10.0, True, 1000, 500, -1.0, None, None),
        (T0, "p", "m", "t", "USD", 10.0, True, 1000, 500, 0.0, None, None),
        (T0, "p", "m", "t", "USD", 30.0, False, 9, 9, 0.5, 1.0, "boom"),
        (T0, None, "m", "", "EUR", -5.0, True, 1, 1, 1.0, None, None)], CALL)
    d = usage.usage_daily(usage.usage_measures(calls))
    usd = d.filter("cost_currency = 'USD'").first()
    assert (usd["calls"], usd["errors"], usd["priced_calls"], usd["unpriced_calls"]) == (5, 1, 2, 2)
    assert usd["input_tokens"] == 4000 and usd["estimated_cost"] == pytest.approx(1.0) and usd["last_error"] == "boom"
    eur = d.filter("cost_currency = 'EUR'").first()
    assert (eur["provider_id"], eur["task"], eur["total_latency_ms"]) == ("unknown", "unknown", 0.0)
    merged = usage.merge_usage(d, d)
    assert rows(merged.filter("cost_currency = 'USD'"), "calls", "avg_latency_ms") == [(10, 14.0)]
    again = usage.upsert_usage(d, d.withColumn("last_error", F.lit("")))
    assert rows(again.filter("cost_currency = 'USD'"), "calls", "last_error") == [(10, "boom")]


def test_reconcile_edges(spark):
    chunks = spark.createDataFrame([
        ("d1", 0, "k1", "raw"), ("d1", 1, "k1", "raw"), ("d2", 0, "k2", "raw"), ("", 0, "k1", "raw"), ("gone", 0, "k1", "raw"), ("w1", 0, "k1", "wiki"),
        ("mem", 0, "memory", ""), ("mem2", 0, "k1", "memory"), ("d3", 0, "", "raw"), ("d4", 0, "k9", "raw")], "document_id string, chunk_index int, kb_id string, source_kind string")
    docs = spark.createDataFrame([("d1", "published", "k1", 2), ("d2", "draft", "k1", 1), ("d3", "published", "k1", 1), ("d4", "published", "k9", 1),
                                  ("d5", "published", "k1", 3), ("d6", "published", "k1", 0), ("d7", "archived", "k1", 3)],
                                 "doc_id string, status string, kb_id string, chunks_count int")
    wiki = spark.createDataFrame([("w1",)], "id string")
    kbs = spark.createDataFrame([("k1",), ("k2",)], "kb_id string")
    refs = reconcile.chunk_refs(chunks)
    got = set(rows(reconcile.classify_vectors(refs, docs, wiki, kbs), "kind", "subject"))
    assert got == {("orphan_vector_doc", "<empty>"), ("orphan_vector_doc", "gone"), ("vector_for_unpublished_doc", "d2"), ("vector_kb_mismatch", "d2"),
                   ("vector_kb_blank", "d3"), ("vector_kb_missing", "d4")}
    assert rows(reconcile.missing_vectors(refs, docs), "subject") == [("d5",)]
    key = spark.createDataFrame([("minio://docs/a/b.pdf",), ("minio://other/a",), ("/tmp/x",), ("minio://docs/",), (None,)], "p string")
    assert [r[0] for r in key.select(reconcile.object_key(F.col("p"), "docs")).collect()] == ["a/b.pdf", None, None, None, None]
    findings = reconcile.classify_vectors(refs, docs, wiki, kbs).withColumn("section", F.lit("v"))
    rep = reconcile.report(findings, samples=1)
    assert {r["kind"]: (r["count"], r["samples"]) for r in rep.collect()}["orphan_vector_doc"] == (2, ["<empty>"])
    assert reconcile.exit_code(rep, []) == 1 and reconcile.exit_code(rep, ["v"]) == 2 and reconcile.exit_code(rep.limit(0), []) == 0


ENTRY = "entry_id string, question string, created_at timestamp, kb_ids array<string>, sources array<struct<document_id:string,source_type:string,source_kind:string>>"


def test_cache_checks(spark):
    now = F.lit("2024-01-03 03:04:05").cast("timestamp")
    docs = spark.createDataFrame([("d1", "published", "k1"), ("d2", "draft", "k1")], "doc_id string, status string, kb_id string")
    pages = spark.createDataFrame([("w1", "active"), ("w2", "deleted")], "id string, status string")
    entries = spark.createDataFrame([
        ("at_limit", "q", T0, ["k1"], [("d1", "kb", "raw")]), ("old", "q", T0 - dt.timedelta(seconds=1), ["all"], [("d2", "kb", "raw")]),
        ("wiki", "q", T0, ["k1"], [("w1", "kb", "wiki"), ("w2", "kb", "wiki")]), ("web", "q", T0, ["k9"], [("zz", "web", None), (None, "kb", None)]),
        ("scope", "q", T0, ["k2"], [("d1", "kb", "raw")]), ("none", "q", T0, [], [])], ENTRY)
    found = reconcile.classify_cache(entries, docs, pages.select("id"), spark.createDataFrame([("k1",), ("k2",)], "kb_id string"), 86400, now)
    assert set(rows(found, "kind", "subject")) == {("expired_cache_entry", "old"), ("stale_cache_entry", "old"), ("stale_cache_entry", "web"), ("stale_cache_kb", "web")}
    alive = dict(rows(lc.live_entries(entries, docs, pages), "entry_id", "alive"))
    assert alive == {"at_limit": True, "old": False, "wiki": False, "web": True, "scope": False, "none": True}
    kept = lc.trim_cache(entries.withColumn("scope_key", F.lit("s")), now, 86400, keep=2)
    assert {r["entry_id"] for r in kept.collect()} == {"wiki", "web"}
    left = lc.invalidate_bases(entries, ["k1"])
    assert {r["entry_id"] for r in left.collect()} == {"web", "scope", "none"}
    same = lc.invalidate_bases(entries, spark.createDataFrame([("k1",)], "kb_id string"))
    assert {r["entry_id"] for r in same.collect()} == {"web", "scope", "none"}


def test_cache_lookup_exact_before_semantic(spark):
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    e = "entry_id long, scope_key string, question_norm string, embedding array<float>, created_at timestamp"
    entries = spark.createDataFrame([(1, "s", "hello", [0.0, 1.0], T0), (2, "s", "x", [1.0, 0.0], T0), (3, "s", "y", [1.0, 0.1], T0), (4, "o", "hi", [1.0, 0.0], T0)], e)
    q = spark.createDataFrame([(1, "s", "hello", [1.0, 0.0]), (2, "s", "new", [1.0, 0.0]), (3, "s", "far", [-1.0, 0.0])], "query_id int, scope_key string, question_norm string, embedding array<float>")
    got = {r["query_id"]: (r["entry_id"], r["match"]) for r in lc.cache_lookup(q, entries, now).collect()}
    assert got == {1: (1, "exact"), 2: (2, "semantic")}


def test_cascade_status_defaults_and_ids(spark):
    pages = spark.createDataFrame([("p", ["a", "b", "c"]), ("q", ["a"]), ("r", ["c"])], "id string, source_doc_ids array<string>")
    gone = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    out = {r["id"]: (r["source_doc_ids"], r["action"]) for r in lc.cascade_documents(pages, gone).collect()}
    assert out == {"p": (["c"], "rewrite"), "q": ([], "delete")}
    docs = spark.createDataFrame([("a", "published", "completed", 5), ("b", "draft", "completed", 0), ("c", "published", "processing", 5), ("d", "published", "completed", 5)],
                                 "doc_id string, status string, processing_status string, chunks_count int")
    ch = spark.createDataFrame([("a", "draft"), ("b", "published"), ("c", "draft")], "doc_id string, new_status string")
    assert {r["doc_id"]: (r["action"], r["status"], r["chunks_count"]) for r in lc.change_status(docs, ch).collect()} == {
        "a": ("drop_chunks", "draft", 0), "b": ("reindex", "published", 0), "c": ("rejected", "published", 5), "d": ("none", "published", 5)}
    ids = spark.createDataFrame([("abc",), ("会话",)], "s string")
    want = [str(uuid.uuid5(uuid.NAMESPACE_URL, "agent-memory:" + s)) for s in ("abc", "会话")]
    assert [r[0] for r in ids.select(lc.memory_document_id(F.col("s"))).collect()] == want
    stored = spark.createDataFrame([("k", "entity", "A", "old", ["1"], 3)], "kb_id string, page_type string, title string, content string, source_doc_ids array<string>, revision int")
    new = spark.createDataFrame([("k", "entity", "A", "new", ["2", "1"]), ("k", "entity", "B", "b", ["3"])], "kb_id string, page_type string, title string, content string, source_doc_ids array<string>")
    assert {r["title"]: (r["content"], r["source_doc_ids"], r["revision"], r["change"]) for r in lc.upsert_pages(stored, new).collect()} == {
        "A": ("new", ["1", "2"], 4, "updated"), "B": ("b", ["3"], 1, "created")}


def test_session_search_escapes_and_day_range(spark):
    s = spark.createDataFrame([(1, "100% done", "x", ["k"], dt.datetime(2024, 1, 2, 23, 59, 59)), (2, "100 done", "y", ["k"], dt.datetime(2024, 1, 3)), (3, "a_b", "50%", [], T0)],
                              "id int, title string, messages string, kb_ids array<string>, updated_at timestamp")
    hit = lambda **k: sorted(r["id"] for r in s.filter(usage.session_filter(F.lit(True), texts=["title", "messages"], **k)).collect())
    assert hit(keyword="0%") == [1, 3] and hit(keyword="A_B") == [3] and hit(keyword="  ") == [1, 2, 3]
    assert hit(kb_id="k", date_from="2024-01-02", date_to="2024-01-02") == [1]


def test_session_export(spark):
    sessions = spark.createDataFrame([(1, " ", T0, T0), (2, "T", T0, T0)], "session_id int, title string, created_at timestamp, updated_at timestamp")
    messages = spark.createDataFrame([(2, 0, "user", " hi ", T0, None), (2, 1, "assistant", "", T0, ["a\n b", "", "x" * 300])],
                                     "session_id int, turn int, role string, text string, stamp timestamp, sources array<string>")
    got = {(r["session_id"], r["block"]): r["text"] for r in usage.session_markdown(sessions, messages).collect()}
    assert "未命名对话" in got[1, -1] and "还没有消息" in got[1, -1] and "- 消息数：2" in got[2, -1]
    assert got[2, 0].startswith("**用户**（2024-01-02 03:04）\n\nhi\n")
    assert "_（空消息）_" in got[2, 1] and "> 1. a b\n> 2. " + "x" * 199 + "…" in got[2, 1]
    names = spark.createDataFrame([("a/b:c", 1), ("", 12345678901)], "t string, id long")
    assert [r[0] for r in names.select(usage.export_file_name(F.col("t"), F.col("id"))).collect()] == ["abc.md", "session-12345678.md"]


def test_limit_counts_joined_rows(spark):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "execution_id int, created_at timestamp")
    f = spark.createDataFrame([(2, i, 1.0) for i in range(3)], "execution_id int, feedback_id int, value double")
    got = {r["execution_id"]: len(r["feedback"]) for r in usage.executions_with_feedback(e, f, 2).collect()}
    assert got == {2: 2}
