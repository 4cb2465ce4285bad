"""Operational queries: usage and cost, lists and statistics, reconciliation, retention, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave.functions.text import snippet
from docweave.operators import lifecycle, reconcile, usage
from docweave.plans.catalog import query

CALLS = """calls AS (SELECT ts, 'p' || (user_id % 3) AS provider_id, event_type AS model_id, 'task' || (user_id % 2) AS task,
  CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'CNY' END AS currency, value AS latency_ms, event_type <> 'error' AS success,
  json_extract(props, '$.k')::BIGINT AS k, event_id FROM events),
measures AS (SELECT ts::DATE AS usage_date, provider_id, model_id, task, currency AS cost_currency, ts, (NOT success)::BIGINT AS errors,
  CASE WHEN success THEN k ELSE 0 END AS input_tokens, CASE WHEN success THEN k * 2 ELSE 0 END AS output_tokens, latency_ms AS total_latency_ms,
  (success AND k % 5 <> 0)::BIGINT AS priced_calls, (success AND k % 5 = 0)::BIGINT AS unpriced_calls,
  CASE WHEN success AND k % 5 <> 0 THEN (k * 0.5 + k * 2 * 1.5) / 1000.0::DOUBLE ELSE 0 END AS estimated_cost,
  CASE WHEN NOT success THEN 'e' || event_id END AS last_error FROM calls),
daily AS (SELECT usage_date, provider_id, model_id, task, cost_currency, count(*) AS calls, sum(errors)::BIGINT AS errors, sum(input_tokens)::BIGINT AS input_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, sum(total_latency_ms) AS total_latency_ms, sum(priced_calls)::BIGINT AS priced_calls,
  sum(unpriced_calls)::BIGINT AS unpriced_calls, sum(estimated_cost) AS estimated_cost, coalesce(arg_max(last_error, ts) FILTER (WHERE last_error IS NOT NULL), '') AS last_error
  FROM measures GROUP BY 1, 2, 3, 4, 5)"""


def calls(t) -> DataFrame:
    """Events read as model calls: value is the latency, k the tokens, errors are failures."""
    k = F.get_json_object("props", "$.k").cast("long")
    price = lambda p: F.when(k % 5 == 0, F.lit(-1.0)).otherwise(F.lit(p))
    return t.events.select(
        "ts", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider_id"), F.col("event_type").alias("model_id"),
        F.concat(F.lit("task"), (F.col("user_id") % 2).cast("string")).alias("task"),
        F.when(F.col("user_id") % 2 == 0, "usd").otherwise("CNY").alias("currency"), F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"), k.alias("input_tokens"), (k * 2).alias("output_tokens"),
        price(0.5).alias("in_price"), price(1.5).alias("out_price"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


def daily(t) -> DataFrame:
    return usage.usage_daily(usage.usage_measures(calls(t)))


def _rounded(df: DataFrame) -> DataFrame:
    out = df.withColumns({c: F.round(c, 4) for c in ("total_latency_ms", "estimated_cost") if c in df.columns})
    return out.withColumn("usage_date", F.col("usage_date").cast("string")) if "usage_date" in df.columns else out


@query("usage_daily", f"""WITH {CALLS} SELECT * REPLACE (usage_date::VARCHAR AS usage_date, round(total_latency_ms, 4) AS total_latency_ms, round(estimated_cost, 4) AS estimated_cost) FROM daily""")
def usage_daily(t) -> DataFrame:
    """Calls, errors, tokens, latency and cost per day, provider, model, task and currency."""
    return _rounded(daily(t))


@query("usage_totals", f"""WITH {CALLS} SELECT provider_id, model_id, task, cost_currency, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(input_tokens)::BIGINT AS input_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, round(sum(total_latency_ms), 4) AS total_latency_ms, sum(priced_calls)::BIGINT AS priced_calls, sum(unpriced_calls)::BIGINT AS unpriced_calls,
  round(sum(estimated_cost), 4) AS estimated_cost FROM daily WHERE usage_date >= DATE '2024-01-14' - 6 GROUP BY 1, 2, 3, 4""")
def usage_totals(t) -> DataFrame:
    """Totals of the seven days up to 14 January 2024."""
    return _rounded(usage.usage_totals(daily(t), F.lit("2024-01-14").cast("date")))


@query("usage_cost", f"""WITH {CALLS} SELECT provider_id, model_id, task, cost_currency, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(input_tokens)::BIGINT AS input_tokens,
  sum(output_tokens)::BIGINT AS output_tokens, sum(priced_calls)::BIGINT AS priced_calls, sum(unpriced_calls)::BIGINT AS unpriced_calls,
  round(sum(estimated_cost), 4) AS estimated_cost, round(sum(total_latency_ms) / greatest(sum(calls), 1), 1) AS avg_latency_ms FROM daily GROUP BY 1, 2, 3, 4""")
def usage_cost(t) -> DataFrame:
    """Two halves of the ledger merged: sums, mean latency, cost; currencies apart."""
    d = daily(t)
    early = F.col("usage_date") < F.lit("2024-01-15").cast("date")
    return usage.merge_usage(d.filter(early), d.filter(~early)).withColumn("estimated_cost", F.round("estimated_cost", 4))


@query("usage_upsert", f"""WITH {CALLS} SELECT provider_id, cost_currency, count(*) AS rows_after, sum(calls)::BIGINT AS calls FROM daily GROUP BY 1, 2""")
def usage_upsert(t) -> DataFrame:
    """Ledger of the even events with the odd ones added on top."""
    c = calls(t)
    even = F.substring("error", 2, 20).cast("long") % 2 == 0
    stored, deltas = (usage.usage_daily(usage.usage_measures(c.filter(x))) for x in (even, ~even))
    return usage.upsert_usage(stored, deltas).groupBy("provider_id", "cost_currency").agg(
        F.count(F.lit(1)).alias("rows_after"), F.sum("calls").alias("calls"))


@query("usage_ledger", """SELECT l_returnflag AS model_id, l_linestatus AS task, year(o_orderdate)::INTEGER AS year, count(*) AS calls, sum(l_quantity) AS tokens,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def usage_ledger(t) -> DataFrame:
    """Quantities and cost per kind and year over the order lines."""
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"))
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    return lines.join(o, "l_orderkey").groupBy(F.col("l_returnflag").alias("model_id"), F.col("l_linestatus").alias("task"), "year").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("l_quantity").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"))


@query("feedback_stats", """SELECT event_type, count(*) AS total, count(*) FILTER (WHERE r >= 4) AS positive, count(*) FILTER (WHERE r <= 2) AS negative, round(avg(r), 2) AS average
FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT % 5 + 1 AS r FROM events) GROUP BY 1""")
def feedback_stats(t) -> DataFrame:
    """Ratings 1-5 read from the events."""
    rated = t.events.select("event_type", (F.get_json_object("props", "$.k").cast("long") % 5 + 1).alias("rating"))
    return usage.feedback_stats(rated, ["event_type"])


@query("badcase_stats", """SELECT CASE WHEN lang = 'de' THEN 'unknown' ELSE lang END AS category, count(*) AS cases, round(avg(n_chars % 5 + 1), 2) AS mean_severity FROM documents GROUP BY 1""")
def badcase_stats(t) -> DataFrame:
    cases = t.documents.select(F.when(F.col("lang") != "de", F.col("lang")).alias("category"), (F.col("n_chars") % 5 + 1).alias("severity"))
    return usage.badcase_stats(cases)


@query("exec_stats", """SELECT ts::DATE::VARCHAR AS day, count(*) AS total, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS kb_used, round(avg(value), 6) AS mean_confidence
FROM events GROUP BY GROUPING SETS ((1), ())""")
def exec_stats(t) -> DataFrame:
    """Executions per day and in all."""
    e = t.events.select(F.col("ts").alias("created_at"), F.col("event_type").isin("view", "click").alias("used_kb"), F.col("value").alias("confidence"))
    return usage.execution_stats(e).withColumn("day", F.col("day").cast("string"))


@query("exec_feedback", """WITH x AS (SELECT o_orderkey AS execution_id, o_orderdate AS created_at, l_linenumber AS feedback_id, l_quantity AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
p AS (SELECT * FROM x ORDER BY created_at DESC, execution_id DESC, feedback_id, value LIMIT 500)
SELECT execution_id, count(feedback_id) AS feedback, coalesce(string_agg(feedback_id || ':' || value::BIGINT, ',' ORDER BY feedback_id, value), '') AS listed FROM p GROUP BY 1""")
def exec_feedback(t) -> DataFrame:
    """Newest 500 order lines as feedback, gathered per order."""
    ex = t.orders.select(F.col("o_orderkey").alias("execution_id"), F.col("o_orderdate").alias("created_at"))
    fb = t.lineitem.select(F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").alias("feedback_id"), F.col("l_quantity").alias("value"))
    out = usage.executions_with_feedback(ex, fb, 500)
    text = F.transform("feedback", lambda f: F.concat(f["feedback_id"].cast("string"), F.lit(":"), f["value"].cast("long").cast("string")))
    return out.select("execution_id", F.size("feedback").cast("long").alias("feedback"), F.array_join(text, ",").alias("listed"))


@query("strategy_feedback", """SELECT count(*) AS total, round(avg(v), 6) AS average, count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v < 0) AS negative
FROM (SELECT l_quantity - 25 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 3)""")
def strategy_feedback(t) -> DataFrame:
    """Feedback on the executions of one group of owners."""
    ex = t.orders.select(F.col("o_orderkey").alias("execution_id"), "o_custkey")
    fb = t.lineitem.select(F.col("l_orderkey").alias("execution_id"), (F.col("l_quantity") - 25).alias("value"))
    return usage.strategy_feedback_stats(fb, ex, F.col("o_custkey") % 10 == 3)


@query("kb_counts", """SELECT c_custkey AS kb_id, c_name AS name, coalesce(n, 0) AS documents FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def kb_counts(t) -> DataFrame:
    """Every base (customer) with its number of documents (orders)."""
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, "c_custkey", "left").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).alias("documents"))


@query("doc_kb_join", """SELECT l_orderkey AS document_id, count(*) AS hits, c_name AS kb_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O' GROUP BY 1, 3""")
def doc_kb_join(t) -> DataFrame:
    """Hits (lines) of open documents (orders) with the name of their base (customer)."""
    docs = t.orders.filter(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    hits = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(docs, "l_orderkey").join(t.customer.select("c_custkey", "c_name"), "c_custkey", "left").select(
        F.col("l_orderkey").alias("document_id"), "hits", F.col("c_name").alias("kb_name"))


@query("document_list", """SELECT doc_id, source, CASE WHEN doc_id % 5 IN (0, 1) THEN 'archived' ELSE 'published' END AS status FROM documents WHERE doc_id % 5 NOT IN (0, 1) AND source = 'src3'""")
def document_list(t) -> DataFrame:
    """Active documents of one base."""
    docs = documents(t).filter(usage.document_status_filter("active") & (F.col("source") == "src3"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "status")


def documents(t) -> DataFrame:
    """Documents with a status, a base and a chunk count on record."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", F.col("source").alias("kb_id"),
        F.when(F.col("doc_id") % 5 < 2, "archived").otherwise("published").alias("status"),
        F.floor(F.col("n_chars") / 512).cast("long").alias("chunks_count"),
        F.element_at(F.array(*[F.lit(x) for x in ("pending", "uploading", "processing", "completed")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("processing_status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") % 2000).alias("updated_at"))


@query("snippets", """WITH d AS (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents)
SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN p > 31 THEN '...' ELSE '' END || substr(text, greatest(p - 30, 1), least(p + 33, length(text) + 1) - greatest(p - 30, 1))
  || CASE WHEN p + 33 <= length(text) THEN '...' ELSE '' END ELSE substr(text, 1, 500) END AS snippet FROM d""")
def snippets(t) -> DataFrame:
    """Text round the first place of a word in every document."""
    return t.documents.select("doc_id", snippet(F.col("text"), "the").alias("snippet"))


@query("trace_page", """SELECT event_id, user_id, event_type, value, (SELECT count(*) FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20') AS total
FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5""")
def trace_page(t) -> DataFrame:
    """Second page of one user's traces in a time range, with the total."""
    rows = usage.own_traces(t.events, 7, 1).filter((F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp")))
    return usage.with_total(rows, [F.col("ts").desc(), F.col("event_id").desc()], 20, 5).select("event_id", "user_id", "event_type", "value", "total")


@query("audit_page", """SELECT event_id, user_id, event_type AS action FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def audit_page(t) -> DataFrame:
    """Newest purchases up to a day."""
    log = t.events.select("event_id", "user_id", F.col("event_type").alias("action"), F.lit("x").alias("resource_type"), F.lit("y").alias("resource_id"), F.col("ts").alias("created_at"))
    rows = log.filter(usage.audit_filter(action="purchase", end="2024-01-10"))
    return usage.page(rows, [F.col("created_at").desc(), F.col("event_id").desc()], 50).select("event_id", "user_id", "action")


@query("session_search", """SELECT conv_id, count(*) AS hits FROM conversations WHERE role <> 'system' AND contains(lower(text), 'tion') GROUP BY 1""")
def session_search(t) -> DataFrame:
    """Conversations with a message that holds the keyword, any case."""
    cond = usage.session_filter(F.col("role") != "system", " TION ", ["text"])
    return t.conversations.filter(cond).groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"))


@query("question_inventory", """SELECT user_id % 10 AS question, count(*) AS n, max(event_type) AS mode FROM events GROUP BY 1""")
def question_inventory(t) -> DataFrame:
    return usage.question_inventory(t.events.select((F.col("user_id") % 10).alias("question"), F.col("event_type").alias("primary_mode")))


@query("category_counts", "SELECT lang AS category, count(*) AS documents FROM documents GROUP BY 1")
def category_counts(t) -> DataFrame:
    """Documents per category in use."""
    return t.documents.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("documents"))


@query("history_context", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations)
SELECT conv_id AS session_id, string_agg(CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' WHEN 'system' THEN '系统' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS history FROM n WHERE i <= 4 GROUP BY 1""")
def history_context(t) -> DataFrame:
    """Last four messages of every conversation as one text."""
    return usage.history_text(t.conversations.withColumnRenamed("conv_id", "session_id"), 4)


@query("session_markdown", """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id AS session_id, -1::BIGINT AS block, '# 未命名对话' || chr(10) || chr(10) || '- 会话 ID：' || conv_id || chr(10) || '- 创建时间：2024-01-01 00:00' || chr(10)
  || '- 最近活动：2024-01-01 00:00' || chr(10) || '- 消息数：' || n || chr(10) || chr(10) || '---' || chr(10) AS text FROM n
UNION ALL SELECT conv_id, turn, '**' || CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' WHEN 'system' THEN '系统' ELSE role END || '**（—）' || chr(10) || chr(10)
  || CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '_（空消息）_' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END || chr(10) || chr(10) || '---' || chr(10) FROM conversations""")
def session_markdown(t) -> DataFrame:
    """Every conversation as ordered Markdown blocks."""
    c = t.conversations
    day = F.lit("2024-01-01").cast("timestamp")
    sessions = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.lit("").alias("title")).withColumns({"created_at": day, "updated_at": day})
    messages = c.select(F.col("conv_id").alias("session_id"), "turn", "role", "text", F.lit(None).cast("timestamp").alias("stamp"),
                        F.array().cast("array<string>").alias("sources"))
    return usage.session_markdown(sessions, messages)


@query("recent_questions", """WITH s AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY last DESC, conv_id DESC LIMIT 10)
SELECT conv_id AS session_id, turn, text FROM conversations JOIN s USING (conv_id) WHERE role = 'user' ORDER BY last DESC, conv_id DESC, turn LIMIT 10""")
def recent_questions(t) -> DataFrame:
    """First ten user messages of the ten most active conversations."""
    m = t.conversations.withColumnRenamed("conv_id", "session_id")
    sessions = m.groupBy("session_id").agg(F.max("turn").alias("updated_at"))
    return usage.recent_questions(sessions, m)


# reconciliation -------------------------------------------------------------------------------

CHUNKS = """docs AS (SELECT doc_id::VARCHAR AS doc_id, source AS kb_id, CASE WHEN doc_id % 5 < 2 THEN 'archived' ELSE 'published' END AS status, n_chars // 512 AS chunks_count FROM documents),
chunks AS (SELECT CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS document_id, toxic AS chunk_index,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'memory' WHEN doc_id % 7 = 0 THEN 'src99' ELSE 'src' || (doc_id % 20) END AS kb_id,
  CASE WHEN doc_id % 19 = 0 THEN 'memory' ELSE 'raw' END AS source_kind FROM labels),
refs AS (SELECT document_id, arg_min(kb_id, (chunk_index, kb_id, source_kind)) AS kb_id, arg_min(source_kind, (chunk_index, kb_id, source_kind)) AS source_kind, count(*) AS chunks FROM chunks GROUP BY 1)"""


def chunk_rows(t) -> DataFrame:
    d = F.col("doc_id")
    return t.labels.select(
        F.when(d % 50 == 0, "").when(d % 17 == 0, F.concat(F.lit("x"), d.cast("string"))).otherwise(d.cast("string")).alias("document_id"),
        F.col("toxic").alias("chunk_index"),
        F.when(d % 13 == 0, "").when(d % 11 == 0, "memory").when(d % 7 == 0, "src99").otherwise(F.concat(F.lit("src"), (d % 20).cast("string"))).alias("kb_id"),
        F.when(d % 19 == 0, "memory").otherwise("raw").alias("source_kind"))


def known_bases(t) -> DataFrame:
    return t.documents.select(F.col("source").alias("kb_id")).distinct()


def no_pages(t) -> DataFrame:
    """Ids of compiled pages: every 34th label stands for one."""
    d = F.col("doc_id")
    return t.labels.filter(d % 34 == 0).select(F.concat(F.lit("x"), d.cast("string")).alias("id"))


@query("label_audit_orphan", f"""WITH {CHUNKS}, r AS (SELECT refs.*, status, docs.kb_id AS doc_kb, w.id IS NOT NULL AS wiki, k.kb_id IS NOT NULL AS kb_known FROM refs
  LEFT JOIN docs ON docs.doc_id = refs.document_id LEFT JOIN (SELECT 'x' || doc_id AS id FROM labels WHERE doc_id % 34 = 0) w ON w.id = refs.document_id
  LEFT JOIN (SELECT DISTINCT source AS kb_id FROM documents) k ON k.kb_id = refs.kb_id WHERE refs.source_kind <> 'memory' AND refs.kb_id <> 'memory')
SELECT 'orphan_vector_doc' AS kind, '<empty>' AS subject FROM r WHERE document_id = ''
UNION ALL SELECT 'vector_for_unpublished_doc', document_id FROM r WHERE document_id <> '' AND status <> 'published'
UNION ALL SELECT 'vector_kb_mismatch', document_id FROM r WHERE document_id <> '' AND status IS NOT NULL AND kb_id <> '' AND doc_kb <> kb_id
UNION ALL SELECT 'orphan_vector_doc', document_id FROM r WHERE document_id <> '' AND status IS NULL AND NOT wiki
UNION ALL SELECT 'vector_kb_blank', document_id FROM r WHERE document_id <> '' AND kb_id = ''
UNION ALL SELECT 'vector_kb_missing', document_id FROM r WHERE document_id <> '' AND kb_id <> '' AND NOT kb_known""")
def label_audit_orphan(t) -> DataFrame:
    """Chunks (labels) that do not fit the documents."""
    return reconcile.classify_vectors(reconcile.chunk_refs(chunk_rows(t)), documents(t), no_pages(t), known_bases(t)).select("kind", "subject")


@query("label_audit_missing", f"""WITH {CHUNKS} SELECT 'missing_vectors' AS kind, doc_id AS subject FROM docs WHERE status = 'published' AND chunks_count > 0 AND doc_id NOT IN (SELECT document_id FROM refs)""")
def label_audit_missing(t) -> DataFrame:
    """Published documents without a chunk (label)."""
    return reconcile.missing_vectors(reconcile.chunk_refs(chunk_rows(t)), documents(t)).select("kind", "subject")


@query("object_diff", """WITH a AS (SELECT 'parts/' || p_partkey AS key FROM part WHERE p_size < 40), b AS (SELECT DISTINCT 'parts/' || l_partkey AS key FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')
SELECT CASE WHEN b.key IS NULL THEN 'orphan_object' ELSE 'missing_object' END AS kind, coalesce(a.key, b.key) AS subject FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL""")
def object_diff(t) -> DataFrame:
    """Stored objects (parts) against the references to them (order lines)."""
    keys = t.part.filter(F.col("p_size") < 40).select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("key"))
    paths = t.lineitem.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select(
        reconcile.object_key(F.concat(F.lit("minio://docs/parts/"), F.col("l_partkey").cast("string")), "docs").alias("key"))
    return reconcile.classify_objects(keys, paths).select("kind", "subject")


ENTRIES = """entries AS (SELECT event_id AS entry_id, 'u' || user_id % 20 AS scope_key, ts AS created_at, value, CASE WHEN user_id % 10 = 0 THEN 'all' ELSE 'src' || user_id % 25 END AS kb,
  (json_extract(props, '$.k')::BIGINT * 3 + user_id)::VARCHAR AS doc_id, CASE WHEN user_id % 6 = 0 THEN 'wiki' WHEN user_id % 7 = 0 THEN 'memory' ELSE 'raw' END AS kind, event_type FROM events)"""


def cache_entries(t) -> DataFrame:
    """Events read as cached answers with one cited source each."""
    u = F.col("user_id")
    doc = (F.get_json_object("props", "$.k").cast("long") * 3 + u).cast("string")
    kind = F.when(u % 6 == 0, "wiki").when(u % 7 == 0, "memory").otherwise("raw")
    return t.events.select(
        F.col("event_id").alias("entry_id"), F.concat(F.lit("u"), (u % 20).cast("string")).alias("scope_key"), F.col("event_type").alias("question"),
        F.col("ts").alias("created_at"), "value", F.array(F.when(u % 10 == 0, "all").otherwise(F.concat(F.lit("src"), (u % 25).cast("string")))).alias("kb_ids"),
        F.array(F.struct(doc.alias("document_id"), F.lit("kb").alias("source_type"), kind.alias("source_kind"))).alias("sources"))


NOW = "2024-01-20 12:00:00"


@query("cache_findings", f"""WITH {CHUNKS}, {ENTRIES}, w AS (SELECT 'x' || doc_id AS id FROM labels WHERE doc_id % 34 = 0)
SELECT 'expired_cache_entry' AS kind, entry_id AS subject FROM entries WHERE epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(created_at))::BIGINT > 86400
UNION ALL SELECT 'stale_cache_entry', entry_id FROM entries WHERE kind = 'raw' AND doc_id NOT IN (SELECT doc_id FROM docs WHERE status = 'published') OR kind = 'wiki' AND doc_id NOT IN (SELECT id FROM w)
UNION ALL SELECT 'stale_cache_kb', entry_id FROM entries WHERE kb <> 'all' AND kb NOT IN (SELECT source FROM documents)""")
def cache_findings(t) -> DataFrame:
    """Cached answers that are too old, cite dead sources or unknown bases."""
    out = reconcile.classify_cache(cache_entries(t), documents(t), no_pages(t), known_bases(t), 86400, F.lit(NOW).cast("timestamp"))
    return out.select("kind", "subject")


@query("audit_report", f"""WITH {CHUNKS}, a AS (SELECT 'objects' AS section, CASE WHEN b.key IS NULL THEN 'orphan_object' ELSE 'missing_object' END AS kind, coalesce(a.key, b.key) AS subject
  FROM (SELECT 'parts/' || p_partkey AS key FROM part WHERE p_size < 40) a FULL JOIN (SELECT DISTINCT 'parts/' || l_partkey AS key FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') b ON a.key = b.key
  WHERE a.key IS NULL OR b.key IS NULL UNION ALL SELECT 'vectors', 'missing_vectors', doc_id FROM docs WHERE status = 'published' AND chunks_count > 0 AND doc_id NOT IN (SELECT document_id FROM refs)),
n AS (SELECT *, row_number() OVER (PARTITION BY section, kind ORDER BY subject) AS i FROM a)
SELECT section, kind, count(*) AS count, string_agg(subject, ',' ORDER BY subject) FILTER (WHERE i <= 5) AS samples FROM n GROUP BY 1, 2""")
def audit_report(t) -> DataFrame:
    """Counts and first subjects per kind over two sections."""
    keys = t.part.filter(F.col("p_size") < 40).select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("key"))
    paths = t.lineitem.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select(F.concat(F.lit("parts/"), F.col("l_partkey").cast("string")).alias("key"))
    objects = reconcile.classify_objects(keys, paths).withColumn("section", F.lit("objects"))
    vectors = reconcile.missing_vectors(reconcile.chunk_refs(chunk_rows(t)), documents(t)).withColumn("section", F.lit("vectors"))
    return reconcile.report(objects.unionByName(vectors)).withColumn("samples", F.array_join("samples", ","))


@query("dangling_members", """SELECT DISTINCT 'dangling_index_member' AS kind, 'c' || c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def dangling_members(t) -> DataFrame:
    """Scopes in the index (customers) without an entry (urgent order)."""
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("scope_key")
    index = t.customer.select(key("c_custkey"), F.col("c_nationkey").alias("kb_id"))
    return reconcile.dangling_members(index, t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(key("o_custkey"))).select("kind", "subject")


# life cycle -----------------------------------------------------------------------------------

@query("retention", """SELECT 'events' AS "table", count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS) AS kept, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS) AS deleted FROM events
UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10000 DAYS), count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10000 DAYS) FROM orders""")
def retention(t) -> DataFrame:
    """Rows kept and deleted per table under its retention."""
    return lifecycle.retention_counts({"events": (t.events, "ts", 7), "orders": (t.orders, "o_orderdate", 10000)}, F.lit(NOW).cast("timestamp"))


@query("stale_processing", """SELECT (doc_id)::VARCHAR AS doc_id, CASE WHEN doc_id % 4 IN (1, 2) AND 1704069000 - (1704067200 + n_chars % 2000) > 900 THEN 'failed' ELSE ['pending','uploading','processing','completed'][doc_id % 4 + 1] END AS processing_status,
  doc_id % 4 IN (1, 2) AND 1704069000 - (1704067200 + n_chars % 2000) > 900 AS recovered FROM documents""")
def stale_processing(t) -> DataFrame:
    """Documents stuck in processing for 15 minutes at 00:30."""
    return lifecycle.recover_stale(documents(t), F.lit("2024-01-01 00:30:00").cast("timestamp")).select("doc_id", "processing_status", "recovered")


@query("status_changes", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'archived' ELSE 'published' END AS status, ['pending','uploading','processing','completed'][doc_id % 4 + 1] AS ps,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'published' ELSE 'draft' END END AS n FROM documents),
a AS (SELECT *, CASE WHEN n IS NULL OR n = status THEN 'none' WHEN ps <> 'completed' THEN 'rejected' WHEN status = 'published' AND n <> 'published' THEN 'drop_chunks'
  WHEN status <> 'published' AND n = 'published' THEN 'reindex' ELSE 'none' END AS action FROM d)
SELECT action, CASE WHEN n IS NOT NULL AND action <> 'rejected' THEN n ELSE status END AS status, count(*) AS documents FROM a GROUP BY 1, 2""")
def status_changes(t) -> DataFrame:
    """Wanted publication changes and what follows from each."""
    d = F.col("doc_id")
    changes = t.documents.filter(d % 3 == 0).select(d.cast("string").alias("doc_id"), F.when(d % 2 == 0, "published").otherwise("draft").alias("new_status"))
    return lifecycle.change_status(documents(t), changes).groupBy("action", "status").agg(F.count(F.lit(1)).alias("documents"))


@query("live_entries", f"""WITH {CHUNKS}, {ENTRIES}, w AS (SELECT 'x' || doc_id AS id FROM labels WHERE doc_id % 34 = 0)
SELECT e.entry_id, CASE WHEN kind = 'wiki' THEN doc_id IN (SELECT id FROM w) ELSE coalesce((SELECT bool_or(kb = 'all' OR d.kb_id = kb) FROM docs d WHERE d.doc_id = e.doc_id AND d.status = 'published'), FALSE) END AS alive FROM entries e""")
def live_entries(t) -> DataFrame:
    """Whether every cached answer still rests on live sources in its scope."""
    pages = no_pages(t).withColumn("status", F.lit("active"))
    return lifecycle.live_entries(cache_entries(t), documents(t), pages).select("entry_id", "alive")


@query("cache_trim", f"""WITH {ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY created_at DESC, entry_id DESC) AS i FROM entries WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAYS)
SELECT scope_key, entry_id FROM n WHERE i <= 40""")
def cache_trim(t) -> DataFrame:
    """Newest 40 live entries of every scope."""
    return lifecycle.trim_cache(cache_entries(t), F.lit(NOW).cast("timestamp"), 10 * 86400, 40).select("scope_key", "entry_id")


@query("cache_invalidate", f"""WITH {ENTRIES} SELECT kb, count(*) AS entries FROM entries WHERE kb NOT IN ('src1', 'src4', 'src9', 'all') GROUP BY 1""")
def cache_invalidate(t) -> DataFrame:
    """Entries left after three bases changed."""
    left = lifecycle.invalidate_bases(cache_entries(t), ["src1", "src4", "src9"])
    return left.groupBy(F.get("kb_ids", 0).alias("kb")).agg(F.count(F.lit(1)).alias("entries"))


@query("cache_lookup", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 2 = 0), s AS (SELECT * FROM v WHERE vec_id % 2 = 1 OR vec_id % 10 = 0),
x AS (SELECT q.vec_id AS query_id, min(s.vec_id) AS entry_id FROM q JOIN s ON q.label = s.label AND q.vec_id = s.vec_id GROUP BY 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS i FROM s) WHERE i <= 200),
c AS (SELECT q.vec_id AS query_id, r.vec_id AS entry_id, list_cosine_similarity(q.e, r.e) AS score FROM q JOIN r USING (label) WHERE q.vec_id NOT IN (SELECT query_id FROM x)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entry_id) AS i FROM c WHERE score >= 0.1)
SELECT query_id, entry_id, 1.0::DOUBLE AS score, 'exact' AS match FROM x UNION ALL SELECT query_id, entry_id, round(score, 6), 'semantic' FROM b WHERE i = 1""")
def cache_lookup(t) -> DataFrame:
    """Even vectors looked up among the odd ones of their class, exact questions first."""
    e = t.embeddings.select("vec_id", F.col("label").cast("string").alias("scope_key"), F.col("vec_id").cast("string").alias("question_norm"), "embedding")
    asked = e.filter(F.col("vec_id") % 2 == 0).withColumnRenamed("vec_id", "query_id")
    stored = e.filter((F.col("vec_id") % 2 == 1) | (F.col("vec_id") % 10 == 0)).withColumn("entry_id", F.col("vec_id")).withColumn(
        "created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id")))
    out = lifecycle.cache_lookup(asked, stored, F.lit("2024-01-01 12:00:00").cast("timestamp"), 0.1)
    return out.withColumn("score", F.round("score", 6))


@query("cascade_documents", """WITH rows AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS doc_id, l_partkey % 7 = 0 AS gone FROM lineitem),
a AS (SELECT id, count(*) FILTER (WHERE gone) AS removed, coalesce(string_agg(doc_id, ',' ORDER BY pos, doc_id::VARCHAR) FILTER (WHERE NOT gone), '') AS left_ids FROM rows GROUP BY 1)
SELECT id, removed, left_ids, CASE WHEN left_ids = '' THEN 'delete' ELSE 'rewrite' END AS action FROM a WHERE removed > 0""")
def cascade_documents(t) -> DataFrame:
    """Pages (orders) after the documents (parts) they were compiled from are deleted."""
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p")))), lambda x: x["p"]).alias("source_doc_ids"))
    gone = t.part.filter(F.col("p_partkey") % 7 == 0).select(F.col("p_partkey").cast("string").alias("doc_id"))
    return lifecycle.cascade_documents(pages, gone).select("id", "removed", F.array_join("source_doc_ids", ",").alias("left_ids"), "action")


@query("owner_delete", """WITH g AS (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g))
SELECT 'customer' AS "table", count(*) AS deleted FROM g UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'orders', count(*) FROM o""")
def owner_delete(t) -> DataFrame:
    """Rows that go with the owners of one region: feedback by its execution, then the rest by owner."""
    gone = t.customer.join(F.broadcast(t.nation.filter(F.col("n_regionkey") == 2)), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    orders = t.orders.join(gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    _, lines = lifecycle.delete_where({"lineitem": t.lineitem}, {"lineitem": "l_orderkey"}, orders, "o_orderkey")
    _, own = lifecycle.delete_where({"orders": t.orders, "customer": t.customer}, {"orders": "o_custkey", "customer": "c_custkey"}, gone, "c_custkey")
    return lines.unionByName(own)


@query("session_delete", """WITH g AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 1) SELECT conv_id % 4 AS part, count(*) AS messages FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM g) GROUP BY 1""")
def session_delete(t) -> DataFrame:
    """Messages left after a batch of sessions is deleted."""
    gone = t.conversations.filter(F.col("conv_id") % 4 == 1).select("conv_id").distinct()
    left, _ = lifecycle.delete_where({"messages": t.conversations}, {"messages": "conv_id"}, gone, "conv_id")
    return left["messages"].groupBy((F.col("conv_id") % 4).alias("part")).agg(F.count(F.lit(1)).alias("messages"))


@query("memory_ids", """WITH h AS (SELECT conv_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('agent-memory:' || conv_id)) AS h FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS memory_id FROM h""")
def memory_ids(t) -> DataFrame:
    """Memory document id of every conversation."""
    return t.conversations.select("conv_id").distinct().select("conv_id", lifecycle.memory_document_id(F.col("conv_id")).alias("memory_id"))


@query("single_default", """SELECT c_custkey AS kb_id, CASE WHEN m IS NULL THEN c_custkey % 9 = 0 ELSE c_custkey = m END AS is_default
FROM customer LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS m FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) USING (c_nationkey)""")
def single_default(t) -> DataFrame:
    """One default base per owner after some owners chose one."""
    kbs = t.customer.select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("kb_id"), (F.col("c_custkey") % 9 == 0).alias("is_default"))
    chosen = kbs.filter(F.col("owner_id") % 2 == 0).groupBy("owner_id").agg(F.min("kb_id").alias("kb_id"))
    return lifecycle.single_default(kbs, chosen).select("kb_id", "is_default")


@query("page_upsert", """WITH st AS (SELECT c_custkey AS t, c_name AS content, c_nationkey AS src FROM customer), fr AS (SELECT s_suppkey * 2 AS t, s_name AS content, s_nationkey AS src FROM supplier)
SELECT coalesce(st.t, fr.t)::VARCHAR AS title, coalesce(fr.content, st.content) AS content, CASE WHEN fr.t IS NOT NULL AND st.t IS NOT NULL THEN 2 ELSE 1 END AS revision,
  CASE WHEN fr.t IS NOT NULL AND st.t IS NOT NULL AND st.src <> fr.src THEN 2 ELSE 1 END AS n_sources,
  CASE WHEN fr.t IS NOT NULL AND st.t IS NOT NULL THEN 'updated' WHEN fr.t IS NOT NULL THEN 'created' ELSE 'kept' END AS change FROM st FULL JOIN fr ON st.t = fr.t""")
def page_upsert(t) -> DataFrame:
    """Stored pages (customers) after compiled ones (suppliers) are merged in."""
    title = lambda c: F.col(c).cast("string").alias("title")
    src = lambda c: F.array(F.col(c).cast("string")).alias("source_doc_ids")
    stored = t.customer.select(F.lit("kb").alias("kb_id"), F.lit("entity").alias("page_type"), title("c_custkey"), F.col("c_name").alias("content"), src("c_nationkey"), F.lit(1).alias("revision"))
    new = t.supplier.select(F.lit("kb").alias("kb_id"), F.lit("entity").alias("page_type"), (F.col("s_suppkey") * 2).cast("string").alias("title"), F.col("s_name").alias("content"), src("s_nationkey"))
    return lifecycle.upsert_pages(stored, new).select("title", "content", "revision", F.size("source_doc_ids").alias("n_sources"), "change")


@query("experiment_delete", """SELECT s_suppkey AS experiment_id, c_custkey IS NOT NULL AS deleted, CASE WHEN c_custkey IS NULL THEN 'not found' END AS reason FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20""")
def experiment_delete(t) -> DataFrame:
    """Ids asked to be deleted, with the reason where there is nothing to delete."""
    asked = t.supplier.select((F.col("s_suppkey") * 20).alias("experiment_id"))
    out = lifecycle.delete_experiments(asked, t.customer.select(F.col("c_custkey").alias("experiment_id")))
    return out.withColumn("experiment_id", (F.col("experiment_id") / 20).cast("long"))


@query("worth_keeping", """WITH x AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS docs, bool_or(l_returnflag = 'R') AS wiki FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus IN ('O', 'F') AND o_totalprice >= 200 AND o_orderpriority <> '1-URGENT' AND (coalesce(docs, 0) >= 2 OR coalesce(wiki, FALSE)) AS keep FROM orders LEFT JOIN x ON l_orderkey = o_orderkey""")
def worth_keeping(t) -> DataFrame:
    """Answers (orders) worth a page of their own: kind, length, and sources (lines)."""
    src = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(
        F.col("l_partkey").cast("string").alias("document_id"), F.when(F.col("l_returnflag") == "R", "wiki").otherwise("raw").alias("source_kind"))).alias("sources"))
    kind = F.when(F.col("o_orderstatus") == "O", "knowledge_base").when(F.col("o_orderstatus") == "F", "hybrid_search").otherwise("web")
    answer = F.when(F.col("o_totalprice") >= 200, F.repeat(F.lit("a"), 200)).otherwise("a")
    none = F.filter(F.array(F.struct(F.lit("").alias("document_id"), F.lit("").alias("source_kind"))), lambda s: F.lit(False))
    j = t.orders.join(src, "o_orderkey", "left")
    return j.select("o_orderkey", lifecycle.worth_keeping(kind, answer, F.coalesce("sources", none), F.col("o_orderpriority") == "1-URGENT").alias("keep"))


def _pages_sql(rows: str, owner: str, skip: int, limit: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY ts DESC, id) AS place FROM ({rows}) WHERE {owner} IS NOT NULL) WHERE place > {skip} AND place <= {skip + limit}"""


@query("feedback_pages", _pages_sql("SELECT event_id AS id, user_id AS owner_id, ts, event_id % 40 AS session_id FROM events WHERE event_type = 'click'", "owner_id", 3, 5))
def feedback_pages(t) -> DataFrame:
    """Second page of the ratings of every user."""
    rows = t.events.filter(F.col("event_type") == "click").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), "ts", (F.col("event_id") % 40).alias("session_id"))
    return usage.owner_pages(rows, "owner_id", "ts", "id", {"session_id": None}, 3, 5).withColumn("place", F.col("place").cast("long"))


@query("badcase_pages", _pages_sql("SELECT event_id AS id, user_id, ts, 'c' || (event_id % 3) AS category FROM events WHERE event_type = 'error' AND event_id % 3 = 1", "user_id", 0, 4))
def badcase_pages(t) -> DataFrame:
    """First page of every user's bad cases of one category."""
    rows = t.events.filter(F.col("event_type") == "error").select(F.col("event_id").alias("id"), "user_id", "ts", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("category"))
    return usage.owner_pages(rows, "user_id", "ts", "id", {"category": "c1", "feedback_type": None}, 0, 4).withColumn("place", F.col("place").cast("long"))


@query("experiment_pages", _pages_sql("SELECT o_orderkey AS id, o_custkey AS owner_id, o_orderdate AS ts, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O'", "owner_id", 0, 3))
def experiment_pages(t) -> DataFrame:
    """Newest running experiments (open orders) of every owner."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"))
    return usage.owner_pages(rows, "owner_id", "ts", "id", {"status": "O"}, 0, 3).withColumn("place", F.col("place").cast("long"))
