"""Queries over questions, answers and traces: routing, history, citations, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.functions import numbers, routing, rules, strategies
from docweave.operators import answers, lifecycle, usage
from docweave.plans.catalog import query
from docweave.plans.evaluation import question_answers, PAIRS
from docweave.plans.retrieve import hashing_embedder


def _alt(words: list[str]) -> str:
    import re

    return "|".join(re.escape(w) for w in words)


def questions(t) -> DataFrame:
    return t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", "text")


FLAGS = f"""q AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, turn, regexp_matches(replace(low, '对比', ''), '{_alt(routing.REALTIME)}') AS realtime,
  regexp_matches(text, '[0-9０-９]') AND regexp_matches(text, '{_alt(routing.OPERATORS)}|{_alt(routing.CALCULATE)}') AS calculation,
  regexp_matches(text, '{_alt(routing.BASE_PREFERRED)}') AS kb_preferred,
  regexp_matches(low, '[0-9]*\\s*[a-z]{{3}}\\s*(?:to|兑|兑换|换算成|等于|换|转)\\s*[a-z]{{3}}|{_alt(routing.EXCHANGE)}') AS exchange,
  CASE WHEN text = '' THEN 'fast' WHEN regexp_matches(text, '.\\s*(?:和|与|vs|VS|对比|比较)\\s*.|{_alt(routing.COMPLEX)}') OR (turn > 0 AND regexp_matches(text, '{routing.PRONOUN_FORM}')) THEN 'full'
    WHEN regexp_matches(text, '{_alt(routing.TEMPLATE)}') OR length(text) < 15 THEN 'fast' ELSE 'full' END AS search_path FROM q)"""


@query("question_flags", f"""WITH {FLAGS} SELECT conv_id, turn, realtime, calculation, kb_preferred, exchange, search_path,
  (realtime::INT + calculation::INT + kb_preferred::INT) >= 2 AS conflict FROM f""")
def question_flags(t) -> DataFrame:
    """Class flags and search path of every user message."""
    flags = routing.question_flags(F.col("text"), F.col("turn") > 0)
    wanted = ("realtime", "calculation", "kb_preferred", "exchange", "search_path", "conflict")
    return questions(t).select("conv_id", "turn", *[flags[c].alias(c) for c in wanted])


@query("question_modes", f"""WITH {FLAGS} SELECT search_path, realtime, count(*) AS questions, round(count(*) / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY 1, 2""")
def question_modes(t) -> DataFrame:
    """Share of every search path among the user messages."""
    rows = question_flags(t)
    n = rows.groupBy("search_path", "realtime").agg(F.count(F.lit(1)).alias("questions"))
    return n.withColumn("share", F.round(F.col("questions") / F.sum("questions").over(W.partitionBy()), 6))


TOOL_SQL = ", ".join("CASE WHEN regexp_matches(low, '" + _alt(words) + f"') THEN '{name}' END" for name, _, words in sorted(routing.TOOLS, key=lambda x: -x[1]))


@query("matched_tools", f"""WITH x AS (SELECT conv_id, turn, list_filter([{TOOL_SQL}], lambda v: v IS NOT NULL) AS tools FROM (SELECT *, lower(text) AS low FROM conversations WHERE role = 'user'))
SELECT conv_id, turn, array_to_string(tools, ',') AS tools, array_to_string(tools[1:2], ',') AS chosen FROM x""")
def matched_tools(t) -> DataFrame:
    """Tools a message triggers, by priority, and the two left for the decision."""
    rows = questions(t).select("conv_id", "turn", routing.matched_tools(F.col("text")).alias("tools"))
    return rows.select("conv_id", "turn", F.array_join("tools", ",").alias("tools"), F.array_join(routing.resolved_tools(F.col("tools"), F.lit(False)), ",").alias("chosen"))


@query("gate_decision", """WITH e AS (SELECT event_id, (json_extract(props, '$.k')::BIGINT % 10) / 10.0::DOUBLE AS a, (user_id % 10) / 10.0::DOUBLE AS b, (event_id % 10) / 10.0::DOUBLE AS c, user_id % 3 = 0 AS has_kb, user_id % 2 = 0 AS use_web FROM events),
g AS (SELECT *, greatest(a, b, c) AS top, a + b + c - greatest(a, b, c) - least(a, b, c) AS second, a >= 0.4 AND has_kb AS kb, b >= 0.4 OR (a >= 0.4 AND NOT has_kb) AS web, c >= 0.4 AS rt FROM e),
m AS (SELECT *, CASE WHEN web AND kb THEN 'hybrid' WHEN web THEN 'web_search' WHEN kb THEN 'kb_only' ELSE 'direct_llm' END AS mode FROM g)
SELECT event_id AS query_id, CASE WHEN top < 0.4 THEN 'direct_llm' ELSE mode END AS primary_mode,
  CASE WHEN top < 0.4 THEN 'none' WHEN rt AND NOT use_web THEN 'tell_failure' WHEN mode IN ('web_search', 'hybrid') THEN CASE WHEN rt THEN 'tell_failure' ELSE 'web_search' END WHEN mode = 'kb_only' THEN 'llm_direct' ELSE 'none' END AS fallback,
  top >= 0.4 AND round(top - second, 9) < 0.15 AS needs_clarify FROM m""")
def gate_decision(t) -> DataFrame:
    """Mode, fallback and clarify flag for every event read as a routed question."""
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    drafts = t.events.select(
        F.col("event_id").alias("query_id"), F.lit("q").alias("question"), F.lit("direct_llm").alias("primary_mode"), F.lit("none").alias("fallback"), F.lit(False).alias("needs_clarify"),
        F.create_map(F.lit("needs_kb"), (k % 10) / 10.0, F.lit("needs_web"), (u % 10) / 10.0, F.lit("needs_realtime"), (F.col("event_id") % 10) / 10.0).alias("scores"),
        (u % 3 == 0).alias("has_kb"), (u % 2 == 0).alias("use_web"), F.lit("simple").alias("search_mode"))
    return routing.gate_decision(drafts).select("query_id", "primary_mode", "fallback", "needs_clarify")


@query("keyword_strategy", f"""WITH q AS (SELECT conv_id, turn, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS low FROM conversations WHERE role = 'user'),
x AS (SELECT *, regexp_matches(low, '{_alt(routing.EXACT_GREETINGS)}') AS greet, {" + ".join(f"contains(low, '{w}')::INT" for w in routing.KNOWLEDGE_WORDS)} AS n FROM q)
SELECT conv_id, turn, NOT greet AND n >= 1 AS result, CASE WHEN greet THEN 0.9::DOUBLE WHEN n >= 2 THEN least(0.8 + n * 0.05, 0.95) WHEN n = 1 THEN 0.6 ELSE 0.3 END AS confidence FROM x""")
def keyword_strategy(t) -> DataFrame:
    """Keyword vote on every user message."""
    return questions(t).select("conv_id", "turn", routing.keyword_strategy(F.col("text")).alias("v")).select("conv_id", "turn", "v.result", "v.confidence")


@query("context_strategy")
def context_strategy(t) -> DataFrame:
    """Vote by the last three messages before the final question of every conversation."""
    c = t.conversations.select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    last = c.filter(F.col("role") == "user").groupBy("session_id").agg(F.max("turn").alias("asked"), F.max_by("text", "turn").alias("question"))
    before = c.join(last.select("session_id", "asked"), "session_id").filter(F.col("turn") < F.col("asked"))
    return routing.context_strategy(before, last)


@query("strategy_votes", f"""WITH q AS (SELECT conv_id, turn, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS low FROM conversations WHERE role = 'user'),
x AS (SELECT *, regexp_matches(low, '{_alt(routing.EXACT_GREETINGS)}') AS greet, {" + ".join(f"contains(low, '{w}')::INT" for w in routing.KNOWLEDGE_WORDS)} AS n FROM q),
v AS (SELECT conv_id, turn, NOT greet AND n >= 1 AS result, CASE WHEN greet THEN 0.9::DOUBLE WHEN n >= 2 THEN least(0.8 + n * 0.05, 0.95) WHEN n = 1 THEN 0.6 ELSE 0.3 END AS confidence FROM x)
SELECT conv_id, turn, 'keyword' AS strategy, result, confidence FROM v
UNION ALL SELECT conv_id, turn, 'smalltalk', FALSE, CASE WHEN NOT result AND confidence >= 0.9 THEN confidence ELSE 0 END FROM v""")
def strategy_votes(t) -> DataFrame:
    """Votes of all registered strategies on every user message."""
    return strategies.votes(questions(t), "text").select("conv_id", "turn", "strategy", "result", "confidence")


@query("rewrite_queries")
def rewrite_queries(t) -> DataFrame:
    """Search queries made of every user message."""
    return questions(t).select("conv_id", "turn", F.posexplode(routing.rewrite_queries(F.col("text"), "2024-01-31")).alias("pos", "search"))


@query("compress_history", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i, CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text AS line FROM conversations),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS full_, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE i <= 2 OR role = 'user') AS brief, count(*) AS n FROM n WHERE i <= 5 GROUP BY 1),
b AS (SELECT conv_id, full_, CASE WHEN n > 2 THEN brief ELSE full_ END AS brief FROM h)
SELECT conv_id AS session_id, CASE WHEN length(full_) <= 1000 THEN full_ WHEN length(brief) > 1000 THEN substr(brief, 1, 1000) || '...' ELSE brief END AS history FROM b""")
def compress_history(t) -> DataFrame:
    """Compressed history of every conversation."""
    return routing.compress_history(t.conversations.withColumnRenamed("conv_id", "session_id"))


@query("resolve_pronouns")
def resolve_pronouns(t) -> DataFrame:
    """Last question of every conversation with its pronoun replaced."""
    c = t.conversations.select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    last = c.filter(F.col("role") == "user").groupBy("session_id").agg(F.max("turn").alias("asked"), F.max_by("text", "turn").alias("question"))
    before = c.join(last.select("session_id", "asked"), "session_id").filter(F.col("turn") < F.col("asked"))
    return routing.resolve_pronouns(last, before)


CITED = "replace(replace(replace(text, 'en.', 'en[1]。'), 'er.', 'er[3]。'), '.', '。')"


def cited_answers(t) -> DataFrame:
    """Assistant turns with sentence signs and citation marks put in."""
    text = F.replace(F.replace(F.replace("text", F.lit("en."), F.lit("en[1]。")), F.lit("er."), F.lit("er[3]。")), F.lit("."), F.lit("。"))
    return t.conversations.filter(F.col("role") == "assistant").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("answer"), F.lit(2).alias("n_sources"))


@query("citation_report", f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, {CITED} AS answer FROM conversations WHERE role = 'assistant'),
l AS (SELECT id, answer, unnest(string_split(answer, chr(10))) AS line FROM a),
p AS (SELECT id, unnest(CASE WHEN regexp_matches(trim(line), '^\\s*(?:[-=*]{{3,}}|#{{1,6}}\\s|```|>\\s*|\\s*[-*+]\\s+|\\s*\\d+\\.\\s+)|^\\s*$') THEN [] ELSE regexp_extract_all(line, '[^。！？!?]*[。！？!?]|[^。！？!?]+$') END) AS piece FROM l),
f AS (SELECT id, count(*) AS facts, count(*) FILTER (WHERE regexp_matches(piece, '\\[\\d+\\]')) AS cited FROM p WHERE length(trim(piece, ' ' || chr(9) || chr(10) || chr(13))) >= 5 GROUP BY 1)
SELECT a.id, coalesce(facts, 0) AS facts, coalesce(cited, 0) AS cited, CASE WHEN facts > 0 THEN round(cited / facts, 4) ELSE 0 END AS coverage,
  len(regexp_extract_all(answer, '\\[3\\]'))::INTEGER AS out_of_range FROM a LEFT JOIN f USING (id)""")
def citation_report(t) -> DataFrame:
    """Cited share of the sentences of every answer and marks without a source."""
    return answers.citation_report(cited_answers(t), "id")


@query("citation_backfill")
def citation_backfill(t) -> DataFrame:
    """Answers with missing citations filled in from the user messages of the conversation."""
    rows = cited_answers(t).withColumn("conv", F.floor(F.col("id") / 1000))
    src = t.conversations.filter(F.col("role") == "user").select(F.col("conv_id").alias("conv"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("source_index"), F.col("text").alias("content"))
    sources = rows.select("id", "conv").join(src, "conv").drop("conv")
    return answers.backfill_citations(rows.select("id", "answer"), sources, "id", hashing_embedder())


@query("unsupported_dates", rf"""WITH {PAIRS}, d AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(answer, '{numbers.DATE_FORMS}')) AS a, list_distinct(regexp_extract_all(question, '{numbers.DATE_FORMS}')) AS s FROM qa)
SELECT conv_id, turn, len(a) AS dates, len(list_filter(a, lambda x: NOT list_contains(s, x))) AS missing FROM d""")
def unsupported_dates(t) -> DataFrame:
    """Dates of every answer and those the question does not name."""
    qa = question_answers(t)
    return qa.select("conv_id", "turn", F.size(numbers.date_mentions(F.col("answer"))).cast("long").alias("dates"),
                     F.size(numbers.unsupported_dates(F.col("answer"), F.col("question"))).cast("long").alias("missing"))


@query("answer_confidence")
def answer_confidence(t) -> DataFrame:
    """Confidence of the values every user saw: agreement across types, recency of the events."""
    e = t.events
    day = F.to_date("ts").cast("string").alias("day")
    src = e.filter(F.col("event_type") != "purchase").select(day, F.col("event_id").alias("pos"), "value", F.col("event_type").alias("domain"))
    own = e.filter(F.col("event_type") == "purchase").select(day, "value")
    share = answers.cross_source_share(own, src, "day")
    # cited: events with an even number among their properties; authority: by user, as in source_confidence
    fresh = e.groupBy(day).agg(F.avg(numbers.age_freshness(F.lit(1706745600) - F.unix_timestamp("ts"))).alias("f"), F.avg((F.get_json_object("props", "$.k").cast("long") % 2 == 0).cast("double")).alias("cited"),
                               F.avg(F.col("user_id") % 11 / 10.0).alias("authority"))
    return share.join(fresh, "day").select("day", answers.answer_confidence(F.col("share"), F.col("cited"), F.col("authority"), F.col("f")).alias("confidence"))


@query("source_confidence", """WITH e AS (SELECT event_id, ((json_extract(props, '$.k')::BIGINT) / 100.0)::DECIMAL(8,4) AS c, epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS age, user_id, event_type = 'error' AS fb FROM events),
f AS (SELECT *, (CASE WHEN age <= 60 THEN 1.0 WHEN age <= 300 THEN 0.9 WHEN age <= 900 THEN 0.8 WHEN age <= 3600 THEN 0.7 WHEN age <= 21600 THEN 0.5 WHEN age <= 86400 THEN 0.3 ELSE 0.1 END)::DECIMAL(8,4) AS fresh FROM e),
w AS (SELECT event_id, fb, 0.4::DECIMAL(2,1) * c + 0.3::DECIMAL(2,1) * fresh + 0.2::DECIMAL(2,1) * (user_id % 11 / 10.0)::DECIMAL(8,4) + 0.1::DECIMAL(2,1) * least(1.0, (user_id % 3) / 2)::DECIMAL(8,4) AS score FROM f)
SELECT event_id, round(greatest(0::DECIMAL(12,6), least(1::DECIMAL(12,6), CASE WHEN fb THEN score * 0.7::DECIMAL(2,1) ELSE score END)), 2)::DOUBLE AS confidence FROM w""")
def source_confidence(t) -> DataFrame:
    """Confidence of every event read as a sourced answer, the authority of its source by user."""
    k = F.get_json_object("props", "$.k").cast("long") / 100.0
    fresh = numbers.age_freshness(F.lit(1706659200) - F.unix_timestamp("ts"))
    level = numbers.overall_confidence(k, fresh, F.col("user_id") % 11 / 10.0, F.col("user_id") % 3, F.col("event_type") == "error")
    return t.events.select("event_id", level.alias("confidence"))


@query("navigation_summary", """SELECT user_id * 100 + day(ts) AS trace_id, count(*) AS rounds, count(*) FILTER (WHERE event_type = 'view') AS index_rounds,
  string_agg(CASE WHEN event_type = 'view' THEN 'index' ELSE event_type END, '>' ORDER BY event_id) AS modes FROM events GROUP BY 1""")
def navigation_summary(t) -> DataFrame:
    """Modes of every user day in order."""
    steps = t.events.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("trace_id"), F.col("event_id").alias("step"),
                            F.when(F.col("event_type") == "view", "index").otherwise(F.col("event_type")).alias("mode"), F.col("event_id").cast("string").alias("page"))
    return answers.navigation_summary(steps).select("trace_id", "rounds", "index_rounds", "modes")


@query("material", """WITH m AS (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS m FROM documents WHERE text <> '' GROUP BY 1)
SELECT source, md5(substr(m, 1, 6000)) AS digest, length(substr(m, 1, 6000))::INTEGER AS chars, length(m) > 6000 AS cut FROM m""")
def material(t) -> DataFrame:
    """First 6000 characters of the texts of every base."""
    chunks = t.documents.select("source", F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return answers.material(chunks, "source", 6000).select("source", F.md5("material").alias("digest"), "chars", "cut")


def traces(t) -> DataFrame:
    """Orders as traces: every line is a stage with its latency and a nested timing."""
    stage = F.struct(F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("latency_ms"),
                     F.concat(F.lit('{"rerank_ms": '), F.col("l_partkey").cast("string"), F.lit("}")).alias("detail"))
    call = F.concat(F.lit('{"name": "tool'), (F.col("l_partkey") % 4).cast("string"), F.lit('", "arguments": {"x": 1}}'))
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("trace_id")).agg(F.collect_list(stage).alias("stages"), F.collect_list(call).alias("tool_calls"))
    o = t.orders.select(F.col("o_orderkey").alias("trace_id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at"),
                        F.concat(F.repeat(F.lit("q"), 150), F.col("o_orderpriority")).alias("question"), (F.col("o_orderstatus") == "P").alias("fallback_triggered"), F.col("o_totalprice").alias("total_latency_ms"))
    return o.join(s, "trace_id", "left")


@query("stage_percentiles", """SELECT l_returnflag AS name, count(*) AS stages, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(avg(l_partkey), 6) AS mean_rerank
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def stage_percentiles(t) -> DataFrame:
    """Latency percentiles per stage over all traces."""
    s = usage.trace_stages(traces(t))
    return s.groupBy("name").agg(F.count(F.lit(1)).alias("stages"), F.round(F.percentile("latency_ms", 0.5), 6).alias("p50"),
                                 F.round(F.percentile("latency_ms", 0.95), 6).alias("p95"), F.round(F.avg(F.element_at("timings", "rerank_ms")), 6).alias("mean_rerank"))


@query("tool_counts", "SELECT 'tool' || (l_partkey % 4) AS tool, count(*) AS calls, count(DISTINCT l_orderkey) AS traces FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def tool_counts(t) -> DataFrame:
    """Calls and traces per tool."""
    return usage.tool_steps(traces(t)).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("trace_id").alias("traces"))


@query("trace_summary", """SELECT o_orderkey AS trace_id, substr(repeat('q', 150) || o_orderpriority, 1, 120) AS question, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INTEGER AS stage_count, o_orderstatus = 'P' AS fallback_triggered FROM orders""")
def trace_summary(t) -> DataFrame:
    """Short form of every trace."""
    return usage.trace_summary(traces(t)).select("trace_id", "question", "stage_count", "fallback_triggered")


@query("cache_keys", """SELECT event_id, user_id || ':' || CASE WHEN user_id % 10 = 0 THEN 'all' ELSE substr(md5(array_to_string(list_sort(['src' || user_id % 7, 'src' || user_id % 5]), ',')), 1, 12) END AS scope_key,
  'exact:' || md5(lower(trim(' ' || event_type || ' '))) AS field FROM events""")
def cache_keys(t) -> DataFrame:
    """Scope key and exact field of every event read as a question."""
    u = F.col("user_id")
    src = lambda n: F.concat(F.lit("src"), (u % n).cast("string"))
    kbs = F.when(u % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(src(7), src(5)))
    return t.events.select("event_id", lifecycle.scope_key(u.cast("string"), kbs).alias("scope_key"),
                           lifecycle.exact_field(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).alias("field"))


@query("chunk_flags", r"""WITH d AS (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\s*\d+\.\s*\[[^\]]+\]\(#'))) AS toc,
  len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\s*(\||- |\* )'))) AS listed FROM documents)
SELECT doc_id, toc >= 3 AS is_toc, length(text) <= 400 AND listed = 0 AS is_lead FROM d""")
def chunk_flags(t) -> DataFrame:
    """Tables of contents and opening chunks among the documents."""
    return t.documents.select("doc_id", rules.is_toc_chunk(F.col("text")).alias("is_toc"), rules.is_document_lead(F.col("text"), F.lit("")).alias("is_lead"))


@query("complaint_classes", """SELECT CASE WHEN user_id % 4 = 0 THEN 'retrieval_failure' WHEN value < 10 THEN 'incomplete_answer' ELSE 'other' END AS category,
  CASE WHEN user_id % 4 = 0 THEN 4 ELSE 2 END AS severity, count(*) AS cases FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def complaint_classes(t) -> DataFrame:
    """Category and severity of errors read as complaints without a reason."""
    answer = F.when(F.col("value") < 10, "short").otherwise(F.repeat(F.lit("a"), 60))
    c = rules.classify_complaint(F.lit(None).cast("string"), answer, F.col("user_id") % 4 != 0, F.lit("negative"))
    return t.events.filter(F.col("event_type") == "error").select(c.alias("c")).groupBy("c.category", "c.severity").agg(F.count(F.lit(1)).alias("cases"))
