"""Corpus preparation queries: chunks, profiles, safety, web pages, numbers, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from docweave.functions import numbers, rules, text as texts, web
from docweave.functions.text import estimate_tokens, rows_of
from docweave.operators import chunking, duplicates
from docweave.plans import sqlparts as s
from docweave.plans.catalog import query


@query("chunk_documents")
def chunk_documents(t) -> DataFrame:
    """Chunks of 512 characters with 64 of overlap of every document."""
    return chunking.chunk_documents(t.documents, "doc_id").select("doc_id", "chunk_index", "total_chunks", "content")


@query("chunk_summary")
def chunk_summary(t) -> DataFrame:
    """Chunks per document and size percentiles over every document."""
    return chunking.chunk_summary(chunking.chunk_documents(t.documents, "doc_id"), "doc_id")


@query("structured_chunks")
def structured_chunks(t) -> DataFrame:
    """Every document as Markdown and every page as HTML, by file name."""
    docs = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    pages = t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    both = docs.unionByName(pages)
    return chunking.chunk_documents(both, "path", strategy=chunking.strategy_of(F.col("path"))).select(
        "path", "chunk_index", "heading_path", "kind", "content")


@query("html_text")
def html_text(t) -> DataFrame:
    """Readable text of every page."""
    return page_texts(t).select("page_id", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def page_texts(t) -> DataFrame:
    body = F.pandas_udf(lambda html: html.map(chunking.html_body), T.StringType())
    return t.pages.withColumn("content", body(F.col("html")))


TITLE = r"<title>(.*?)</title>"


@query("url_dedup", r"""
WITH RECURSIVE p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^[w.]+', '')
  || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS u,
  md5(regexp_replace(substr(trim(html, ' ' || chr(9) || chr(10) || chr(13)), 1, 200), '\s+', '', 'g')) AS h FROM pages),
o AS (SELECT *, row_number() OVER (ORDER BY page_id) AS i FROM p),
walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS us, []::VARCHAR[] AS hs, FALSE AS kept
  UNION ALL SELECT w.i + 1,
    CASE WHEN list_contains(w.us, o.u) OR list_contains(w.hs, o.h) THEN w.us ELSE list_append(w.us, o.u) END,
    CASE WHEN list_contains(w.us, o.u) OR list_contains(w.hs, o.h) THEN w.hs ELSE list_append(w.hs, o.h) END,
    NOT (list_contains(w.us, o.u) OR list_contains(w.hs, o.h)) FROM walk w JOIN o ON o.i = w.i + 1)
SELECT page_id, u AS normal_url FROM walk JOIN o USING (i) WHERE kept""")
def url_dedup(t) -> DataFrame:
    """Pages left when repeated addresses and repeated openings are dropped in page order."""
    pages = t.pages.select("page_id", web.normal_url(F.col("url")).alias("_url"), web.content_hash(F.col("html")).alias("_hash"))
    return web.dedupe_results(pages, [], "page_id").select("page_id", F.col("_url").alias("normal_url"))


@query("score_pages", r"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS domain,
  length(regexp_extract(html, '<title>(.*?)</title>', 1)) AS tl, length(html) AS n, html,
  list_max(list_transform(regexp_extract_all(html, '20[2-3]\d'), lambda y: y::INTEGER)) AS y FROM pages),
f AS (SELECT page_id, domain, CASE WHEN regexp_matches(domain, 'youtube\.com|youtu\.be|bilibili\.com|tiktok\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|weibo\.com|reddit\.com|pinterest\.com|taobao\.com|tmall\.com|jd\.com|amazon\.com') THEN 0.2::DOUBLE ELSE 0.5 END AS authority,
  CASE WHEN y IS NULL THEN 0.5::DOUBLE WHEN y >= 2024 THEN CASE WHEN regexp_matches(html, '\d{2}:\d{2}|刚刚|几分钟前|小时前|今日|今天|当前|现在|实时') THEN 1.0 ELSE 0.85 END
    WHEN y = 2023 THEN 0.7 WHEN y >= 2022 THEN 0.4 ELSE 0.2 END AS freshness,
  greatest(0.3, least(1.0, (n + tl * 2) / 1000.0))::DOUBLE AS relevance FROM p),
x AS (SELECT *, round(authority * 0.3 + freshness * 0.3 + relevance * 0.4, 6) AS final_score FROM f)
SELECT page_id, domain, authority, freshness, round(relevance, 6) AS relevance, final_score FROM x""")
def score_pages(t) -> DataFrame:
    """Authority, freshness (clock 2024), relevance and score of every page."""
    pages = t.pages.select("page_id", "url", F.regexp_extract("html", TITLE, 1).alias("title"), F.col("html").alias("content"))
    return web.score_results(pages, 2024).select("page_id", "domain", "authority", "freshness", F.round("relevance", 6).alias("relevance"),
                                                 F.round("final_score", 6).alias("final_score"))


@query("domain_authority", r"""
SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', '') AS domain, count(*) AS pages,
  avg(CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*(x\.com|jd\.com)') THEN 0.2::DOUBLE ELSE 0.5 END) AS mean_authority FROM pages GROUP BY 1""")
def domain_authority(t) -> DataFrame:
    """Pages and mean authority per domain."""
    return t.pages.groupBy(web.domain(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("pages"), F.avg(web.authority(F.col("url"))).alias("mean_authority"))


@query("web_blocks")
def web_blocks(t) -> DataFrame:
    """Shown text of every page: two blocks of 500 characters, or one more with a measure."""
    texts = page_texts(t).select("page_id", "content")
    parts = chunking.chunk_documents(texts, "page_id", "content", strategy=F.lit("web"), size=500, overlap=50)
    blocks = parts.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("b"))
    shown = web.select_blocks(F.col("b"))
    return blocks.select("page_id", F.size("b").alias("blocks"), F.length(shown).alias("chars"))


KIND = "document_type"
TYPES_SQL = """CASE WHEN regexp_matches(l, '代码|编程|开发|api|function|class|method|algorithm|软件|系统') THEN {0}
  WHEN regexp_matches(l, '财务|报表|预算|投资|利润|收入|成本|审计') THEN {1} WHEN regexp_matches(l, '报告|分析|总结|评估|调研|数据') THEN {2}
  WHEN regexp_matches(l, '手册|指南|教程|说明|使用|操作') THEN {3} WHEN regexp_matches(l, '政策|规定|通知|公告|条例|办法') THEN {4}
  WHEN regexp_matches(l, '新闻|消息|报道|发布|动态') THEN {5} ELSE {6} END"""
CLASSIFIED = f"""low AS (SELECT doc_id, lower(text) AS l FROM documents),
classed AS (SELECT doc_id, {TYPES_SQL.format("'technical'", "'business'", "'report'", "'manual'", "'policy'", "'news'", "'other'")} AS document_type,
  CASE WHEN regexp_matches(l, '医疗|健康|医院|药品|疾病|诊断') THEN 'healthcare' WHEN regexp_matches(l, '教育|学校|学习|培训|课程|学生') THEN 'education'
    WHEN regexp_matches(l, '法律|法规|合同|诉讼|权利|义务') THEN 'legal' WHEN regexp_matches(l, '管理|企业|公司|组织|战略|运营') THEN 'enterprise'
    ELSE {TYPES_SQL.format("'it'", "'finance'", "'other'", "'other'", "'government'", "'other'", "'other'")} END AS domain,
  coalesce({TYPES_SQL.format("'技术开发'", "'财务管理'", "'数据分析'", "'使用指南'", "'政策法规'", "'新闻资讯'", "NULL")}, '综合内容') AS topics FROM low)"""


@query("classify_documents", f"WITH {CLASSIFIED} SELECT doc_id, document_type, domain, topics FROM classed")
def classify_documents(t) -> DataFrame:
    """Type, domain and topics of every document by keyword rules."""
    c = t.documents.select("doc_id", rules.classify_document(F.col("text")).alias("c"))
    return c.select("doc_id", "c.document_type", "c.domain", F.array_join("c.topics", ",").alias("topics"))


QUALITY = r"""parts AS (SELECT doc_id, source, text, length(text) AS n,
  list_filter(list_transform(string_split(text, '。'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS sents,
  len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS paras FROM documents),
means AS (SELECT *, CASE WHEN len(sents) > 0 THEN list_sum(list_transform(sents, lambda x: length(x))) / len(sents) ELSE 0 END AS mean FROM parts),
q AS (SELECT doc_id, source, CASE WHEN n < 100 THEN 20 WHEN n < 500 THEN 50 WHEN n < 2000 THEN 75 ELSE 90 END::DOUBLE AS completeness,
  CASE WHEN mean < 10 THEN 40 WHEN mean > 100 THEN 50 ELSE 85 END::DOUBLE AS readability,
  (CASE WHEN paras < 3 THEN 40 WHEN paras < 5 THEN 60 ELSE least(80, paras * 5) END
   + CASE WHEN regexp_matches(text, '\n# |\n## |\n### |一、|二、|1\.|2\.') THEN 10 ELSE 0 END)::DOUBLE AS structure, text FROM means),
graded AS (SELECT *, (completeness + readability + structure + 80) / 4 AS overall FROM q),
g AS (SELECT *, CASE WHEN overall >= 90 THEN '优秀' WHEN overall >= 80 THEN '良好' WHEN overall >= 70 THEN '中等' WHEN overall >= 60 THEN '及格' ELSE '需改进' END AS grade FROM graded)"""


@query("grade_documents", f"""WITH {QUALITY} SELECT doc_id, completeness, readability, structure, round(overall, 1) AS overall_score, grade AS overall_grade FROM g""")
def grade_documents(t) -> DataFrame:
    """Quality scores and grade of every document."""
    q = rules.quality_of(F.col("text"))
    return t.documents.select("doc_id", *[q[c].alias(c) for c in ("completeness", "readability", "structure", "overall_score", "overall_grade")])


@query("corpus_profile", f"""WITH {CLASSIFIED}, {QUALITY}
SELECT source AS kb_id, document_type, domain, grade AS overall_grade, count(*) AS documents,
  sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS tokens, round(avg(round(overall, 1)), 6) AS mean_score FROM g JOIN classed USING (doc_id) GROUP BY 1, 2, 3, 4""")
def corpus_profile(t) -> DataFrame:
    """Documents, tokens and mean score per base, type, domain and grade, in one pass."""
    q, c = rules.quality_of(F.col("text")), rules.classify_document(F.col("text"))
    rows = t.documents.select(F.col("source").alias("kb_id"), c.alias("c"), q["overall_score"].alias("score"),
                              q["overall_grade"].alias("overall_grade"), estimate_tokens(F.col("text")).alias("tokens"))
    return rows.groupBy("kb_id", "c.document_type", "c.domain", "overall_grade").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.round(F.avg("score"), 6).alias("mean_score"))


SECRET_SQL = [p.replace("'", "''") for _, p in rules.SECRET_RULES]


@query("redact_secrets", "WITH r0 AS (SELECT doc_id, text AS t0 FROM documents), " + ", ".join(
    f"r{i + 1} AS (SELECT *, regexp_replace(t{i}, '{p}', '{rules.REDACTION}', 'g') AS t{i + 1} FROM r{i})" for i, p in enumerate(SECRET_SQL))
    + f""" SELECT doc_id, length(t{len(SECRET_SQL)})::INTEGER AS chars, array_to_string(list_filter([""" + ", ".join(
        f"CASE WHEN regexp_matches(t{i}, '{p}') THEN '{rules.SECRET_RULES[i][0]}' END" for i, p in enumerate(SECRET_SQL))
    + f"""], lambda x: x IS NOT NULL), ',') AS rules, md5(t{len(SECRET_SQL)}) AS digest FROM r{len(SECRET_SQL)}""")
def redact_secrets(t) -> DataFrame:
    """Every document with secrets masked and the names of the rules that fired."""
    clean, hits = rules.redact(F.col("text"))
    return t.documents.select("doc_id", F.length(clean).alias("chars"), F.array_join(hits, ",").alias("rules"), F.md5(clean).alias("digest"))


TEXTS = """texts AS (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'messages', text FROM conversations)"""
SIGNALS_SQL = ", ".join(
    "CASE WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN 'signal_{i}' END" for i, p in enumerate(rules.CONTEXT_SIGNALS, 1))


def all_texts(t) -> DataFrame:
    return (t.documents.select(F.lit("documents").alias("origin"), "text")
            .unionByName(t.pages.select(F.lit("pages").alias("origin"), F.col("html").alias("text")))
            .unionByName(t.conversations.select(F.lit("messages").alias("origin"), "text")))


@query("context_signals", f"""WITH {TEXTS}, x AS (SELECT origin, list_filter([{SIGNALS_SQL}], lambda x: x IS NOT NULL) AS rules FROM texts),
y AS (SELECT origin, unnest(CASE WHEN len(rules) > 0 THEN rules ELSE ['none'] END) AS rule FROM x)
SELECT origin, rule, count(*) AS texts FROM y GROUP BY 1, 2""")
def context_signals(t) -> DataFrame:
    """Texts per origin in which each injection signal is found; ``none`` counts the rest."""
    found = rules.context_signals(F.col("text"))
    return all_texts(t).select("origin", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).alias("rule")).groupBy("origin", "rule").agg(
        F.count(F.lit(1)).alias("texts"))


INPUT_SQL = " ".join("WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in rules.INJECTION_RULES)


@query("detect_injection", f"""WITH {TEXTS}, x AS (SELECT origin, CASE WHEN trim(text) = '' THEN NULL WHEN length(text) > 4000 THEN 'input_too_long'
  WHEN length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) >= 20 THEN 'control_char_flood' {INPUT_SQL} END AS rule FROM texts)
SELECT origin, coalesce(rule, 'pass') AS rule, count(*) AS texts FROM x GROUP BY 1, 2""")
def detect_injection(t) -> DataFrame:
    """First input rule that stops each text, counted per origin."""
    normal = all_texts(t).withColumn("text", rules.nfkc(F.col("text")))
    return normal.groupBy("origin", F.coalesce(rules.input_rule(F.col("text")), F.lit("pass")).alias("rule")).agg(F.count(F.lit(1)).alias("texts"))


@query("safety_share", "WITH " + f"""hit AS (SELECT source, regexp_matches(text, '{"|".join("(?:" + p + ")" for p in SECRET_SQL)}') AS h FROM documents)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE h) AS touched, round(count(*) FILTER (WHERE h) / count(*), 6) AS share FROM hit GROUP BY source""")
def safety_share(t) -> DataFrame:
    """Share of the documents of each base that hold a secret."""
    _, hits = rules.redact(F.col("text"))
    touched = F.size(hits) > 0
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(touched).alias("touched"),
        F.round(F.count_if(touched) / F.count(F.lit(1)), 6).alias("share"))


@query("clean_answers", r"""
WITH a AS (SELECT conv_id, turn, trim(trim(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g')), ' ' || chr(9) || chr(10) || chr(13)) AS c,
  regexp_matches(text, '(?i)\{\s*"name"\s*:\s*"\w+"|"tool"\s*:\s*"\w+"|"arguments"\s*:\s*\{\s*"|<RichMediaReference>|(?m)^\s*第\s*\d+\s*步') AS p FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, md5(c) AS digest, p AS polluted FROM a""")
def clean_answers(t) -> DataFrame:
    """Assistant turns without thoughts, tool calls and narration."""
    clean, polluted = rules.clean_answer_text(F.col("text"))
    return t.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", F.md5(clean).alias("digest"), polluted.alias("polluted"))


@query("lexicon_findings", """
WITH w AS (SELECT unnest(['the', 'de', 'ung', 'tion', 'que']) AS word, unnest(['a', 'b', 'a', 'b', 'a']) AS category, generate_subscripts([1,2,3,4,5], 1) AS position)
SELECT doc_id, word, category, (length(text) - length(replace(text, word, ''))) // length(word) AS n
FROM documents JOIN w ON contains(text, word)""")
def lexicon_findings(t) -> DataFrame:
    """Listed words found in every document, with overlapping places counted."""
    lexicon = t.spark.createDataFrame([("the", "a", 1), ("de", "b", 2), ("ung", "a", 3), ("tion", "b", 4), ("que", "a", 5)],
                                      "word string, category string, position int")
    return rules.lexicon_findings(t.documents, "doc_id", "text", lexicon).select("doc_id", "word", "category", "n")


@query("number_mentions", r"""SELECT doc_id, len(regexp_extract_all(text, '[¥$€£]?\s*([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)', 1)) AS mentions,
  round(list_sum(list_transform(regexp_extract_all(text, '[¥$€£]?\s*([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)', 1), lambda x: ln(1 + replace(x, ',', '')::DOUBLE))), 4) AS log_sum
FROM documents WHERE regexp_matches(text, '[0-9]')""")
def number_mentions(t) -> DataFrame:
    """How many numbers every document names, with a sum over them as a check."""
    m = t.documents.select("doc_id", numbers.number_mentions(F.col("text")).alias("m"))
    logs = F.transform("m", lambda x: F.log1p(x["value"]))
    return m.filter(F.size("m") > 0).select("doc_id", F.size("m").cast("long").alias("mentions"),
                                            F.round(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x), 4).alias("log_sum"))


@query("numeric_facts")
def numeric_facts(t) -> DataFrame:
    """Facts with unit and metric named in every document."""
    return t.documents.select("doc_id", rows_of(numbers.numeric_facts(F.col("text"))).alias("f")).filter(F.col("f").isNotNull()).select("doc_id", "f.metric", "f.unit", "f.value")


@query("numeric_conflicts", """
WITH g AS (SELECT user_id, event_type AS metric, 'k' AS unit, count(*) AS facts, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
d AS (SELECT *, (hi - lo) / greatest(abs(lo), abs(hi), 1e-9) AS diff FROM g WHERE facts >= 2)
SELECT user_id, metric, unit, facts, round(diff, 6) AS max_relative_diff, CASE WHEN diff >= 0.5 THEN 'high' WHEN diff >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM d WHERE diff >= 0.05""")
def numeric_conflicts(t) -> DataFrame:
    """Disagreeing values of one quantity per user."""
    facts = t.events.select("user_id", F.col("event_type").alias("metric"), F.lit("k").alias("unit"), "value")
    return numbers.numeric_conflicts(facts, ["user_id"]).withColumn("max_relative_diff", F.round("max_relative_diff", 6))


@query("conflict_confidence", """
WITH g AS (SELECT user_id, event_type, count(*) AS facts, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
d AS (SELECT *, (hi - lo) / greatest(abs(lo), abs(hi), 1e-9) AS diff FROM g WHERE facts >= 2)
SELECT user_id, count(*) AS conflicts, min(CASE WHEN diff >= 0.5 THEN 0.2::DOUBLE WHEN diff >= 0.2 THEN 0.5 ELSE 0.8 END) AS confidence FROM d WHERE diff >= 0.05 GROUP BY 1""")
def conflict_confidence(t) -> DataFrame:
    """How far the values of a user can be trusted, by the worst of their conflicts."""
    facts = t.events.select("user_id", F.col("event_type").alias("metric"), F.lit("k").alias("unit"), "value")
    return numbers.conflict_confidence(numbers.numeric_conflicts(facts, ["user_id"]), ["user_id"])


@query("distinct_ids", """
WITH r AS (SELECT l_orderkey AS id, CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE ' ' || (l_suppkey % 5) END AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
f AS (SELECT id, trim(x) AS x, min(n) AS n FROM r WHERE trim(x) <> '' GROUP BY 1, 2)
SELECT id, coalesce(string_agg(f.x, ',' ORDER BY f.n), '') AS ids FROM (SELECT DISTINCT id FROM r) LEFT JOIN f USING (id) GROUP BY id""")
def distinct_ids(t) -> DataFrame:
    """The ids each order names, without blanks, once each and in the order they come."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    listed = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    ids = F.transform("r", lambda x: F.when(x["l_suppkey"] % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), (x["l_suppkey"] % 5).cast("string"))))
    return listed.select("id", F.array_join(texts.distinct_ids(ids), ",").alias("ids"))


@query("value_consensus", """
WITH m AS (SELECT ts::DATE AS day, event_type, count(value) AS n, median(value) AS mid, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN mid <> 0 THEN greatest(hi - mid, mid - lo) / abs(mid) ELSE 0 END AS dev FROM m)
SELECT day::VARCHAR AS day, event_type, n, round(mid, 6) AS median, round(dev, 6) AS max_deviation,
  round(CASE WHEN n = 1 THEN 0.7 WHEN dev <= 0.05 THEN 1 - dev / 0.05 * 0.3 ELSE greatest(0.0, 0.5 - (dev - 0.05)) END, 6) AS score FROM d""")
def value_consensus(t) -> DataFrame:
    """Agreement of the values reported per day and type."""
    out = numbers.consensus(t.events.select(F.to_date("ts").alias("day"), "event_type", "value"), ["day", "event_type"])
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "max_deviation", "score")])


@query("value_clusters")
def value_clusters(t) -> DataFrame:
    """Values of every day clustered round their first occurrence, with the types that report them."""
    values = t.events.select(F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), "value", F.col("event_type").alias("domain"))
    return numbers.value_clusters(values, ["day"])


@query("closest_reference", """
WITH r AS (SELECT user_id, list(DISTINCT value) AS refs FROM events WHERE event_type = 'purchase' GROUP BY 1),
n AS (SELECT event_id, e.user_id, value, refs FROM events e LEFT JOIN r USING (user_id) WHERE event_type = 'view'),
c AS (SELECT *, list_sort(list_transform(refs, lambda x: {'d': abs(x - value), 'r': x}))[1].r AS closest FROM n)
SELECT event_id, closest, round(CASE WHEN closest <> 0 THEN abs(value - closest) / abs(closest) END, 6) AS deviation,
  closest IS NULL OR coalesce(abs(value - closest) / abs(closest) > 0.05, TRUE) AS flagged FROM c""")
def closest_reference(t) -> DataFrame:
    """Viewed values against the nearest purchased value of the same user."""
    e = t.events
    nums = e.filter(F.col("event_type") == "view").select("event_id", "user_id", "value")
    refs = e.filter(F.col("event_type") == "purchase").select("user_id", "value")
    return numbers.closest_reference(nums, refs, ["user_id"]).select("event_id", "closest", F.round("deviation", 6).alias("deviation"), "flagged")


@query("lexical_duplicates", f"""
WITH d AS (SELECT doc_id, unnest({s.words('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
b AS (SELECT item_id, unnest({s.words('text')}) AS term FROM benchmark), qf AS (SELECT item_id, term, count(*) AS qf FROM b GROUP BY 1, 2),
dn AS (SELECT doc_id, sqrt(sum((tf * tf)::DOUBLE)) AS n FROM tf GROUP BY 1), qn AS (SELECT item_id, sqrt(sum((qf * qf)::DOUBLE)) AS n FROM qf GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum((tf * qf)::DOUBLE) AS dot FROM tf JOIN qf USING (term) GROUP BY 1, 2),
dc AS (SELECT doc_id, list_distinct(string_split(lower(text), '')) AS c FROM documents), qc AS (SELECT item_id, list_distinct(string_split(lower(text), '')) AS c FROM benchmark),
sim AS (SELECT item_id, doc_id, round((dot / (dn.n * qn.n) + len(list_intersect(dc.c, qc.c)) / len(list_distinct(list_concat(dc.c, qc.c)))) / 2, 6) AS similarity
  FROM dots JOIN dn USING (doc_id) JOIN qn USING (item_id) JOIN dc USING (doc_id) JOIN qc USING (item_id))
SELECT * FROM (SELECT item_id, doc_id, similarity, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM sim WHERE similarity >= 0.7) WHERE rank <= 20""")
def lexical_duplicates(t) -> DataFrame:
    """Documents closest in words and characters to every benchmark text."""
    out = duplicates.lexical_neighbors(t.documents, t.benchmark, "doc_id", "item_id")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("content_groups", "SELECT md5(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_groups(t) -> DataFrame:
    """Documents of equal text."""
    return duplicates.content_groups(t.documents, "doc_id")
