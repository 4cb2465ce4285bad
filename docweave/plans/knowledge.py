"""Queries over bases, pages and links, and over experiments and strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.operators import context, dense, experiments as ex, graph
from docweave.plans import sqlparts as s
from docweave.plans.catalog import query
from docweave.session import cut_lineage


def titled_documents(t) -> DataFrame:
    """Documents as pages whose title is their first word."""
    return t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("kb_id"), F.regexp_extract("text", r"^([\p{L}]+)", 1).alias("title"),
        F.col("text").alias("content"), F.lit("active").alias("status"))


@query("derive_links", r"""
WITH p AS (SELECT doc_id AS id, source AS kb_id, regexp_extract(text, '^([\p{L}]+)', 1) AS title, lower(regexp_replace(text, '\s+', '', 'g')) AS hay FROM documents),
t AS (SELECT kb_id, lower(title) AS norm, min(title) AS title FROM p WHERE length(title) >= 2 GROUP BY 1, 2),
m AS (SELECT p.id, t.title, instr(hay, norm) AS position FROM p JOIN t ON t.kb_id = p.kb_id AND contains(hay, norm) AND norm <> lower(p.title))
SELECT * FROM (SELECT id, title, position, row_number() OVER (PARTITION BY id ORDER BY position, title) AS place FROM m) WHERE place <= 8""")
def derive_links(t) -> DataFrame:
    """Links of every document to the titles of its base found in its text."""
    return graph.fill_links(titled_documents(t)).select("id", "title", F.col("position").cast("long").alias("position"), F.col("place").cast("long").alias("place"))


PAGES = """pages_ AS (SELECT o_orderkey AS id, o_custkey % 25 AS kb_id, 'P ' || o_orderkey AS title, o_totalprice::BIGINT % 300 AS size, CASE WHEN o_orderkey % 40 = 0 THEN 'deleted' ELSE 'active' END AS status FROM orders),
links_ AS (SELECT l_orderkey AS id, 'p' || (l_partkey * 7) AS link FROM lineitem),
idx AS (SELECT DISTINCT kb_id, 'p' || id AS norm FROM pages_ WHERE id % 3 = 0)"""


def order_pages(t) -> DataFrame:
    """Orders as pages: lines are links, every third page is in its base's index."""
    links = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.concat(F.lit("P"), (F.col("l_partkey") * 7).cast("string"))).alias("links"))
    base = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("kb_id"), F.lit("entity").alias("page_type"),
        F.concat(F.lit("P "), F.col("o_orderkey").cast("string")).alias("title"),
        F.repeat(F.lit("x"), (F.round("o_totalprice").cast("long") % 300).cast("int")).alias("content"),
        F.when(F.col("o_orderkey") % 40 == 0, "deleted").otherwise("active").alias("status"))
    none = F.array().cast("array<string>")
    pages = base.join(links, "id", "left").withColumn("links", F.coalesce("links", none)).withColumn(
        "source_doc_ids", F.when(F.size("links") > 1, F.col("links")).otherwise(none))
    # one index page per part of a base, so that no page text grows with the base
    index = base.filter(F.col("id") % 3 == 0).select(
        (-F.col("id")).alias("id"), "kb_id", F.lit("index").alias("page_type"), F.concat(F.lit("I"), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("[["), F.col("title"), F.lit("]]")).alias("content"), F.lit("active").alias("status"), none.alias("links"), none.alias("source_doc_ids"))
    return pages.unionByName(index)


@query("lint_pages", f"""WITH {PAGES}, act AS (SELECT *, 'p' || id AS norm FROM pages_ WHERE status = 'active'), names AS (SELECT DISTINCT kb_id, norm FROM act UNION SELECT kb_id, 'i' || substr(norm, 2) FROM idx),
lk AS (SELECT act.id, kb_id, norm, link FROM act JOIN links_ USING (id)), n AS (SELECT id, count(*) AS n FROM links_ GROUP BY 1),
issues AS (SELECT id, 'broken_link' AS rule FROM lk WHERE NOT EXISTS (SELECT 1 FROM names WHERE names.kb_id = lk.kb_id AND names.norm = lk.link)
  UNION ALL SELECT id, 'orphan_page' FROM act WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.kb_id = act.kb_id AND idx.norm = act.norm) AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.kb_id = act.kb_id AND lk.link = act.norm AND lk.link <> lk.norm)
  UNION ALL SELECT id, 'missing_in_index' FROM act WHERE kb_id IN (SELECT kb_id FROM idx) AND NOT EXISTS (SELECT 1 FROM idx WHERE idx.kb_id = act.kb_id AND idx.norm = act.norm)
  UNION ALL SELECT act.id, 'empty_source' FROM act LEFT JOIN n USING (id) WHERE coalesce(n, 0) <= 1
  UNION ALL SELECT id, 'abnormal_size' FROM act WHERE size > 0 AND size < 200 OR size > 20000)
SELECT id, rule, count(*) AS issues FROM issues GROUP BY 1, 2""")
def lint_pages(t) -> DataFrame:
    """Broken links, orphans, pages outside the index, empty sources and odd sizes."""
    return graph.lint_pages(order_pages(t)).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("issues"))


@query("index_lines", f"""WITH {PAGES} SELECT kb_id, 'entity' AS page_type, '' AS title, '## 实体页（' || count(*) || '）' AS line FROM pages_ WHERE status = 'active' GROUP BY 1
UNION ALL SELECT kb_id, 'entity', title, '- [[' || title || ']]' FROM pages_ WHERE status = 'active'""")
def index_lines(t) -> DataFrame:
    """Index page of every base as ordered lines."""
    return graph.index_lines(order_pages(t))


NAV = f"""{s.VECTORS}, pr AS (SELECT a.vec_id AS q, b.vec_id AS p, list_inner_product(a.e, b.e) AS sc FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY round(sc, 6) DESC, p) AS rank FROM pr)"""


@query("navigate", f"""WITH RECURSIVE {NAV}, near AS (SELECT q AS p, list(p ORDER BY rank) AS ns FROM r WHERE rank <= 3 GROUP BY 1),
e AS (SELECT r.q, r.p, rank, ns FROM r JOIN near ON near.p = r.p WHERE rank <= 4),
w AS (SELECT DISTINCT q, 0::BIGINT AS i, []::BIGINT[] AS seen FROM e
  UNION ALL SELECT w.q, w.i + 1, CASE WHEN list_contains(seen, e.p) THEN seen ELSE list_concat(list_append(seen, e.p), list_filter(ns, lambda x: NOT list_contains(list_append(seen, e.p), x))) END
  FROM w JOIN e ON e.q = w.q AND e.rank = w.i + 1),
l AS (SELECT q, seen[1:8] AS s FROM w WHERE i = 4)
SELECT q AS query_id, unnest(s) AS page_id, generate_subscripts(s, 1) AS rank FROM l""")
def navigate(t) -> DataFrame:
    """Four nearest pages of every page, each followed by its own three nearest."""
    top = dense.dense_top_k(t.embeddings, t.embeddings, 4, "vec_id", "vec_id", exclude_self=True)
    entries = top.select("query_id", F.col("id").alias("page_id"), "rank")
    links = top.filter(F.col("rank") <= 3).select(F.col("query_id").alias("page_id"), F.col("id").alias("target_id"), (F.col("rank") - 1).alias("place"))
    return graph.navigate(entries, links, 3, 8).withColumn("rank", F.col("rank").cast("long"))


@query("entry_pages", f"""WITH {NAV}, k AS (SELECT q, p, rank, CASE WHEN label < 5 THEN 'wiki' ELSE 'raw' END AS kind FROM r JOIN v ON vec_id = p WHERE rank <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY rank) AS i FROM k),
o AS (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY CASE kind WHEN 'wiki' THEN 1 ELSE 2 END, i) AS rank FROM n WHERE i <= 3)
SELECT q AS query_id, p AS page_id, rank FROM o WHERE rank <= 5""")
def entry_pages(t) -> DataFrame:
    """Compiled pages first, then raw ones, at most three each and five in all."""
    kinds = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "wiki").otherwise("raw").alias("source_kind"))
    hits = dense.dense_top_k(t.embeddings, t.embeddings, 20, "vec_id", "vec_id", exclude_self=True).join(kinds, "id")
    return graph.entry_pages(hits, ["wiki", "raw"], 3, 5).select("query_id", F.col("id").alias("page_id"), F.col("rank").cast("long").alias("rank"))


@query("expand_links")
def expand_links(t) -> DataFrame:
    """Chunks of linked pages appended to the hits of every page."""
    active = order_pages(t)
    hits = t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("document_id"), F.col("l_extendedprice").alias("score")).groupBy(
        "query_id", "document_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id")
    hits = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5).withColumn("source_kind", F.lit("wiki"))
    chunks = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").cast("string").alias("content"))
    return context.expand_links(hits, active, chunks).select("query_id", "document_id", "chunk_index", "position", "score")


@query("kb_recommend", f"""WITH {NAV}, h AS (SELECT q, label AS kb, sc FROM (SELECT q, p, sc, row_number() OVER (PARTITION BY q ORDER BY round(sc, 6) DESC, p) AS rank FROM pr) JOIN v ON vec_id = p WHERE rank <= 20),
a AS (SELECT q, kb, avg(sc) AS c, count(*) AS n FROM h GROUP BY 1, 2),
f AS (SELECT vec_id, label, e FROM v WHERE vec_id IN (SELECT min(vec_id) FROM v GROUP BY label)),
pri AS (SELECT a.q, a.kb, greatest(0.0, list_cosine_similarity(v.e, f.e)) AS prior FROM a JOIN v ON v.vec_id = a.q JOIN f ON f.label = a.kb),
x AS (SELECT q, kb, n, c * 0.7 + prior * 0.3 AS rel FROM a JOIN pri USING (q, kb))
SELECT * FROM (SELECT q AS query_id, kb AS kb_id, n AS matched_chunks, round(rel, 6) AS relevance_score, row_number() OVER (PARTITION BY q ORDER BY round(rel, 6) DESC, kb) AS rank FROM x) WHERE rank <= 3""")
def kb_recommend(t) -> DataFrame:
    """Three bases per vector by its hits and the vector of each base's first page."""
    label = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("kb_id"))
    hits = dense.dense_top_k(t.embeddings, t.embeddings, 20, "vec_id", "vec_id", exclude_self=True).join(label, "id").select("query_id", "kb_id", "score")
    index = t.embeddings.groupBy(F.col("label").alias("kb_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    asked = hits.select("query_id", "kb_id").distinct().join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    out = graph.recommend_bases(hits, graph.route_priors(asked, index))
    return out.select("query_id", "kb_id", "matched_chunks", F.round("relevance_score", 6).alias("relevance_score"), F.col("rank").cast("long").alias("rank"))


@query("knowledge_graph", f"""WITH {s.VECTORS} SELECT 'kb:' || label AS source, 'doc:' || vec_id AS target, 'contains' AS type, 1.0::DOUBLE AS weight FROM v
UNION ALL SELECT 'doc:' || a.vec_id, 'doc:' || b.vec_id, 'similar', round(list_cosine_similarity(a.e, b.e), 6) FROM v a JOIN v b ON a.vec_id < b.vec_id AND round(list_cosine_similarity(a.e, b.e), 6) > 0.35""")
def knowledge_graph(t) -> DataFrame:
    """Edges between bases and documents and between similar documents."""
    docs = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("kb_id"))
    _, edges = graph.knowledge_graph(docs, t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), 0.35)
    return edges.withColumn("weight", F.round("weight", 6))


@query("compare_answers", f"""WITH {s.VECTORS}, p AS (SELECT a.label AS question_id, list_cosine_similarity(a.e, b.e) AS sc FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
m AS (SELECT question_id, avg(sc) AS m FROM p GROUP BY 1), n AS (SELECT label AS question_id, count(*) AS answers FROM v GROUP BY 1)
SELECT question_id, answers, round(coalesce(m, 1), 2) AS similarity_score, CASE WHEN coalesce(m, 1) >= 0.8 THEN 'high' WHEN coalesce(m, 1) >= 0.5 THEN 'medium' ELSE 'low' END AS consistency FROM n LEFT JOIN m USING (question_id)""")
def compare_answers(t) -> DataFrame:
    """Mean similarity of the answers to every question."""
    return graph.compare_answers(t.embeddings.select(F.col("label").alias("question_id"), F.col("vec_id").alias("kb_id"), "embedding"))


@query("match_titles", f"""WITH RECURSIVE {s.VECTORS}, c AS (SELECT label, vec_id, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM v WHERE vec_id % 2 = 1),
p AS (SELECT label, vec_id, e, (vec_id * 3)::VARCHAR AS title FROM v WHERE vec_id % 2 = 0),
same AS (SELECT label, c.vec_id AS cand, p.vec_id AS page FROM c JOIN p USING (label) WHERE title = c.vec_id::VARCHAR),
turns AS (SELECT label, vec_id, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM c WHERE vec_id NOT IN (SELECT cand FROM same)),
near AS (SELECT label, t.n, t.vec_id AS cand, p.vec_id AS page, round(list_cosine_similarity(t.e, p.e), 6) AS score FROM turns t JOIN p USING (label)
  WHERE p.vec_id NOT IN (SELECT page FROM same) AND round(list_cosine_similarity(t.e, p.e), 6) >= 0.2),
options AS (SELECT label, n, cand, list(page ORDER BY score DESC, page) AS pages FROM near GROUP BY ALL),
steps AS (SELECT label, 0::BIGINT AS n, NULL::BIGINT AS cand, NULL::BIGINT AS page, []::BIGINT[] AS taken FROM (SELECT DISTINCT label FROM v)
  UNION ALL SELECT label, n, cand, page, CASE WHEN page IS NULL THEN taken ELSE list_append(taken, page) END FROM (
    SELECT s.label, s.n + 1 AS n, o.cand, list_filter(o.pages, lambda x: NOT list_contains(s.taken, x))[1] AS page, s.taken FROM steps s LEFT JOIN options o ON o.label = s.label AND o.n = s.n + 1
    WHERE s.n < (SELECT count(*) FROM turns)))
SELECT label AS kb_id, cand AS cand_id, page AS page_id, 'title' AS how FROM same UNION ALL SELECT label, cand, page, 'vector' FROM steps WHERE page IS NOT NULL""")
def match_titles(t) -> DataFrame:
    """Odd vectors matched one to one with even ones of their class, best first in order."""
    e = t.embeddings
    cand = e.filter(F.col("vec_id") % 2 == 1).select(F.col("label").alias("kb_id"), F.col("vec_id").alias("cand_id"), F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("title"))
    pages = e.filter(F.col("vec_id") % 2 == 0).select(F.col("label").alias("kb_id"), F.col("vec_id").alias("page_id"), (F.col("vec_id") * 3).cast("string").alias("title"))
    # classes of equal vectors meet; in each base a class has a queue of its own pages
    vectors = cut_lineage(dense.distinct_vectors(e, "vec_id").filter(F.exists("embedding", lambda x: x != 0)).select("id", F.col("embedding").alias("v")))
    return graph.match_titles_by_vector(cand, pages, cut_lineage(dense.members(e, "vec_id").select("copy", "id")), vectors, 0.2)


@query("fact_retention", f"""WITH {s.CHANNELS}, f AS (SELECT label AS page, query_id, max(round(score, 6)) >= 0.35 AS kept FROM dense JOIN v ON vec_id = query_id WHERE rank <= 5 GROUP BY 1, 2)
SELECT page::VARCHAR AS page_id, count(*) AS facts, count(*) FILTER (WHERE kept) AS retained, round(avg(kept::INT), 4) AS rate FROM f GROUP BY GROUPING SETS ((1), ())""")
def fact_retention(t) -> DataFrame:
    """Share of facts (vectors) with a close enough sentence (other vector), per page and in all."""
    best = dense.dense_top_k(t.embeddings, t.embeddings, 1, "vec_id", "vec_id", exclude_self=True)
    facts = best.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select(
        F.col("label").cast("string").alias("page_id"), F.col("query_id").alias("fact_id"), F.round("score", 6).alias("best"))
    return graph.fact_retention(facts, 0.35)


# experiments and strategies -------------------------------------------------------------------

BUCKETS = """b AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey || '-exp1'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS h FROM customer),
a AS (SELECT c_custkey AS user_id, CASE WHEN h <= 0.5 THEN 'control' WHEN h <= 0.8 THEN 'treatment' END AS variant_id FROM b)"""


def experiment_variants(t) -> DataFrame:
    return t.spark.createDataFrame([("exp1", 0, "control", 0.5), ("exp1", 1, "treatment", 0.3)], "experiment_id string, pos int, variant_id string, weight double")


def assigned(t) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("exp1").alias("experiment_id"))
    return ex.assign_variants(users, experiment_variants(t))


@query("variant_assignment", f"WITH {BUCKETS} SELECT user_id, variant_id FROM a")
def variant_assignment(t) -> DataFrame:
    """Variant of every user; a fifth fall outside the weights."""
    return assigned(t).select("user_id", "variant_id")


@query("variant_shares", f"WITH {BUCKETS} SELECT variant_id, count(*) AS users, round(count(*) / (SELECT count(*) FROM a), 6) AS share, CASE variant_id WHEN 'control' THEN 0.5::DOUBLE WHEN 'treatment' THEN 0.3 END AS weight FROM a GROUP BY 1")
def variant_shares(t) -> DataFrame:
    """Realised share of every variant beside its weight."""
    return ex.realised_shares(assigned(t), experiment_variants(t)).select("variant_id", "users", "share", "weight")


@query("experiment_summary", """SELECT event_type AS variant_id, CASE WHEN user_id % 2 = 0 THEN 'accuracy' ELSE 'latency' END AS metric_name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY 1, 2""")
def experiment_summary(t) -> DataFrame:
    """Mean, deviation and count per variant (event type) and metric."""
    return ex.analyze_experiment(metrics(t)).select("variant_id", "metric_name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def metrics(t) -> DataFrame:
    return t.events.select(F.lit("e").alias("experiment_id"), F.col("event_type").alias("variant_id"),
                           F.when(F.col("user_id") % 2 == 0, "accuracy").otherwise("latency").alias("metric_name"), F.col("value").alias("metric_value"))


@query("experiment_winner", """WITH a AS (SELECT event_type AS v, user_id % 2 AS m, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1, 2)
SELECT 'e' AS experiment_id, max(n) AS sample_size, (SELECT v FROM a WHERE m = 0 ORDER BY mean DESC, v LIMIT 1) AS winner FROM a""")
def experiment_winner(t) -> DataFrame:
    return ex.winners(ex.analyze_experiment(metrics(t)))


EXEC = """x AS (SELECT l_orderkey AS id, avg(l_quantity - 25) > 0 AS label FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS id, label, (o_orderkey % 100) / 100.0::DOUBLE AS c1, (o_custkey % 50) / 50.0::DOUBLE AS c2, o_totalprice > 150 AS decision, (o_custkey % 10) / 10.0::DOUBLE AS confidence FROM orders JOIN x ON l_id = o_orderkey)""".replace("AS id, avg", "AS l_id, avg")


def samples(t) -> DataFrame:
    """Orders as executions with two strategies; the lines are their feedback."""
    e = t.orders.select(
        F.col("o_orderkey").alias("execution_id"), F.create_map(F.lit("keyword"), (F.col("o_orderkey") % 100) / 100.0, F.lit("context"), (F.col("o_custkey") % 50) / 50.0).alias("strategy_results"),
        (F.col("o_totalprice") > 150).alias("decision"), ((F.col("o_custkey") % 10) / 10.0).alias("confidence"))
    fb = t.lineitem.select(F.col("l_orderkey").alias("execution_id"), (F.col("l_quantity") - 25).alias("value"))
    return ex.training_samples(e, fb)


@query("strategy_accuracy", f"""WITH {EXEC} SELECT 'keyword' AS strategy, count(*) AS n, round(avg(((c1 > 0.5) = label)::INT), 6) AS accuracy FROM s
UNION ALL SELECT 'context', count(*), round(avg(((c2 > 0.5) = label)::INT), 6) FROM s""")
def strategy_accuracy(t) -> DataFrame:
    """How often each strategy agreed with the feedback."""
    return ex.strategy_accuracy(samples(t)).withColumn("accuracy", F.round("accuracy", 6))


@query("strategy_weights", f"""WITH {EXEC}, a AS (SELECT 'keyword' AS strategy, 0.6::DOUBLE AS weight, avg(((c1 > 0.5) = label)::INT) AS acc FROM s UNION ALL SELECT 'context', 0.4, avg(((c2 > 0.5) = label)::INT) FROM s),
r AS (SELECT strategy, greatest(0.05, least(0.95, weight + 0.01 * (acc - (SELECT avg(acc) FROM a)))) AS raw FROM a)
SELECT strategy, round(raw / (SELECT sum(raw) FROM r), 9) AS new_weight FROM r""")
def strategy_weights(t) -> DataFrame:
    """Weights moved toward the more accurate strategy."""
    sm = samples(t)
    weights = t.spark.createDataFrame([("keyword", 0.6), ("context", 0.4)], "strategy string, weight double")
    out = ex.weight_adjustments(ex.strategy_accuracy(sm), weights, sm.limit(50).count())
    return out.select("strategy", F.round("new_weight", 9).alias("new_weight"))


@query("threshold_update", f"""WITH {EXEC} SELECT round(greatest(0.1, least(0.9, avg(CASE WHEN label THEN confidence END) - 0.1)), 6) AS threshold, count(*) FILTER (WHERE label) AS positives FROM s""")
def threshold_update(t) -> DataFrame:
    return ex.threshold_update(samples(t)).withColumn("threshold", F.round("threshold", 6))


@query("vote_fusion", """WITH v AS (SELECT l_orderkey AS id, l_quantity / 50 AS c, l_returnflag = 'R' AS yes, l_linenumber / 10.0::DOUBLE AS w FROM lineitem),
a AS (SELECT id, coalesce(sum(CASE WHEN c >= 0.35 THEN w END), 0) AS w, sum(CASE WHEN c >= 0.35 THEN w * CASE WHEN yes THEN c ELSE 1 - c END END) AS s FROM v GROUP BY 1)
SELECT id AS execution_id, coalesce(w > 0 AND round(s / w, 12) >= 0.5, FALSE) AS decision, round(CASE WHEN w = 0 THEN 0 ELSE least(0.99, CASE WHEN round(s / w, 12) >= 0.5 THEN s / w ELSE 1 - s / w END) END, 6) AS confidence FROM a""")
def vote_fusion(t) -> DataFrame:
    """Weighted votes (lines) per execution (order)."""
    votes = t.lineitem.select(F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").cast("string").alias("strategy"), (F.col("l_returnflag") == "R").alias("result"),
                              (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_linenumber") / 10.0).alias("weight"))
    return ex.fuse_votes(votes).withColumn("confidence", F.round("confidence", 6))


MISSED = r"""c AS (SELECT d.text, quality = 1 AS decision, n_chars % 2 = 0 AS label FROM documents d JOIN labels USING (doc_id)),
m AS (SELECT CASE WHEN decision THEN 'false_positive' ELSE 'false_negative' END AS kind, text FROM c WHERE decision <> label)"""


def missed(t) -> DataFrame:
    cases = t.documents.join(t.labels.select("doc_id", (F.col("quality") == 1).alias("decision")), "doc_id").select(
        F.col("text").alias("question"), "decision", (F.col("n_chars") % 2 == 0).alias("label"))
    return ex.misclassified(cases)


@query("ngram_mining", rf"""WITH {MISSED}, w AS (SELECT kind, list_filter(regexp_split_to_array(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), '\s+'), lambda x: x <> '') AS ws FROM m),
p AS (SELECT kind, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS pattern FROM w),
n AS (SELECT kind, pattern, count(*) AS frequency FROM p GROUP BY 1, 2 HAVING count(*) >= 3), q AS (SELECT kind, count(*) AS questions FROM m GROUP BY 1)
SELECT * FROM (SELECT kind, pattern, frequency, round(frequency / questions, 3) AS coverage, row_number() OVER (PARTITION BY kind ORDER BY frequency DESC, pattern) AS rank FROM n JOIN q USING (kind)) WHERE rank <= 20""")
def ngram_mining(t) -> DataFrame:
    """Most frequent words and word pairs of wrongly judged texts."""
    return ex.common_patterns(missed(t), ["kind"]).withColumn("rank", F.col("rank").cast("long"))


@query("suggested_keywords", rf"""WITH {MISSED}, w AS (SELECT unnest(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+'), lambda x: length(x) >= 2)) AS keyword FROM m)
SELECT keyword, count(*) AS frequency FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def suggested_keywords(t) -> DataFrame:
    return ex.suggested_keywords(missed(t))


@query("metric_rows", """SELECT user_id % 7 AS experiment_id, event_type AS variant_id, 'm' || (event_id % 3) AS metric_name,
  row_number() OVER (PARTITION BY user_id % 7, event_type, event_id % 3 ORDER BY event_id) - 1 AS place, value FROM events""")
def metric_rows(t) -> DataFrame:
    """Recorded values of every experiment, variant and metric, numbered in their order."""
    rows = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("experiment_id"), F.col("event_type").alias("variant_id"),
                           F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("metric_name"), "value")
    return ex.metric_rows(rows)
