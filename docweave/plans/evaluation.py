"""Evaluation queries: quality of retrieval arms, significance, sweeps, coverage, answers, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave.operators import context, evaluate as ev, lexical
from docweave.plans import sqlparts as s
from docweave.plans.catalog import query
from docweave.session import cut_lineage
from docweave.plans.retrieval import PACKED, gate_hits, line_hits, packed

GOLDEN = "golden AS (SELECT item_id AS query_id, doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

KINDS = """kinds AS (SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'no_answer' WHEN n > 1 THEN 'multi_hop' ELSE 'policy' END AS category
  FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n FROM golden GROUP BY 1) g ON g.query_id = item_id)"""

VARIANTS = """cut AS (SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda x, i: i % 3 = 1), ' ') AS text FROM benchmark)"""


def _ranked(scores: str, k: int = 10) -> str:
    return (f"SELECT item_id AS query_id, doc_id AS document_id, rank, score FROM ({s.ranked(scores, 'item_id', 'doc_id', k)})")


def _metrics(ranked: str, k: int = 5) -> str:
    return f"""SELECT g.query_id, max(CASE WHEN r.rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS hit,
  coalesce(1.0::DOUBLE / min(r.rank), 0) AS mrr, count(r.rank) / count(*) AS recall
  FROM golden g LEFT JOIN (SELECT * FROM {ranked} WHERE rank <= {k}) r ON r.query_id = g.query_id AND r.document_id = g.document_id GROUP BY 1"""


FULL = f"""{GOLDEN}, {KINDS}, {s.bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
full_ranked AS ({_ranked('scores')}), full_m AS ({_metrics('full_ranked')})"""

BOTH = f"""{FULL}, {VARIANTS}, {s.bm25('documents', 'doc_id', 'text', 'cut', 'item_id', 'text', 'c_')},
cut_ranked AS ({_ranked('c_scores')}), cut_m AS ({_metrics('cut_ranked')}),
arms AS (SELECT 'cut' AS arm, category, m.* FROM cut_m m JOIN kinds USING (query_id)
  UNION ALL SELECT 'full', category, m.* FROM full_m m JOIN kinds USING (query_id)),
scored AS (SELECT arm, coalesce(category, 'all') AS category, count(*) AS n, round(avg(hit), 4) AS hit_rate, round(avg(mrr), 4) AS mrr,
  round(avg(recall), 4) AS recall FROM arms GROUP BY GROUPING SETS ((arm, category), (arm)))"""


def golden_of(t) -> DataFrame:
    return cut_lineage(lexical.containing_documents(t.documents, t.benchmark, "doc_id", "item_id").select(
        F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id")))


def ranking(t, questions: DataFrame, k: int = 10) -> DataFrame:
    return cut_lineage(lexical.bm25_top_k(t.documents, questions, ["doc_id"], "item_id", k).select(
        F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id"), "rank", "score"))


def cut_questions(t) -> DataFrame:
    """Questions reduced to every third word."""
    return t.benchmark.select("item_id", F.array_join(F.filter(F.split("text", " "), lambda x, i: i % 3 == 0), " ").alias("text"))


@query("golden_documents", f"WITH {GOLDEN} SELECT query_id, document_id FROM golden")
def golden_documents(t) -> DataFrame:
    """Documents that hold a benchmark passage word for word."""
    return golden_of(t)


@query("retrieval_eval", f"""WITH {FULL},
rows AS (SELECT b.item_id, hit, mrr, recall, coalesce(r.score, 0) AS score FROM benchmark b LEFT JOIN full_m m ON m.query_id = b.item_id
  LEFT JOIN full_ranked r ON r.query_id = b.item_id AND r.rank = 1)
SELECT count(*) AS num_questions, count(hit) AS num_answerable, count(*) - count(hit) AS num_no_answer,
  round(coalesce(avg(hit), 0), 6) AS hit_rate, round(coalesce(avg(mrr), 0), 6) AS mrr, round(coalesce(avg(recall), 0), 6) AS recall,
  round(median(CASE WHEN hit IS NOT NULL THEN score END), 4) AS answerable_top1_median,
  round(median(CASE WHEN hit IS NULL THEN score END), 4) AS no_answer_top1_median,
  round(median(CASE WHEN hit IS NULL THEN score END) / median(CASE WHEN hit IS NOT NULL THEN score END), 4) AS no_answer_separation FROM rows""")
def retrieval_eval(t) -> DataFrame:
    """Quality report of BM25 over the documents for every benchmark passage."""
    questions = t.benchmark.select(F.col("item_id").alias("query_id"))
    return ev.quality_report(questions, ranking(t, t.benchmark), golden_of(t), 5)


@query("question_metrics", f"WITH {FULL} SELECT query_id, hit, round(mrr, 6) AS mrr, round(recall, 6) AS recall FROM full_m")
def question_metrics(t) -> DataFrame:
    """Hit, reciprocal rank and recall at 5 of every answerable question."""
    m = ev.golden_metrics(ranking(t, t.benchmark), golden_of(t), 5)
    return m.withColumns({"mrr": F.round("mrr", 6), "recall": F.round("recall", 6)})


@query("chunk_metrics", f"""WITH {GOLDEN}, {s.LINE_CHUNKS}, {s.bm25('chunks', 'document_id, chunk_index', 'content', 'benchmark', 'item_id', 'text')},
h AS (SELECT r.item_id AS query_id, rank, g.document_id IS NOT NULL AS rel FROM ({s.ranked('scores', 'item_id', 'document_id, chunk_index', 8)}) r
  LEFT JOIN golden g ON g.query_id = r.item_id AND g.document_id = r.document_id),
e AS (SELECT query_id, count(*) AS expected FROM golden GROUP BY 1)
SELECT query_id, max(rel::INT)::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel THEN rank END), 0), 6) AS mrr,
  round(avg(rel::INT), 6) AS precision, round(coalesce(sum(rel::INT) / any_value(expected), 0), 6) AS recall
FROM h LEFT JOIN e USING (query_id) GROUP BY query_id""")
def chunk_metrics(t) -> DataFrame:
    """Row-level metrics of line hits; several lines of a golden document all count."""
    hits, _ = line_hits(t)
    golden = golden_of(t)
    marked = hits.join(golden.withColumn("relevant", F.lit(True)), ["query_id", "document_id"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False)))
    expected = golden.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    out = ev.row_metrics(marked, expected)
    return out.withColumns({c: F.round(c, 6) for c in ("mrr", "precision", "recall")})


def arm_metrics(t) -> DataFrame:
    golden = golden_of(t)
    kinds = ev.categories(t.benchmark.select(F.col("item_id").alias("query_id")), golden)
    parts = [ev.golden_metrics(ranking(t, q), golden, 5).withColumn("arm", F.lit(arm))
             for arm, q in (("cut", cut_questions(t)), ("full", t.benchmark))]
    return parts[0].unionByName(parts[1]).join(kinds, "query_id")


@query("arm_scores", f"WITH {BOTH} SELECT arm, category, n, hit_rate, mrr, recall FROM scored")
def arm_scores(t) -> DataFrame:
    """Full questions against cut ones, per question kind and in all."""
    return ev.score_arms(arm_metrics(t))


@query("arm_comparison", f"""WITH {BOTH},
long AS (SELECT arm, category, metric, value FROM scored UNPIVOT (value FOR metric IN (hit_rate, mrr, recall)))
SELECT category, metric, f.value AS base_value, c.value AS new_value, round(c.value - f.value, 6) AS delta,
  round(c.value - f.value, 9) >= CASE metric WHEN 'mrr' THEN -0.1 ELSE -0.05 END AS ok
FROM (SELECT * FROM long WHERE arm = 'full') f JOIN (SELECT * FROM long WHERE arm = 'cut') c USING (category, metric)""")
def arm_comparison(t) -> DataFrame:
    """Every metric of the cut arm against the full arm with its tolerance."""
    scored = ev.score_arms(arm_metrics(t))
    base, new = (scored.filter(F.col("arm") == a).drop("arm", "n") for a in ("full", "cut"))
    return ev.compare_metric_rows(base, new, ["category"], {"hit_rate": 0.05, "mrr": 0.1, "recall": 0.05})


@query("gain_rule", f"""WITH {BOTH}
SELECT category, round(f.hit_rate - c.hit_rate, 6) AS hit_delta, round(f.recall - c.recall, 6) AS recall_delta,
  round(f.hit_rate - c.hit_rate, 6) >= 0.05 OR round(f.recall - c.recall, 6) >= 0.05 AS gain
FROM (SELECT * FROM scored WHERE arm = 'cut') c JOIN (SELECT * FROM scored WHERE arm = 'full') f USING (category)""")
def gain_rule(t) -> DataFrame:
    scored = ev.score_arms(arm_metrics(t))
    return ev.gain_rule(scored.filter(F.col("arm") == "cut"), scored.filter(F.col("arm") == "full"), "category")


@query("mcnemar", f"""WITH {BOTH},
p AS (SELECT c.hit > 0 AS a, f.hit > 0 AS b FROM cut_m c JOIN full_m f USING (query_id)),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b,
  count(*) FILTER (WHERE NOT a AND NOT b) AS neither, round(avg(a::INT), 6) AS hit_a, round(avg(b::INT), 6) AS hit_b FROM p)
SELECT *, round((only_b - only_a) * 100.0::DOUBLE / n, 2) AS delta_pp,
  CASE WHEN only_a + only_b = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(only_a, only_b)::BIGINT + 1),
    lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 6) END AS p_value FROM n""")
def mcnemar(t) -> DataFrame:
    """Exact paired test of the two arms."""
    m = arm_metrics(t)
    return ev.compare_arms(m.filter(F.col("arm") == "cut"), m.filter(F.col("arm") == "full"))


THRESHOLDS = [0.4, 0.8, 1.2, 1.6, 2.0, 2.4]


@query("threshold_sweep", f"""WITH {s.LINE_CHUNKS}, {GOLDEN}, {s.bm25('chunks', 'document_id, chunk_index', 'content', 'benchmark', 'item_id', 'text')},
top AS (SELECT item_id, max(round(score, 6)) / 20 AS top_score FROM scores GROUP BY 1),
samples AS (SELECT b.item_id, top_score, g.query_id IS NULL AS should_refuse FROM benchmark b LEFT JOIN top USING (item_id)
  LEFT JOIN (SELECT DISTINCT query_id FROM golden) g ON g.query_id = b.item_id),
x AS (SELECT *, coalesce(top_score >= threshold, FALSE) AS passed FROM samples, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)),
r AS (SELECT threshold, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS refused, count(*) FILTER (WHERE NOT passed AND NOT should_refuse) AS false_refuse,
  count(*) FILTER (WHERE passed AND should_refuse) AS missed, count(*) FILTER (WHERE passed) AS answered, min(CASE WHEN passed THEN top_score END) AS m FROM x GROUP BY 1)
SELECT threshold, n, refused, false_refuse, missed, answered, round(m, 6) AS min_answered_score,
  coalesce(false_refuse = 0 AND refused = (SELECT max(refused) FROM r WHERE false_refuse = 0), FALSE) AS recommended FROM r""")
def threshold_sweep(t) -> DataFrame:
    """Refusals, false refusals and misses of the gate at six thresholds."""
    top = gate_hits(t).groupBy("query_id").agg(F.max("rerank_score").alias("top_score"))
    known = golden_of(t).select("query_id").distinct().withColumn("known", F.lit(True))
    samples = t.benchmark.select(F.col("item_id").alias("query_id")).join(top, "query_id", "left").join(known, "query_id", "left").select(
        "query_id", "top_score", F.col("known").isNull().alias("should_refuse"))
    return ev.threshold_sweep(samples, THRESHOLDS).withColumn("min_answered_score", F.round("min_answered_score", 6))


FACTS = """facts AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)),
  lambda x: length(x) >= 5))) AS fact FROM benchmark)"""


def facts_of(t) -> DataFrame:
    """Sentences of every benchmark passage as the facts a context should hold."""
    parts = F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x)), lambda x: F.length(x) >= 5)
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(parts)).alias("fact"))


COVERAGE = f"""{FACTS}, each AS (SELECT f.query_id, fact, coalesce(bool_or(contains(content, fact)), FALSE) AS found
  FROM facts f LEFT JOIN hits h USING (query_id) GROUP BY 1, 2),
cov AS (SELECT query_id, count(*) AS facts, count(*) FILTER (WHERE found) AS found, round(count(*) FILTER (WHERE found) / count(*), 6) AS coverage FROM each GROUP BY 1)"""


@query("fact_coverage", f"""WITH RECURSIVE {PACKED}, {COVERAGE} SELECT query_id, facts, found, coverage FROM cov""")
def fact_coverage(t) -> DataFrame:
    """Share of the sentences of a passage found in the lines retrieved for it."""
    return ev.fact_coverage(line_hits(t)[0], facts_of(t))


@query("pooled_coverage", f"""WITH RECURSIVE {PACKED}, {GOLDEN}, {KINDS}, {COVERAGE}
SELECT category AS kind, count(*) AS questions, sum(facts)::BIGINT AS facts, sum(found)::BIGINT AS found, round(sum(found) / sum(facts), 6) AS pooled,
  round(avg(coverage), 6) AS mean_coverage FROM cov JOIN kinds USING (query_id) GROUP BY category""")
def pooled_coverage(t) -> DataFrame:
    """Pooled coverage beside the mean per question, by question kind."""
    kinds = ev.categories(t.benchmark.select(F.col("item_id").alias("query_id")), golden_of(t))
    cov = ev.fact_coverage(line_hits(t)[0], facts_of(t)).join(kinds.withColumnRenamed("category", "kind"), "query_id")
    return ev.coverage_by_kind(cov)


@query("first_fact_rank", f"""WITH RECURSIVE {PACKED}, {FACTS},
p AS (SELECT query_id, rank, avg(contains(content, fact)::INT) AS cov FROM hits JOIN facts USING (query_id) GROUP BY 1, 2)
SELECT query_id, min(rank) AS rank, round(arg_min(cov, rank), 6) AS coverage FROM p WHERE cov > 0 GROUP BY 1""")
def first_fact_rank(t) -> DataFrame:
    return ev.first_fact_rank(line_hits(t)[0], facts_of(t)).withColumn("rank", F.col("rank").cast("long"))


@query("loss_funnel", f"""WITH RECURSIVE {PACKED}, {FACTS},
stages AS (SELECT 'sparse' AS stage, query_id, rank, content FROM hits
  UNION ALL SELECT 'deduped', query_id, rank, content FROM unique_hits
  UNION ALL SELECT 'packed', query_id, position, content FROM packed),
r AS (SELECT query_id, fact, min(CASE stage WHEN 'sparse' THEN rank END) AS sparse, min(CASE stage WHEN 'deduped' THEN rank END) AS deduped,
  min(CASE stage WHEN 'packed' THEN rank END) AS packed FROM stages JOIN facts USING (query_id) WHERE contains(content, fact) GROUP BY 1, 2)
SELECT f.query_id, f.fact, sparse, deduped, packed, CASE WHEN coalesce(sparse, deduped, packed) IS NULL THEN 'never'
  WHEN sparse IS NOT NULL AND deduped IS NULL THEN 'deduped' WHEN deduped IS NOT NULL AND packed IS NULL THEN 'packed' END AS lost_at
FROM facts f LEFT JOIN r USING (query_id, fact)""")
def loss_funnel(t) -> DataFrame:
    """First rank of every fact after each stage and the stage that dropped it."""
    hits, _ = line_hits(t)
    chosen = packed(hits).select(F.lit("packed").alias("stage"), "query_id", F.col("position").cast("long").alias("rank"), "content")
    stages = chosen
    for name, df in (("sparse", hits), ("deduped", context.dedupe_content(hits))):
        stages = stages.unionByName(df.select(F.lit(name).alias("stage"), "query_id", F.col("rank").cast("long").alias("rank"), "content"))
    return ev.loss_funnel(stages, facts_of(t), ["sparse", "deduped", "packed"])


@query("config_sweep", f"""WITH {s.LINE_CHUNKS}, {GOLDEN}, {KINDS}, {FACTS}, {s.bm25('chunks', 'document_id, chunk_index', 'content', 'benchmark', 'item_id', 'text')},
hits AS (SELECT item_id AS query_id, rank, content FROM ({s.ranked('scores', 'item_id', 'document_id, chunk_index', 8)}) JOIN chunks USING (document_id, chunk_index)),
cells AS (SELECT unnest([1, 3, 5, 8]) AS k),
each AS (SELECT k, f.query_id, fact, coalesce(bool_or(contains(content, fact)), FALSE) AS found
  FROM cells CROSS JOIN facts f LEFT JOIN hits h ON h.query_id = f.query_id AND h.rank <= k GROUP BY 1, 2, 3),
cov AS (SELECT k, query_id, avg(found::INT) AS coverage FROM each GROUP BY 1, 2),
chars AS (SELECT k, query_id, sum(length(content)) AS n FROM cells JOIN hits ON rank <= k GROUP BY 1, 2)
SELECT k, category AS kind, count(*) AS questions, round(avg(coverage), 6) AS coverage, round(avg(n), 4) AS mean_chars
FROM cov JOIN kinds USING (query_id) LEFT JOIN chars USING (k, query_id) GROUP BY 1, 2""")
def config_sweep(t) -> DataFrame:
    """Mean coverage and size of the context per cut and question kind, from one retrieval."""
    cuts = [1, 3, 5, 8]
    hits, _ = line_hits(t)
    facts = facts_of(t)
    # per fact its first rank: every cut is then a comparison, not another search
    first = hits.select("query_id", "rank", "content").join(facts, "query_id").filter(
        ev.fact_hit(F.col("fact"), F.col("content"))).groupBy("query_id", "fact").agg(F.min("rank").alias("first"))
    cells = F.explode(F.array(*[F.lit(k) for k in cuts])).alias("k")
    found = F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")
    cov = facts.join(first, ["query_id", "fact"], "left").select("query_id", "first", cells).groupBy("k", "query_id").agg(
        F.avg(found).alias("coverage"))
    chars = hits.select("query_id", "rank", F.length("content").alias("c"), cells).filter(F.col("rank") <= F.col("k")).groupBy(
        "k", "query_id").agg(F.sum("c").alias("n"))
    kinds = ev.categories(t.benchmark.select(F.col("item_id").alias("query_id")), golden_of(t))
    return cov.join(kinds, "query_id").join(chars, ["k", "query_id"], "left").groupBy("k", F.col("category").alias("kind")).agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("n"), 4).alias("mean_chars"))


@query("provenance_metrics", f"""WITH {FULL}, mapped AS (SELECT query_id, min(rank) AS rank, CASE WHEN document_id % 3 = 0 THEN document_id - document_id % 6 ELSE document_id END AS document_id
  FROM full_ranked GROUP BY query_id, 3),
placed AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, document_id) AS rank FROM mapped),
m AS ({_metrics('placed')})
SELECT count(*) AS questions, round(avg(hit), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall FROM m""")
def provenance_metrics(t) -> DataFrame:
    """Metrics after pages are mapped to the document they were compiled from."""
    provenance = t.documents.filter(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("page_id"), (F.col("doc_id") - F.col("doc_id") % 6).alias("source_id"))
    mapped = ev.map_provenance(ranking(t, t.benchmark), provenance)
    return ev.golden_metrics(mapped, golden_of(t), 5).agg(
        F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("hit", "hit_rate"), ("mrr", "mrr"), ("recall", "recall"))])


PAIRS = r"""turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id, turn, text AS question, answer FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def question_answers(t) -> DataFrame:
    """User turns with the assistant turn right after them, joined by turn number."""
    c = t.conversations
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def _grams(x: str) -> str:
    flat = rf"""regexp_replace({x}, '[\s，。！？；：、,.!?;:"''“”‘’（）()\[\]【】<>《》\-—_/\\]+', '', 'g')"""
    return f"list_distinct(list_transform(range(1, length({flat})), lambda i: substr({flat}, i, 2)))"


@query("answer_quality", rf"""WITH {PAIRS},
g AS (SELECT conv_id, turn, question, answer, {_grams('question')} AS qg, {_grams('answer')} AS ag,
  regexp_extract_all(question, '\d+(?:\.\d+)?') AS qn FROM qa),
c AS (SELECT conv_id, turn, qg, qn, unnest(list_filter(list_transform(string_split_regex(answer, '[，,；;。！？!?、\n]+'), lambda x: trim(x)), lambda x: length(x) >= 4)) AS clause FROM g),
cg AS (SELECT conv_id, turn, qg, qn, {_grams('clause')} AS cg, regexp_extract_all(clause, '\d+(?:\.\d+)?') AS cn FROM c),
f AS (SELECT conv_id, turn, avg((coalesce(len(list_intersect(cg, qg)) / nullif(len(cg), 0), 0) >= 0.5 AND len(list_filter(cn, lambda n: NOT list_contains(qn, n))) = 0)::INT) AS score FROM cg GROUP BY 1, 2)
SELECT g.conv_id, g.turn, round(coalesce(score, 0), 4) AS faithfulness, round(CASE WHEN len(qg) > 0 THEN len(list_intersect(qg, ag)) / len(qg) ELSE 0 END, 4) AS relevance
FROM g LEFT JOIN f USING (conv_id, turn)""")
def answer_quality(t) -> DataFrame:
    """Word-level faithfulness (context = the question) and relevance of every answer."""
    qa = question_answers(t)
    faith = ev.lexical_faithfulness(qa, ["conv_id", "turn"], F.col("answer"), F.col("question"))
    relevant = qa.select("conv_id", "turn", ev.lexical_relevance(F.col("answer"), F.col("question")).alias("relevance"))
    return faith.join(relevant, ["conv_id", "turn"])


@query("trajectory_scores", """WITH runs AS (SELECT user_id, ts::DATE AS day, list(event_type) AS tools, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT *, list_contains(tools, 'view')::INT + list_contains(tools, 'purchase')::INT AS hit,
  CASE WHEN n <= 3 THEN 1.0::DOUBLE ELSE greatest(0.0, 1.0 - (n - 3) / 3) END AS steps FROM runs),
sc AS (SELECT *, (hit / 2 + steps + 2) / 4 AS score FROM x)
SELECT count(*) AS runs, round(avg(score), 4) AS traj_score, round(avg((score >= 0.7)::INT), 6) AS traj_pass_rate,
  round(avg(hit / 2), 6) AS tool_selection, round(avg(steps), 4) AS step_efficiency FROM sc""")
def trajectory_scores(t) -> DataFrame:
    """Every user day as a run of at most three steps that should view and purchase."""
    runs = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.collect_set("event_type").alias("tools"), F.count(F.lit(1)).alias("n_steps")).select(
        "n_steps",
        F.concat_ws(":", "user_id", "day").alias("id"), "tools", F.lit("done").alias("final_answer"),
        F.array(F.lit("view"), F.lit("purchase")).alias("expected_tools"), F.array().cast("array<string>").alias("expected_points"),
        F.lit(3).alias("max_steps"), F.lit(False).alias("require_all"))
    return ev.trajectory_scores(runs).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("score"), 4).alias("traj_score"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("traj_pass_rate"),
        F.round(F.avg("tool_selection"), 6).alias("tool_selection"), F.round(F.avg("step_efficiency"), 4).alias("step_efficiency"))


@query("order_statistics", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, round(quantile_cont(value, 0.95), 6) AS p95_linear,
  max(CASE WHEN i = ((n - 1) * 95) // 100 THEN value END) AS p95_floor,
  max(CASE WHEN i = least(n - 1, (n * 95) // 100) THEN value END) AS p95_capped FROM r GROUP BY 1""")
def order_statistics(t) -> DataFrame:
    """Three definitions of the 95th percentile of the value per event type."""
    e = t.events.select("event_type", "value")
    linear = e.groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95_linear"))
    floor = ev.order_statistic(e, ["event_type"], "value", ev.p95_floor, "p95_floor")
    capped = ev.order_statistic(e, ["event_type"], "value", ev.p95_capped, "p95_capped").drop("n")
    return floor.join(linear, "event_type").join(capped, "event_type")


@query("regression_gate", """WITH m AS (SELECT month(o_orderdate) AS mo, count(*) AS orders, avg(o_totalprice) AS ms FROM orders WHERE month(o_orderdate) <= 2 GROUP BY 1),
l AS (SELECT mo, 'rows' AS metric, orders::DOUBLE AS value FROM m UNION ALL SELECT mo, 'mean_ms', round(ms, 6) FROM m),
j AS (SELECT b.metric, b.value AS baseline, c.value AS current FROM (SELECT * FROM l WHERE mo = 1) b LEFT JOIN (SELECT * FROM l WHERE mo = 2) c USING (metric))
SELECT metric, baseline, current, CASE WHEN current IS NULL THEN 'missing' WHEN metric = 'rows' THEN CASE WHEN current = baseline THEN 'ok' ELSE 'fail' END
  WHEN current > baseline * 1.6 AND current - baseline >= 5 THEN 'fail' WHEN current > baseline * 1.6 THEN 'warn' ELSE 'ok' END AS verdict FROM j""")
def regression_gate(t) -> DataFrame:
    """Row counter and mean of February against January, judged as counter and as time."""
    m = t.orders.groupBy(F.month("o_orderdate").alias("mo")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.round(F.avg("o_totalprice"), 6).alias("mean_ms"))
    long = m.unpivot(["mo"], ["rows", "mean_ms"], "metric", "value")
    return ev.regression_gate(long.filter("mo = 2").drop("mo"), long.filter("mo = 1").drop("mo"), ["rows"])
