"""Retrieval metrics, arm comparisons, fact coverage, answer and trajectory scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from docweave.functions.text import bigram_set, bigrams, overlap_share
from docweave.operators.sequential import in_ranges


def golden_metrics(ranked: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, mrr, recall) of every question that has golden documents.

    ``ranked``: query_id, document_id, rank (a document may hold several ranks; ranks
    are renumbered over distinct documents). Recall counts distinct documents.
    """
    docs = ranked.groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("first", "document_id"))
    top = docs.withColumn("place", place).filter(F.col("place") <= k)
    wanted = golden.select("query_id", "document_id").distinct()
    found = wanted.join(top, ["query_id", "document_id"], "left")
    return found.groupBy("query_id").agg(
        F.max(F.col("place").isNotNull().cast("double")).alias("hit"),
        F.coalesce(1.0 / F.min("place"), F.lit(0.0)).alias("mrr"),
        (F.count("place") / F.count(F.lit(1))).alias("recall"))


def row_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, hit, mrr, precision, recall) where every relevant row counts.

    Recall is relevant rows over expected entries and may exceed 1 when several chunks
    of one document match. ``hits``: query_id, rank, relevant; ``expected``: query_id, expected.
    """
    rel = F.col("relevant")
    agg = hits.groupBy("query_id").agg(
        F.max(rel.cast("double")).alias("hit"), F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.avg(rel.cast("double")).alias("precision"), F.count_if(rel).alias("n"))
    return agg.join(expected, "query_id", "left").select(
        "query_id", "hit", "mrr", "precision",
        F.when(F.col("expected") > 0, F.col("n") / F.col("expected")).otherwise(F.lit(0.0)).alias("recall"))


def categories(questions: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, category): no_answer, policy (one golden document) or multi_hop (several)."""
    n = golden.groupBy("query_id").agg(F.countDistinct("document_id").alias("n"))
    count = F.coalesce("n", F.lit(0))
    return questions.select("query_id").join(n, "query_id", "left").select(
        "query_id", F.when(count == 0, "no_answer").when(count > 1, "multi_hop").otherwise("policy").alias("category"))


def score_arms(metrics: DataFrame) -> DataFrame:
    """Means per arm and category and per arm in all (category ``all``), by grouping sets.

    ``metrics``: arm, category, query_id, hit, mrr, recall.
    """
    return metrics.rollup("arm", "category").agg(
        F.grouping("arm").alias("_a"), F.grouping("category").alias("_c"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg("mrr"), 4).alias("mrr"),
        F.round(F.avg("recall"), 4).alias("recall"),
    ).filter("_a = 0").select("arm", F.when(F.col("_c") == 1, "all").otherwise(F.col("category")).alias("category"),
                              "n", "hit_rate", "mrr", "recall")


def quality_report(questions: DataFrame, ranked: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """One row: question counts, hit/MRR/recall of the answerable, medians of the top scores.

    ``separation`` = median top score without an answer / with one; low is good.
    """
    top1 = ranked.filter(F.col("rank") == 1).select("query_id", "score")
    m = golden_metrics(ranked, golden, k)
    rows = questions.select("query_id").join(m, "query_id", "left").join(top1, "query_id", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0)))
    answerable = F.col("hit").isNotNull()
    med_yes = F.percentile(F.when(answerable, F.col("score")), 0.5)
    med_no = F.percentile(F.when(~answerable, F.col("score")), 0.5)
    return rows.agg(
        F.count(F.lit(1)).alias("num_questions"), F.count_if(answerable).alias("num_answerable"),
        F.count_if(~answerable).alias("num_no_answer"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in (("hit", "hit_rate"), ("mrr", "mrr"), ("recall", "recall"))],
        F.round(med_yes, 4).alias("answerable_top1_median"), F.round(med_no, 4).alias("no_answer_top1_median"),
        F.when(med_yes > 0, F.round(med_no / med_yes, 4)).alias("no_answer_separation"))


def order_statistic(rows: DataFrame, group: list[str], value: str, index: Callable[[Column], Column], name: str) -> DataFrame:
    """(group, n, name): the value at 0-based place ``index(n)`` of each sorted group.

    No group is sorted whole: equal values are counted first, the distinct ones are dealt to ranges of about equal
    size, the range of the wanted place is found from one count per range, and only its values are
    put in order. A value far from all others, or a group with most of the rows, makes no range larger.
    """
    v = F.col(value).cast("double")
    counted = rows.filter(v.isNotNull()).groupBy(*group, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = in_ranges(counted, [*group, "_v"])
    of = W.partitionBy(*group)
    counts = placed.groupBy(*group, "_range").agg(F.sum("_c").alias("_sum")).withColumn("n", F.sum("_sum").over(of)).withColumn("_upto", F.sum("_sum").over(of.orderBy("_range")))
    target = counts.withColumn("_i", index(F.col("n")).cast("long")).filter((F.col("_i") < F.col("_upto")) & (F.col("_i") >= F.col("_upto") - F.col("_sum"))).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_at"), "n", (F.col("_i") - (F.col("_upto") - F.col("_sum"))).alias("_skip"))
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    run = F.sum("_c").over(W.partitionBy(*group).orderBy("_v"))
    return placed.join(F.broadcast(target) if not group else target, same).withColumn("_r", run).filter(F.col("_r") > F.col("_skip")).groupBy(*group).agg(F.first("n").alias("n"), F.min("_v").alias(name))


def p95_floor(n: Column) -> Column:
    """Place int(0.95 (n-1))."""
    return F.floor((n - 1) * F.lit(95) / 100)


def p95_capped(n: Column) -> Column:
    """Place min(n-1, int(0.95 n))."""
    return F.least(n - 1, F.floor(n * F.lit(95) / 100))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact binomial p of the discordant pairs; 1 when there are none."""

    def one(x: int, y: int) -> float:
        n, k = int(x + y), int(min(x, y))
        if n == 0:
            return 1.0
        log_half = n * math.log(2)
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - log_half) for i in range(k + 1))
        return min(1.0, 2 * tail)

    return pd.Series([one(x, y) for x, y in zip(b, c)])


def compare_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over the questions present in both arms (query_id, hit)."""
    ha, hb = F.col("a") > 0, F.col("b") > 0
    pairs = a.select("query_id", F.col("hit").alias("a")).join(b.select("query_id", F.col("hit").alias("b")), "query_id")
    agg = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ha & hb).alias("both"), F.count_if(ha & ~hb).alias("only_a"),
        F.count_if(hb & ~ha).alias("only_b"), F.count_if(~ha & ~hb).alias("neither"),
        F.round(F.coalesce(F.avg(ha.cast("double")), F.lit(0.0)), 6).alias("hit_a"),
        F.round(F.coalesce(F.avg(hb.cast("double")), F.lit(0.0)), 6).alias("hit_b"))
    return agg.withColumn("delta_pp", F.when(F.col("n") > 0, F.round((F.col("only_b") - F.col("only_a")) * 100.0 / F.col("n"), 2)).otherwise(0.0)
                          ).withColumn("p_value", F.round(mcnemar_p("only_a", "only_b"), 6))


def threshold_sweep(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """Gate outcomes per threshold. ``samples``: query_id, top_score, should_refuse.

    Each sample becomes one row per threshold inside the scan; the counts are combined
    before the shuffle.
    """
    rows = samples.select("top_score", "should_refuse", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    passed = F.coalesce(F.col("top_score") >= F.col("threshold"), F.lit(False))
    out = rows.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~passed).alias("refused"),
        F.count_if(~passed & ~F.col("should_refuse")).alias("false_refuse"),
        F.count_if(passed & F.col("should_refuse")).alias("missed"), F.count_if(passed).alias("answered"),
        F.min(F.when(passed, F.col("top_score"))).alias("min_answered_score"))
    safe = out.filter(F.col("false_refuse") == 0).agg(F.max("refused"))
    return out.withColumn("recommended", F.coalesce(
        (F.col("false_refuse") == 0) & (F.col("refused") == safe.scalar()), F.lit(False)))


LATIN = r"[A-Za-z0-9_]+"


def fact_hit(fact: Column, blob: Column, loose: bool = False) -> Column:
    """Any alternative (``A|B``) found in the text.

    Loose: compared without blanks and case, or all latin words of an alternative present.
    """
    alts = F.transform(F.split(fact, r"\|"), lambda a: F.trim(a) if loose else a)
    alts = F.filter(alts, lambda a: a != "")
    if not loose:
        return F.exists(alts, lambda a: F.contains(blob, a))
    flat = F.lower(F.regexp_replace(blob, r"(?U)\s+", ""))
    words = lambda a: F.regexp_extract_all(F.lower(a), F.lit(f"({LATIN})"), F.lit(1))
    return F.exists(alts, lambda a: F.contains(flat, F.lower(F.regexp_replace(a, r"(?U)\s+", "")))
                    | ((F.size(words(a)) > 0) & F.forall(words(a), lambda w: F.contains(flat, w))))


def fact_coverage(texts: DataFrame, facts: DataFrame, loose: bool = False) -> DataFrame:
    """(query_id, facts, found, coverage). ``texts``: query_id, content; ``facts``: query_id, fact.

    A fact counts once however many texts of the question hold it.
    """
    pairs = facts.join(texts.select("query_id", "content"), "query_id", "left")
    found = F.coalesce(fact_hit(F.col("fact"), F.col("content"), loose), F.lit(False))
    each = pairs.groupBy("query_id", "fact").agg(F.max(found).alias("found"))
    return each.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("found").alias("found"),
        F.round(F.count_if("found") / F.count(F.lit(1)), 6).alias("coverage"))


def coverage_by_kind(coverage: DataFrame) -> DataFrame:
    """Per kind: pooled share over all facts beside the mean of the per-question shares."""
    return coverage.groupBy("kind").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("facts").alias("facts"), F.sum("found").alias("found"),
        F.round(F.sum("found") / F.sum("facts"), 6).alias("pooled"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def first_fact_rank(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, rank, coverage): the first ranked text that holds any fact, and its share."""
    pairs = hits.select("query_id", "rank", "content").join(facts, "query_id")
    per = pairs.groupBy("query_id", "rank").agg(F.avg(fact_hit(F.col("fact"), F.col("content")).cast("double")).alias("cov"))
    return per.filter(F.col("cov") > 0).groupBy("query_id").agg(
        F.min("rank").alias("rank"), F.round(F.min_by("cov", "rank"), 6).alias("coverage"))


def loss_funnel(stages: DataFrame, facts: DataFrame, order: list[str]) -> DataFrame:
    """First rank holding a fact after every stage, and the stage that lost it.

    ``stages``: stage, query_id, rank, content. ``lost_at`` is the first stage without a
    hit after one that had it; ``never`` when no stage found it.
    """
    pairs = stages.join(facts, "query_id").filter(fact_hit(F.col("fact"), F.col("content")))
    ranks = pairs.groupBy("query_id", "fact").pivot("stage", order).agg(F.min("rank"))
    full = facts.select("query_id", "fact").distinct().join(ranks, ["query_id", "fact"], "left")
    lost = F.lit(None).cast("string")
    for before, after in reversed(list(zip(order, order[1:]))):
        lost = F.when(F.col(before).isNotNull() & F.col(after).isNull(), F.lit(after)).otherwise(lost)
    none = F.coalesce(*[F.col(s) for s in order]).isNull()
    return full.withColumn("lost_at", F.when(none, "never").otherwise(lost))


# fixed values: answers that decline, and the markers left out before scoring
NON_ANSWER = r"(无法找到|找不到|未找到|没有找到|无法回答|无法提供|无法确定|暂无相关|暂无法|无法直接)"
DISCLAIMER = r"⚠️ 当前回答可信度较低[^\n]*"
CITATION = r"\[\s*\d+\s*\]"
CLAUSE_SPLIT = r"[，,；;。！？!?、\n]+"
SENTENCE_SPLIT = r"[。！？!?；;\n]+"
NUMBER = r"(\d+(?:\.\d+)?)"


def clean_answer(answer: Column) -> Column:
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), DISCLAIMER, "")
    return F.trim(F.regexp_replace(text, CITATION, ""))


def clauses(text: Column, min_chars: int) -> Column:
    return F.filter(F.transform(F.split(text, CLAUSE_SPLIT), lambda c: F.trim(c)), lambda c: F.length(c) >= min_chars)


def _numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)))


def lexical_faithfulness(rows: DataFrame, keys: list[str], answer: Column, context: Column) -> DataFrame:
    """(keys, faithfulness): share of answer clauses whose bigrams are half covered by the
    context and whose numbers all occur in it.

    A short refusal, an empty answer and an empty context score 0. Context bigrams are
    taken once per answer, before its clauses become rows.
    """
    clean = clean_answer(answer)
    refused = (F.length(clean) <= 40) & clean.rlike(NON_ANSWER)
    scored = ~refused & (F.trim(F.coalesce(context, F.lit(""))) != "")
    parts = rows.select(*keys, scored.alias("scored"), bigram_set(context).alias("grams"), _numbers(context).alias("numbers"),
                        F.explode_outer(clauses(clean, 4)).alias("clause"))
    backed = (overlap_share(bigram_set(F.col("clause")), F.col("grams")) >= 0.5) & (
        F.size(F.array_except(_numbers(F.col("clause")), F.col("numbers"))) == 0)
    ok = F.when(F.col("scored") & F.col("clause").isNotNull(), backed.cast("double")).otherwise(0.0)
    return parts.groupBy(*keys).agg(F.round(F.avg(ok), 4).alias("faithfulness"))


def semantic_faithfulness(answer_clauses: DataFrame, support: DataFrame, context_numbers: DataFrame,
                          threshold: float = 0.70) -> DataFrame:
    """(sample_id, score) from clause rows and the best similarity already found per clause.

    ``answer_clauses``: sample_id, clause_id, clause; ``support``: clause_id, score (J of
    clause and context vectors); ``context_numbers``: sample_id, numbers.
    """
    rows = answer_clauses.join(support, "clause_id", "left").join(context_numbers, "sample_id", "left")
    known = F.coalesce("numbers", F.array().cast("array<string>"))
    ok = (F.coalesce("score", F.lit(0.0)) >= threshold) & (F.size(F.array_except(_numbers(F.col("clause")), known)) == 0)
    return rows.groupBy("sample_id").agg(F.round(F.avg(ok.cast("double")), 4).alias("score"))


def relevance_from_similarity(best: Column, low: float = 0.45, high: float = 0.92) -> Column:
    """Best sentence similarity mapped linearly from [low, high] to [0, 1]."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best - low) / (high - low))), 4)


def lexical_relevance(answer: Column, question: Column) -> Column:
    clean = clean_answer(answer)
    share = overlap_share(bigram_set(question), bigram_set(clean))
    return F.when((clean == "") | (F.trim(F.coalesce(question, F.lit(""))) == ""), F.lit(0.0)).otherwise(F.round(share, 4))


def _point_grams(text: Column) -> Column:
    """Bigrams without blanks only; a single character stands for itself."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return F.array_distinct(F.when(F.length(flat) > 1, bigrams(flat)).when(flat != "", F.array(flat)).otherwise(F.array().cast("array<string>")))


def trajectory_scores(runs: DataFrame, pass_at: float = 0.7) -> DataFrame:
    """Four rule scores per run, their mean and the verdict.

    ``runs``: id, tools[], final_answer, expected_tools[], expected_points[], max_steps, require_all, and
    n_steps where the tools come as a set instead of one entry per step.
    """
    wanted = F.filter(F.coalesce("expected_tools", F.array().cast("array<string>")), lambda x: x != "")
    hit = F.size(F.filter(wanted, lambda x: F.array_contains("tools", x)))
    share = hit / F.size(wanted)
    tool = F.when(F.size(wanted) == 0, 1.0).when(F.col("require_all"), (hit == F.size(wanted)).cast("double")).otherwise(share)
    n, cap = F.col("n_steps") if "n_steps" in runs.columns else F.size("tools"), F.col("max_steps")
    steps = (F.when(cap <= 0, 1.0).when(n == 0, 0.5).when(n <= cap, 1.0)
             .otherwise(F.greatest(F.lit(0.0), 1.0 - (n - cap) / cap)))
    points = F.filter(F.coalesce("expected_points", F.array().cast("array<string>")), lambda x: x != "")
    hay = _point_grams(F.col("final_answer"))
    covered = F.filter(points, lambda p: overlap_share(_point_grams(p), hay) >= 0.5)
    info = F.when(F.size(points) == 0, 1.0).otherwise(F.size(covered) / F.size(points))
    answer = F.trim(F.coalesce("final_answer", F.lit("")))
    comply = F.when(answer == "", 0.0).when(answer.rlike(NON_ANSWER), 0.5).otherwise(1.0)
    out = runs.select("id", tool.alias("tool_selection"), steps.alias("step_efficiency"), info.alias("info_coverage"),
                      comply.alias("compliance"), F.array_except(wanted, F.col("tools")).alias("missing_tools"))
    score = (F.col("tool_selection") + F.col("step_efficiency") + F.col("info_coverage") + F.col("compliance")) / 4
    return out.withColumn("score", F.round(score, 6)).withColumn("passed", score >= pass_at)


def compare_metric_rows(base: DataFrame, new: DataFrame, keys: list[str], metrics: dict[str, float]) -> DataFrame:
    """(keys, metric, base, new, delta, ok): every metric of two runs, with its tolerance.

    A metric passes while new >= base - tolerance.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(keys, list(metrics), "metric", name)

    tol = F.create_map(*[x for m, v in metrics.items() for x in (F.lit(m), F.lit(float(v)))])
    joined = long(base, "base_value").join(long(new, "new_value"), [*keys, "metric"], "full_outer")
    delta = F.col("new_value") - F.col("base_value")
    return joined.select(*keys, "metric", "base_value", "new_value", F.round(delta, 6).alias("delta"),
                         F.coalesce(F.round(delta, 9) >= -tol[F.col("metric")], F.lit(False)).alias("ok"))


def gain_rule(base: DataFrame, new: DataFrame, key: str, threshold: float = 0.05) -> DataFrame:
    """Gain per key when hit or recall rises by the threshold."""
    b = base.select(key, F.col("hit_rate").alias("bh"), F.col("recall").alias("br"))
    n = new.select(key, F.col("hit_rate").alias("nh"), F.col("recall").alias("nr"))
    dh, dr = F.round(F.col("nh") - F.col("bh"), 6), F.round(F.col("nr") - F.col("br"), 6)
    return b.join(n, key).select(key, dh.alias("hit_delta"), dr.alias("recall_delta"), ((dh >= threshold) | (dr >= threshold)).alias("gain"))


def regression_gate(current: DataFrame, baseline: DataFrame, counters: list[str], ratio: float = 1.6,
                    min_delta_ms: float = 5.0) -> DataFrame:
    """(metric, baseline, current, verdict). Counters must be equal; a time fails only when it
    is over ``ratio`` times slower and at least ``min_delta_ms`` more, else it warns."""
    rows = baseline.withColumnRenamed("value", "baseline").join(current.withColumnRenamed("value", "current"), "metric", "left")
    slower = F.col("current") > F.col("baseline") * ratio
    delta = F.col("current") - F.col("baseline")
    verdict = (F.when(F.col("current").isNull(), "missing")
               .when(F.col("metric").isin(counters), F.when(F.col("current") == F.col("baseline"), "ok").otherwise("fail"))
               .when(slower & (delta >= min_delta_ms), "fail").when(slower, "warn").otherwise("ok"))
    return rows.select("metric", "baseline", "current", verdict.alias("verdict"))


def map_provenance(ranked: DataFrame, provenance: DataFrame) -> DataFrame:
    """Retrieved page ids replaced by their source document; unmapped ids stay."""
    return ranked.join(provenance.select(F.col("page_id").alias("document_id"), "source_id"), "document_id", "left").withColumn(
        "document_id", F.coalesce("source_id", "document_id")).drop("source_id")

