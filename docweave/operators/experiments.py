"""Experiments and strategy learning: assignment, analysis, votes, accuracy, pattern mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.functions.text import rows_of
from docweave.operators.sequential import numbered_in_order


def bucket(user: Column, experiment: Column) -> Column:
    """md5 of ``user-experiment`` as a number in [0, 1); the first 60 bits decide."""
    digest = F.md5(F.concat(user.cast("string"), F.lit("-"), experiment.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("double") / float(2 ** 60)


def assign_variants(users: DataFrame, variants: DataFrame) -> DataFrame:
    """(user_id, experiment_id, variant_id): first variant whose cumulative weight covers the
    user's bucket; null when the weights do not reach it.

    ``users``: user_id, experiment_id; ``variants``: experiment_id, pos, variant_id, weight.
    The few variants of an experiment travel as one array beside each user.
    """
    cum = F.sum("weight").over(W.partitionBy("experiment_id").orderBy("pos"))
    listed = variants.withColumn("upto", cum).groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("pos", "upto", "variant_id"))).alias("v"))
    b = bucket(F.col("user_id"), F.col("experiment_id"))
    return users.join(F.broadcast(listed), "experiment_id", "left").select(
        "user_id", "experiment_id", F.get(F.filter("v", lambda v: b <= v["upto"]), 0)["variant_id"].alias("variant_id"))


def realised_shares(assigned: DataFrame, variants: DataFrame) -> DataFrame:
    total = W.partitionBy("experiment_id")
    n = assigned.groupBy("experiment_id", "variant_id").agg(F.count(F.lit(1)).alias("users"))
    n = n.withColumn("share", F.round(F.col("users") / F.sum("users").over(total), 6))
    return n.join(variants.select("experiment_id", "variant_id", "weight"), ["experiment_id", "variant_id"], "left")


def analyze_experiment(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation and count per experiment, variant and metric."""
    return metrics.groupBy("experiment_id", "variant_id", "metric_name").agg(
        F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("std"), F.count("metric_value").alias("n"))


def winners(analysis: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Variant of the highest mean of the metric, and the sample size (largest count)."""
    rows = analysis.groupBy("experiment_id").agg(
        F.max("n").alias("sample_size"),
        F.min_by("variant_id", F.when(F.col("metric_name") == metric, F.struct((-F.col("mean")).alias("m"), F.col("variant_id").alias("v")))).alias("winner"))
    return rows


def training_samples(executions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Executions with feedback and the label mean feedback > 0."""
    label = feedback.groupBy("execution_id").agg((F.avg("value") > 0).alias("label"))
    return executions.join(label, "execution_id")


def strategy_accuracy(samples: DataFrame) -> DataFrame:
    """(strategy, n, accuracy): share of samples whose confidence > 0.5 agrees with the label."""
    rows = samples.select("label", F.explode("strategy_results").alias("strategy", "confidence"))
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("confidence") > 0.5) == F.col("label")).cast("double")).alias("accuracy"))


def weight_adjustments(accuracy: DataFrame, weights: DataFrame, samples: int, least_samples: int = 50, rate: float = 0.1) -> DataFrame:
    """New weights: rate x (accuracy - mean), applied at a tenth, clamped to [.05, .95], scaled to sum 1.

    Without enough samples the weights stay.
    """
    mean = accuracy.agg(F.avg("accuracy"))
    step = accuracy.select("strategy", (rate * (F.col("accuracy") - mean.scalar())).alias("adjustment"))
    moved = weights.join(step, "strategy", "left")
    change = F.coalesce("adjustment", F.lit(0.0)) * 0.1 if samples >= least_samples else F.lit(0.0)
    clamped = F.when(F.col("adjustment").isNull() | F.lit(samples < least_samples), F.col("weight")).otherwise(
        F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("weight") + change)))
    raw = moved.withColumn("raw", clamped)
    return raw.withColumn("new_weight", F.col("raw") / F.sum("raw").over(W.partitionBy())).drop("raw")


def threshold_update(samples: DataFrame) -> DataFrame:
    """clamp(mean confidence of positive samples - 0.1, 0.1, 0.9)."""
    m = F.avg(F.when(F.col("label"), F.col("confidence")))
    return samples.agg(F.greatest(F.lit(0.1), F.least(F.lit(0.9), m - 0.1)).alias("threshold"), F.count_if("label").alias("positives"))


def misclassified(samples: DataFrame) -> DataFrame:
    """Samples whose decision disagrees with the label; kind is false_positive or false_negative."""
    return samples.filter(F.col("decision") != F.col("label")).withColumn(
        "kind", F.when(F.col("decision"), "false_positive").otherwise("false_negative"))


def words_of(question: Column) -> Column:
    return F.filter(F.split(F.lower(F.btrim(question, F.lit(" \t\n\r"))), r"\s+"), lambda w: w != "")


def common_patterns(cases: DataFrame, by: list[str], least: int = 3, most: int = 20) -> DataFrame:
    """(by, pattern, frequency, coverage): words and word pairs seen at least ``least`` times.

    Coverage is the count over the number of questions. Every question is one scan row;
    counts are combined before the shuffle and the report cut runs before it too.
    """
    w = words_of(F.col("question"))
    after = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
    pairs = F.array_compact(F.zip_with(w, after, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))))
    total = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"))
    n = cases.select(*by, rows_of(F.concat(w, pairs)).alias("pattern")).filter(
        F.col("pattern").isNotNull()).groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("frequency"))
    rows = n.filter(F.col("frequency") >= least).join(total, by) if by else n.filter(F.col("frequency") >= least).withColumn(
        "questions", cases.agg(F.count(F.lit(1))).scalar())
    order = W.partitionBy(*by).orderBy(F.col("frequency").desc(), "pattern")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(
        *by, "pattern", "frequency", F.round(F.col("frequency") / F.col("questions"), 3).alias("coverage"), "rank")


def suggested_keywords(cases: DataFrame, most: int = 20) -> DataFrame:
    """Most frequent words of two or more characters."""
    w = F.filter(F.split(F.btrim("question", F.lit(" \t\n\r")), r"\s+"), lambda x: F.length(x) >= 2)
    n = cases.select(rows_of(w).alias("keyword")).filter(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))
    return n.orderBy(F.col("frequency").desc(), "keyword").limit(most)


def fuse_votes(votes: DataFrame, abstain_below: float = 0.35, threshold: float = 0.5) -> DataFrame:
    """(execution_id, decision, confidence) by weighted vote.

    ``votes``: execution_id, strategy, result, confidence, weight. Votes under the line
    are ignored; yes adds weight x c, no weight x (1 - c); without a vote the answer is no.
    """
    counted = F.col("confidence") >= abstain_below
    part = F.when(F.col("result"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    agg = votes.groupBy("execution_id").agg(
        F.coalesce(F.sum(F.when(counted, F.col("weight"))), F.lit(0.0)).alias("w"),
        F.sum(F.when(counted, F.col("weight") * part)).alias("s"))
    score = F.round(F.col("s") / F.col("w"), 12)
    yes = (F.col("w") > 0) & (score >= threshold)
    conf = F.when(F.col("w") == 0, 0.0).otherwise(F.least(F.lit(0.99), F.when(score >= threshold, score).otherwise(1 - score)))
    return agg.select("execution_id", F.coalesce(yes, F.lit(False)).alias("decision"), conf.alias("confidence"))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """(experiment_id, variant_id, metric_name, place, value): the recorded values of every variant and metric in the order of their ids.

    ``metrics``: id, experiment_id, variant_id, metric_name, value. The list of a variant and name is its rows by ``place``
    from 0; as rows it may be of any length. Ids are unique.
    """
    keys = ["experiment_id", "variant_id", "metric_name"]
    return numbered_in_order(metrics.select("id", *keys, "value"), keys, "id", "place").select(*keys, "place", "value")
