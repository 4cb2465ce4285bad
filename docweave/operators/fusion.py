"""Rank fusion of channels, rerank with fallback, table fold, union candidates.

A ranked frame has ``query_id, channel, document_id, chunk_index, rank, score``;
order is always the column ``rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = ["document_id", "chunk_index"]


def _order_no(channels: list[str]) -> Column:
    """Position of a row in the order channels are read: channel first, then rank."""
    at = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel"))
    return F.struct(at.alias("c"), F.col("rank").alias("r"))


def _rank_by(df: DataFrame, score: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.round(score, 12).desc(), F.col("first_seen"), *[F.col(c) for c in KEY])
    return df.withColumn("rank", F.row_number().over(w)).drop("first_seen")


def reciprocal_rank_fusion(ranked: DataFrame, channels: list[str], k: int = 60,
                           weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight/(k+rank) per query and chunk; ties by first appearance.

    Raw scores of the dense and sparse channels are kept beside the sum. Channels of
    several query variants are just more channels (``q1_dense``, ``q2_sparse`` ...).
    """
    share = F.lit(1.0)
    if weights:
        share = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(w))) for c, w in weights.items()], F.lit(1.0))
    raw = {
        kind: F.max_by(F.when(F.col("channel").endswith(kind), F.col("score")),
                       F.when(F.col("channel").endswith(kind), F.struct(
                           F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")))))
        for kind in ("dense", "sparse")
    }
    fused = ranked.filter(F.col("channel").isin(channels)).groupBy("query_id", *KEY).agg(
        F.sum(share / (F.lit(k) + F.col("rank"))).alias("rrf_score"),
        F.coalesce(raw["dense"], F.lit(0.0)).alias("dense_score"),
        F.coalesce(raw["sparse"], F.lit(0.0)).alias("sparse_score"),
        F.min(_order_no(channels)).alias("first_seen"),
    )
    return _rank_by(fused, "rrf_score")


def minmax_fusion(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores scaled to [0.5, 1] per query and channel (1 when flat), then a weighted sum.

    The range is a small aggregate joined back, so no window holds a whole channel.
    """
    channels = list(weights)
    ranked = ranked.filter(F.col("channel").isin(channels))
    span = ranked.groupBy("query_id", "channel").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(float(w))) for c, w in weights.items()])
    scaled = F.when(F.col("hi") > F.col("lo"), 0.5 + 0.5 * (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
                    ).otherwise(F.lit(1.0))
    fused = ranked.join(span, ["query_id", "channel"]).groupBy("query_id", *KEY).agg(
        F.sum(weight * scaled).alias("fused_score"), F.min(_order_no(channels)).alias("first_seen"))
    return _rank_by(fused, "fused_score")


def union_candidates(ranked: DataFrame, channels: list[str], size: int) -> DataFrame:
    """First appearance of each chunk when the channels are read one after another, cut at ``size``."""
    first = ranked.filter(F.col("channel").isin(channels)).groupBy("query_id", *KEY).agg(
        F.min(_order_no(channels)).alias("first_seen"))
    w = W.partitionBy("query_id").orderBy("first_seen", *KEY)
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).drop("first_seen")


def rerank(candidates: DataFrame, score: Column, k: int, window: int, min_score: float = 0.0) -> DataFrame:
    """Score the first max(k, window) rows, drop low ones, keep k.

    ``score`` is a nullable expression (usually a pandas UDF over query and content).
    One null score sends the whole query back to the fused order, flagged
    ``rerank_fallback``: those scores are not relevance and no gate may read them so.
    """
    head = candidates.filter(F.col("rank") <= max(k, window)).withColumn("_s", score)
    per_query = W.partitionBy("query_id")
    head = head.withColumn("rerank_fallback", F.max(F.col("_s").isNull()).over(per_query))
    head = head.withColumn("rerank_score", F.when(F.col("rerank_fallback"), F.col("rrf_score")).otherwise(F.col("_s")))
    kept = head.filter(F.col("rerank_fallback") | (F.col("rerank_score") >= min_score))
    order = per_query.orderBy(F.round("rerank_score", 12).desc(), F.col("rank"))
    return (
        kept.withColumn("fused_rank", F.col("rank")).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k).drop("_s")
    )


def table_header(content: Column) -> Column:
    """Header line of a one-row table chunk (heading, header, row), else null."""
    lines = F.filter(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), lambda s: F.trim(s) != "")
    table = F.filter(lines, lambda s: F.ltrim(s).startswith("|"))
    return F.when((F.size(table) == 2) & (F.size(lines) <= 3), F.get(table, 0))


def fold_table_rows(ranked: DataFrame, content_col: str = "content") -> DataFrame:
    """Only the best ranked row of each table of a document; other chunks untouched."""
    marked = ranked.withColumn("_h", table_header(F.col(content_col)))
    same = W.partitionBy("query_id", "document_id", "_h").orderBy("rank")
    kept = marked.withColumn("_n", F.when(F.col("_h").isNotNull(), F.row_number().over(same))).filter(
        F.col("_h").isNull() | (F.col("_n") == 1))
    order = W.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).drop("_h", "_n")
