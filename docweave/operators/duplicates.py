"""Near-duplicate search by words and characters for a table of probe texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.functions.text import rows_of
from docweave.operators.lexical import counted_terms
from docweave.operators.sizing import BROADCAST_ROWS, at_most, broadcast_if_small, salted_join


def lexical_neighbors(docs: DataFrame, probes: DataFrame, doc_key: str, probe_key: str,
                      threshold: float = 0.7, most: int = 20) -> DataFrame:
    """(probe_key, doc_key, similarity, rank): mean of word-count cosine and character Jaccard.

    Words are counted and normed inside their row and pruned to those of the probes; only distinct terms are
    hashed on the document, where their products are added up. The Jaccard of two character sets is at most
    the smaller over the larger, so pairs whose cosine cannot make up for that never meet their sets. The
    report keeps the best ``most`` at or above the threshold, as the search does.
    """
    chars = F.array_distinct(F.split(F.lower("text"), ""))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, x: a + (x["tf"] * x["tf"]).cast("double")))

    def counted(df: DataFrame, key: str, tf: str, side: str) -> DataFrame:
        rows = counted_terms(df.select(key, "text", F.size(chars).alias("_size")), [key, "_size"]).withColumn("_norm", norm)
        return rows.select(key, F.col("_size").alias(f"{side}_size"), F.col("_norm").alias(f"{side}_norm"), rows_of(F.col("terms")).alias("e")).select(
            key, f"{side}_size", f"{side}_norm", "e.term", F.col("e.tf").alias(tf)).filter(F.col("term").isNotNull())

    asked, rows = counted(probes, probe_key, "qf", "probe"), counted(docs, doc_key, "tf", "doc")
    few = at_most(asked, BROADCAST_ROWS)
    pairs = rows.join(F.broadcast(asked), "term") if few else salted_join(rows, asked, ["term"], [doc_key])
    least, largest = F.least("doc_size", "probe_size"), F.greatest("doc_size", "probe_size", F.lit(1))
    scored = (
        pairs.groupBy(probe_key, doc_key, "doc_size", "doc_norm", "probe_size", "probe_norm").agg(F.sum((F.col("tf") * F.col("qf")).cast("double")).alias("dot"))
        .withColumn("cosine", F.col("dot") / (F.col("doc_norm") * F.col("probe_norm")))
        .filter((F.col("cosine") + least / largest) / 2 >= threshold - 1e-6)
        .select(probe_key, doc_key, "cosine")
        .join(docs.select(doc_key, chars.alias("dc")), doc_key).join(broadcast_if_small(probes.select(probe_key, chars.alias("pc"))), probe_key)
    )
    jaccard = F.size(F.array_intersect("dc", "pc")) / F.size(F.array_union("dc", "pc"))
    out = scored.withColumn("similarity", F.round((F.col("cosine") + jaccard) / 2, 6)).filter(F.col("similarity") >= threshold)
    w = W.partitionBy(probe_key).orderBy(F.col("similarity").desc(), doc_key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(
        probe_key, doc_key, "similarity", "rank")


def content_groups(docs: DataFrame, doc_key: str) -> DataFrame:
    """(content_hash, first_id, copies): documents of equal text, one row per text."""
    return docs.groupBy(F.md5("text").alias("content_hash")).agg(F.min(doc_key).alias("first_id"), F.count(F.lit(1)).alias("copies"))


