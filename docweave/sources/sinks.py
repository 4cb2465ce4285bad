"""Writers: chunks, traces, exports, copies with new vectors, guarded re-ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from docweave.operators.lexical import fit_vocabulary, sparse_statistics, weighted_postings
from docweave.sources.folders import folder_there, remove_folder

# fixed values: fields a chunk row gets when it comes without them
CHUNK_DEFAULTS = {"source_kind": "raw", "heading_path": "", "source": ""}


def with_defaults(chunks: DataFrame, defaults: dict[str, str] = CHUNK_DEFAULTS) -> DataFrame:
    """Missing columns added, nulls filled."""
    for name, value in defaults.items():
        col = F.coalesce(F.col(name), F.lit(value)) if name in chunks.columns else F.lit(value)
        chunks = chunks.withColumn(name, col)
    return chunks


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks partitioned by base, so a base filter reads only its folders.

    Rows are spread by (base, document) before the write: one large base becomes many
    files, not one writer.
    """
    rows = with_defaults(chunks)
    rows.repartition("kb_id", "document_id").write.mode(mode).partitionBy("kb_id").parquet(path)


def write_traces(traces: DataFrame, path: str, columns: list[str]) -> list[str]:
    """Writes the known columns and returns the names that were dropped."""
    kept = [c for c in traces.columns if c in columns]
    traces.select(*kept).write.mode("append").parquet(path)
    return sorted(set(traces.columns) - set(kept))


def export_owner(tables: dict[str, tuple[DataFrame, str, list[str]]], owner: str, path: str) -> None:
    """One folder per table with the owner's rows: ``{name: (rows, owner column, columns)}``."""
    for name, (rows, column, columns) in tables.items():
        rows.filter(F.col(column) == owner).select(*columns).write.mode("overwrite").json(f"{path}/{name}")


def copy_with_vectors(chunks: DataFrame, embed: Callable[[Column], Column], dim: int, path: str) -> dict[str, int]:
    """Copy of a collection with new vectors; blank contents are skipped and counted.

    A vector of another length fails the copy. The counts come from the write itself.
    """
    seen, kept = Observation("seen"), Observation("kept")
    rows = chunks.observe(seen, F.count(F.lit(1)).alias("n")).filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    rows = rows.observe(kept, F.count(F.lit(1)).alias("n")).drop("embedding").withColumn("embedding", embed(F.col("content")))
    checked = rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"vector of another length than {dim}")).cast("array<float>")))
    checked.write.mode("overwrite").parquet(path)
    total, written = seen.get["n"], kept.get["n"]
    return {"scanned": total, "written": written, "skipped": total - written}


def reindex_sparse(chunks: DataFrame, keys: list[str], text_col: str, path: str) -> tuple[DataFrame, DataFrame]:
    """New vocabulary and postings for stored chunks: (vocabulary, statistics after)."""
    vocab_path, postings_path = f"{path}/vocabulary", f"{path}/postings"
    fit_vocabulary(chunks, text_col).write.mode("overwrite").parquet(vocab_path)
    vocabulary = chunks.sparkSession.read.parquet(vocab_path)
    weighted_postings(chunks, keys, text_col, vocabulary=vocabulary).repartition(F.col("term"), F.pmod(F.xxhash64(*keys), F.lit(16))).write.mode("overwrite").parquet(postings_path)
    return vocabulary, sparse_statistics(chunks, keys, vocabulary, text_col)


class IngestRefused(ValueError):
    """A re-ingest that would lose chunks."""


def write_bucketed(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """A store of chunks in folders ``bucket=<hash of the document>``, in which ``reingest`` replaces documents."""
    in_buckets(with_defaults(chunks), buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def in_buckets(chunks: DataFrame, buckets: int) -> DataFrame:
    """The rows with their ``bucket``, dealt by bucket and document, so that a bucket is written by few tasks, and not by one if it is large."""
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(buckets)).cast("int"))
    return rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("document_id", F.lit(1)), F.lit(4)))


def reingest(spark: SparkSession, path: str, fresh: DataFrame, staged: str, buckets: int = 64, allow_shrink: bool = False) -> dict[str, int]:
    """Replaces the chunks of the documents in ``fresh`` in the store of ``write_bucketed``; other buckets keep their files.

    Refused when a document comes with no chunk, or with fewer than half of its old ones unless allowed. The
    touched buckets are first written to ``staged``: the old rows without the documents' chunks are counted, then
    the new ones join them and are counted again. Only when both counts are right is the stage
    marked ready, and one dynamic partition overwrite puts its buckets in place. A refused run changes nothing; a run that is cut off
    before the mark leaves the store as it was, and one cut off after it is finished by the next call or by ``finish_reingest``.
    """
    finish_reingest(spark, path, staged)
    remove_folder(spark, staged)
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "bucket"]
    number = F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(buckets)).cast("int")
    new = fresh.groupBy("document_id").agg(F.count("content").alias("new")).withColumn("bucket", number)
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    held = stored.filter(F.col("bucket").isin(touched)) if touched else stored.filter("false")
    old = held.groupBy("document_id").agg(F.count(F.lit(1)).alias("old"))
    j = new.join(old, "document_id", "left").withColumn("old", F.coalesce("old", F.lit(0)))
    bad = (F.col("new") == 0) | (F.lit(not allow_shrink) & (F.col("new") * 2 < F.col("old")))
    stats = j.agg(F.count_if(bad).alias("bad"), F.coalesce(F.sum("old"), F.lit(0)).alias("removed"), F.coalesce(F.sum("new"), F.lit(0)).alias("added"),
                  F.min(F.when(bad, F.col("document_id"))).alias("first")).first()
    if stats["bad"]:
        raise IngestRefused(f"{stats['bad']} documents would lose chunks, first {stats['first']}")
    if not touched:
        return {"removed": 0, "added": 0, "buckets": 0}
    kept = held.join(new.select("document_id"), "document_id", "left_anti").select(*columns)
    in_buckets(kept, buckets).write.partitionBy("bucket").parquet(f"{staged}/rows")
    total, left = held.count(), _rows(spark, staged, stored)
    if left != total - stats["removed"]:
        raise IngestRefused(f"{left} rows stay after the deletion, {total - stats['removed']} expected")
    in_buckets(with_defaults(fresh).filter(F.col("content").isNotNull()).select(*columns), buckets).write.mode("append").partitionBy("bucket").parquet(f"{staged}/rows")
    written = _rows(spark, staged, stored)
    if written != left + stats["added"]:
        raise IngestRefused(f"{written - left} rows of the new documents were written, {stats['added']} expected")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{staged}/ready")
    finish_reingest(spark, path, staged)
    return {"removed": stats["removed"], "added": stats["added"], "buckets": len(touched)}


def _rows(spark: SparkSession, staged: str, stored: DataFrame) -> int:
    return spark.read.schema(stored.schema).parquet(f"{staged}/rows").count() if folder_there(spark, f"{staged}/rows") else 0


def finish_reingest(spark: SparkSession, path: str, staged: str) -> bool:
    """Puts a stage that is ready in place, again if an earlier try was cut off; True if there was one."""
    if not folder_there(spark, f"{staged}/ready"):
        return False
    rows = spark.read.schema(spark.read.parquet(path).schema).parquet(f"{staged}/rows")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    remove_folder(spark, f"{staged}/ready")
    return True
