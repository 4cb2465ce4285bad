"""Differences between the metadata tables, the chunks, the objects and the answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MEMORY = "memory"
FINDING = ["kind", "subject", "detail"]


def chunk_refs(chunks: DataFrame) -> DataFrame:
    """One row per document id found among the chunks: a kb_id, a source_kind, the count."""
    first = F.min(F.struct("chunk_index", "kb_id", "source_kind"))
    return chunks.groupBy(F.coalesce("document_id", F.lit("")).alias("document_id")).agg(
        first.alias("f"), F.count(F.lit(1)).alias("chunks")).select("document_id", "f.kb_id", "f.source_kind", "chunks")


def _detail(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in cols.items()]))


def classify_vectors(refs: DataFrame, docs: DataFrame, wiki_ids: DataFrame, kbs: DataFrame) -> DataFrame:
    """Findings (kind, subject, detail) of chunk documents against the metadata.

    Session memory is skipped. One document may give several findings.
    """
    kb = F.coalesce("kb_id", F.lit(""))
    kind = F.coalesce("source_kind", F.lit(""))
    rows = refs.filter((kind != MEMORY) & (kb != MEMORY)).join(
        docs.select(F.col("doc_id").alias("document_id"), F.col("status"), F.coalesce("kb_id", F.lit("")).alias("doc_kb")), "document_id", "left"
    ).join(wiki_ids.select(F.col("id").alias("document_id"), F.lit(True).alias("is_wiki")), "document_id", "left").join(
        kbs.select("kb_id", F.lit(True).alias("kb_known")), "kb_id", "left")
    named, known = F.col("document_id") != "", F.col("status").isNotNull()
    n = F.col("chunks")
    found = F.array_compact(F.array(
        F.when(~named, F.struct(F.lit("orphan_vector_doc").alias("kind"), F.lit("<empty>").alias("subject"), _detail(reason=F.lit("document_id 为空")).alias("detail"))),
        F.when(named & known & (F.col("status") != "published"), F.struct(
            F.lit("vector_for_unpublished_doc").alias("kind"), F.col("document_id").alias("subject"), _detail(chunks=n, status=F.col("status")).alias("detail"))),
        F.when(named & known & (kb != "") & (F.col("doc_kb") != "") & (kb != F.col("doc_kb")), F.struct(
            F.lit("vector_kb_mismatch").alias("kind"), F.col("document_id").alias("subject"), _detail(vector_kb=kb, doc_kb=F.col("doc_kb"), chunks=n).alias("detail"))),
        F.when(named & ~known & F.col("is_wiki").isNull(), F.struct(
            F.lit("orphan_vector_doc").alias("kind"), F.col("document_id").alias("subject"), _detail(chunks=n, kb_id=kb, source_kind=kind).alias("detail"))),
        F.when(named & (kb == ""), F.struct(
            F.lit("vector_kb_blank").alias("kind"), F.col("document_id").alias("subject"), _detail(chunks=n).alias("detail"))),
        F.when(named & (kb != "") & F.col("kb_known").isNull(), F.struct(
            F.lit("vector_kb_missing").alias("kind"), F.col("document_id").alias("subject"), _detail(kb_id=kb, chunks=n).alias("detail")))))
    return rows.select(F.explode(found).alias("f")).select("f.*")


def missing_vectors(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Published documents with chunks on record that have none in the store."""
    due = docs.filter((F.col("status") == "published") & (F.col("chunks_count") > 0))
    gone = due.join(refs.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")
    return gone.select(F.lit("missing_vectors").alias("kind"), F.col("doc_id").alias("subject"),
                       _detail(chunks_count=F.col("chunks_count")).alias("detail"))


def object_key(path: Column, bucket: str) -> Column:
    """Key of ``minio://bucket/key``; null for other schemes, other buckets and empty keys."""
    key = F.regexp_extract(F.coalesce(path, F.lit("")), rf"^minio://{bucket}/(.+)$", 1)
    return F.when(key != "", key)


def classify_objects(keys: DataFrame, expected: DataFrame) -> DataFrame:
    """Objects nobody refers to, and referred objects that are not there."""
    a = keys.select("key").distinct().withColumn("here", F.lit(True))
    b = expected.select("key").distinct().withColumn("wanted", F.lit(True))
    both = a.join(b, "key", "full_outer")
    kind = F.when(F.col("wanted").isNull(), "orphan_object").when(F.col("here").isNull(), "missing_object")
    return both.select(kind.alias("kind"), F.col("key").alias("subject"), F.lit("{}").alias("detail")).filter(F.col("kind").isNotNull())


def classify_cache(entries: DataFrame, docs: DataFrame, wiki_ids: DataFrame, kbs: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """Expired entries, entries citing dead sources (at most 10 named), entries of unknown bases.

    ``entries``: entry_id, question, created_at, kb_ids[], sources[{document_id, source_kind}].
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    head = F.substring("question", 1, 80)
    expired = entries.filter(age > ttl_seconds).select(
        F.lit("expired_cache_entry").alias("kind"), F.col("entry_id").alias("subject"),
        _detail(question=head, age_hours=F.round(age / 3600, 1)).alias("detail"))
    cited = entries.select("entry_id", "question", F.explode("sources").alias("s")).select(
        "entry_id", "question", F.col("s.document_id").alias("doc_id"), F.coalesce("s.source_kind", F.lit("")).alias("kind")).filter(
        (F.coalesce("doc_id", F.lit("")) != "") & (F.col("kind") != MEMORY))
    live = docs.filter(F.col("status") == "published").select("doc_id", F.lit("raw").alias("pool")).unionByName(
        wiki_ids.select(F.col("id").alias("doc_id"), F.lit("wiki").alias("pool")))
    dead = cited.withColumn("pool", F.when(F.col("kind") == "wiki", "wiki").otherwise("raw")).join(live, ["doc_id", "pool"], "left_anti")
    stale = dead.groupBy("entry_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_set("doc_id")).alias("m")).select(
        F.lit("stale_cache_entry").alias("kind"), F.col("entry_id").alias("subject"),
        _detail(question=head, missing_document_ids=F.array_join(F.slice("m", 1, 10), ","), missing_count=F.size("m")).alias("detail"))
    scopes = entries.select("entry_id", "question", F.explode("kb_ids").alias("kb_id")).filter((F.col("kb_id") != "") & (F.col("kb_id") != "all"))
    unknown = scopes.join(kbs.select("kb_id"), "kb_id", "left_anti").groupBy("entry_id").agg(
        F.first("question").alias("question"), F.array_sort(F.collect_list("kb_id")).alias("m")).select(
        F.lit("stale_cache_kb").alias("kind"), F.col("entry_id").alias("subject"),
        _detail(question=head, missing_kb_ids=F.array_join(F.slice("m", 1, 5), ",")).alias("detail"))
    return expired.unionByName(stale).unionByName(unknown)


def dangling_members(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Scopes listed in the base index that hold no entry."""
    return index.join(entries.select("scope_key").distinct(), "scope_key", "left_anti").select(
        F.lit("dangling_index_member").alias("kind"), F.col("scope_key").alias("subject"), _detail(kb_id=F.col("kb_id")).alias("detail"))


def report(findings: DataFrame, samples: int = 5) -> DataFrame:
    """(section, kind, count, samples): first subjects by name; only the samples are gathered."""
    from pyspark.sql import Window as W

    counts = findings.groupBy("section", "kind").agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy("section", "kind").orderBy("subject", "detail")
    few = findings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples).groupBy("section", "kind").agg(
        F.array_sort(F.collect_list("subject")).alias("samples"))
    return counts.join(few, ["section", "kind"])


def exit_code(report_rows: DataFrame, failed_sections: list[str]) -> int:
    """2 when a section could not be read, else 1 with findings, else 0."""
    if failed_sections:
        return 2
    return 0 if report_rows.isEmpty() else 1
