"""State changes as table rewrites: retention, cascades, cache upkeep, page upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.operators.sizing import at_most


def retain(rows: DataFrame, created: str, now: Column, days: int) -> DataFrame:
    """Rows not older than the given days."""
    return rows.filter(F.col(created) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def retention_counts(tables: dict[str, tuple[DataFrame, str, int]], now: Column) -> DataFrame:
    """(table, kept, deleted) for every table: one scan each, counts only."""
    out = None
    for name, (rows, created, days) in tables.items():
        keep = F.col(created) >= now - F.expr(f"INTERVAL {int(days)} DAYS")
        part = rows.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("deleted")).select(F.lit(name).alias("table"), "kept", "deleted")
        out = part if out is None else out.unionByName(part)
    return out


def recover_stale(docs: DataFrame, now: Column, after_seconds: int = 900) -> DataFrame:
    """Documents stuck in processing or uploading are marked failed."""
    stuck = F.col("processing_status").isin("processing", "uploading") & (
        F.col("updated_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > after_seconds))
    return docs.withColumn("recovered", stuck).withColumn("processing_status", F.when(stuck, "failed").otherwise(F.col("processing_status")))


def change_status(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents after the wanted status changes, with what has to follow.

    ``changes``: doc_id, new_status. Leaving published drops the chunks and sets the count
    to 0, entering it asks for a new index, a document in processing is rejected.
    """
    j = docs.join(changes, "doc_id", "left")
    busy = F.col("processing_status").isin("processing", "uploading", "pending")
    was, wanted = F.col("status") == "published", F.col("new_status") == "published"
    action = (F.when(F.col("new_status").isNull() | (F.col("new_status") == F.col("status")), "none").when(busy, "rejected")
              .when(was & ~wanted, "drop_chunks").when(~was & wanted, "reindex").otherwise("none"))
    return j.withColumn("action", action).withColumn(
        "chunks_count", F.when(F.col("action") == "drop_chunks", 0).otherwise(F.col("chunks_count"))).withColumn(
        "status", F.when(F.col("new_status").isNotNull() & (F.col("action") != "rejected"), F.col("new_status")).otherwise(F.col("status"))).drop("new_status")


def worth_keeping(answer_type: Column, answer: Column, sources: Column, web_context: Column, min_chars: int = 200) -> Column:
    """Answers from the base alone, long enough, and from two documents or any compiled page."""
    ids = F.array_distinct(F.filter(F.transform(sources, lambda s: s["document_id"]), lambda d: F.coalesce(d, F.lit("")) != ""))
    wiki = F.exists(sources, lambda s: F.coalesce(s["source_kind"] == "wiki", F.lit(False)))
    return (answer_type.isin("knowledge_base", "hybrid_search") & ~web_context & (F.length(F.coalesce(answer, F.lit(""))) >= min_chars)
            & ((F.size(ids) >= 2) | wiki))


def live_entries(entries: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(entry_id, alive, missing[]): an entry lives while all its base sources do.

    A document must be published and inside the scope of the entry (no scope: any); a
    page must not be deleted. Sources from the web or tools and entries without ids are
    not judged.
    """
    cited = entries.select("entry_id", "kb_ids", F.explode_outer("sources").alias("s")).filter(
        F.coalesce(F.col("s.source_type"), F.lit("kb")) == "kb").select(
        "entry_id", "kb_ids", F.trim(F.coalesce("s.document_id", F.lit(""))).alias("doc_id"),
        (F.coalesce("s.source_kind", F.lit("")) == "wiki").alias("wiki")).filter("doc_id <> ''")
    docs = docs.filter(F.col("status") == "published").select("doc_id", F.lit(False).alias("wiki"), F.col("kb_id").alias("home"))
    pages = pages.filter(F.col("status") != "deleted").select(F.col("id").alias("doc_id"), F.lit(True).alias("wiki"), F.lit(None).cast("string").alias("home"))
    j = cited.join(docs.unionByName(pages).withColumn("there", F.lit(True)), ["doc_id", "wiki"], "left")
    scoped = F.size(F.filter("kb_ids", lambda k: k != "all")) > 0
    inside = F.col("wiki") | ~scoped | F.col("home").isNull() | F.array_contains("kb_ids", F.coalesce("home", F.lit("")))
    ok = F.coalesce(F.col("there"), F.lit(False)) & inside
    judged = j.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.when(~ok, F.col("doc_id")))).alias("missing"))
    return entries.select("entry_id").join(judged, "entry_id", "left").select(
        "entry_id", (F.coalesce(F.size("missing"), F.lit(0)) <= 0).alias("alive"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def scope_key(user: Column, kb_ids: Column) -> Column:
    """``user:digest`` of the sorted base ids (12 hex), or ``user:all``."""
    digest = F.substring(F.md5(F.array_join(F.array_sort(kb_ids), ",")), 1, 12)
    return F.concat(user, F.lit(":"), F.when(F.coalesce(F.size(kb_ids), F.lit(0)) > 0, digest).otherwise("all"))


def normal_question(question: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(question, F.lit("")), F.lit(" \t\n\r")))


def exact_field(question: Column) -> Column:
    return F.concat(F.lit("exact:"), F.md5(normal_question(question)))


def fresh(created: Column, now: Column, ttl_seconds: int = 86400) -> Column:
    """Still valid exactly at the limit."""
    return F.unix_micros(now) - F.unix_micros(created) <= ttl_seconds * 1_000_000


def trim_cache(entries: DataFrame, now: Column, ttl_seconds: int = 86400, keep: int = 200) -> DataFrame:
    """Expired entries out, then the newest 200 of every scope; the cut runs before the shuffle."""
    w = W.partitionBy("scope_key").orderBy(F.col("created_at").desc(), F.col("entry_id").desc())
    return entries.filter(fresh(F.col("created_at"), now, ttl_seconds)).withColumn("_n", F.row_number().over(w)).filter(
        F.col("_n") <= keep).drop("_n")


def cache_lookup(queries: DataFrame, entries: DataFrame, now: Column, threshold: float = 0.92, keep: int = 200,
                 ttl_seconds: int = 86400) -> DataFrame:
    """(query_id, entry_id, score, match): exact question in the scope first, else best cosine.

    ``queries``: query_id, scope_key, question_norm, embedding; ``entries`` the same with
    entry_id and created_at. Only the newest entries of a scope are compared by vector, so
    a question meets at most ``keep`` rows.
    """
    from docweave.functions.vectors import cosine

    valid = entries.filter(fresh(F.col("created_at"), now, ttl_seconds))
    exact = queries.select("query_id", "scope_key", "question_norm").join(
        valid.select("scope_key", "question_norm", "entry_id"), ["scope_key", "question_norm"]).groupBy("query_id").agg(F.min("entry_id").alias("entry_id")).select(
        "query_id", "entry_id", F.lit(1.0).alias("score"), F.lit("exact").alias("match"))
    recent = trim_cache(valid, now, ttl_seconds, keep).select("scope_key", "entry_id", F.col("embedding").alias("e"))
    open_q = queries.join(exact.select("query_id"), "query_id", "left_anti").select("query_id", "scope_key", "embedding")
    scored = open_q.join(recent, "scope_key").select("query_id", "entry_id", cosine(F.col("embedding"), F.col("e")).alias("score")).filter(
        F.col("score") >= threshold)
    best = scored.groupBy("query_id").agg(F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("entry_id")).alias("i"), F.col("score"))).alias("b")).select(
        "query_id", (-F.col("b.i")).alias("entry_id"), F.col("b.score").alias("score"), F.lit("semantic").alias("match"))
    return exact.unionByName(best)


def invalidate_bases(entries: DataFrame, changed: list[str] | DataFrame) -> DataFrame:
    """Entries left after bases changed: those whose scope holds one of them, or all, go."""
    if isinstance(changed, list):
        return entries.filter(~F.arrays_overlap("kb_ids", F.array(*[F.lit(c) for c in [*changed, "all"]])))
    hit = entries.select("entry_id", F.explode("kb_ids").alias("kb_id")).join(changed.select("kb_id"), "kb_id", "left_semi")
    some = F.lit(not at_most(changed, 0))
    gone = hit.select("entry_id").unionByName(entries.filter(F.array_contains("kb_ids", "all") & some).select("entry_id")).distinct()
    return entries.join(gone, "entry_id", "left_anti")


def candidate_scopes(index: DataFrame, kb_id: str) -> DataFrame:
    """Scopes to look at for a base: those listed for it and those listed for all."""
    return index.filter(F.col("kb_id").isin(kb_id, "all")).select("scope_key").distinct()


def cascade_documents(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Pages touched by deleted documents: remaining sources, and delete or rewrite.

    Sources are matched by an equi-join on the exploded ids.
    """
    rows = pages.select("id", F.posexplode("source_doc_ids").alias("pos", "doc_id"))
    gone = rows.join(deleted.select("doc_id").withColumn("gone", F.lit(True)), "doc_id", "left")
    left = gone.groupBy("id").agg(
        F.count_if(F.col("gone")).alias("removed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "doc_id")))), lambda x: x["doc_id"]).alias("source_doc_ids"))
    return left.filter(F.col("removed") > 0).withColumn("action", F.when(F.size("source_doc_ids") == 0, "delete").otherwise("rewrite"))


def delete_where(tables: dict[str, DataFrame], key: dict[str, str], gone: DataFrame, gone_key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows left per table, counts per table) after deleting every row that refers to ``gone``."""
    left, counts = {}, None
    for name, rows in tables.items():
        ids = gone.select(F.col(gone_key).alias(key[name])).distinct()
        left[name] = rows.join(ids, key[name], "left_anti")
        n = rows.join(ids, key[name], "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def single_default(kbs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen base of an owner is its only default; other owners keep theirs."""
    j = kbs.join(chosen.select("owner_id", F.col("kb_id").alias("_c")), "owner_id", "left")
    return j.withColumn("is_default", F.when(F.col("_c").isNull(), F.col("is_default")).otherwise(F.col("kb_id") == F.col("_c"))).drop("_c")


def upsert_pages(stored: DataFrame, fresh_pages: DataFrame) -> DataFrame:
    """Pages after a compile: same (kb, type, title) gets revision + 1 and the united sources."""
    key = ["kb_id", "page_type", "title"]
    new = fresh_pages.select(*key, F.col("content").alias("n_content"), F.col("source_doc_ids").alias("n_src"))
    j = stored.join(new, key, "full_outer")
    none = F.array().cast("array<string>")
    came, was = F.col("n_content").isNotNull(), F.col("revision").isNotNull()
    return j.select(
        *key, F.when(came, F.col("n_content")).otherwise(F.col("content")).alias("content"),
        F.when(came, F.array_union(F.coalesce("source_doc_ids", none), F.coalesce("n_src", none))).otherwise(F.col("source_doc_ids")).alias("source_doc_ids"),
        F.when(came & was, F.col("revision") + 1).when(came, 1).otherwise(F.col("revision")).alias("revision"),
        F.when(came & was, "updated").when(came, "created").otherwise("kept").alias("change"))


def delete_experiments(requested: DataFrame, experiments: DataFrame) -> DataFrame:
    """(experiment_id, deleted, reason) for every id asked for."""
    j = requested.distinct().join(experiments.select("experiment_id").withColumn("there", F.lit(True)), "experiment_id", "left")
    return j.select("experiment_id", F.col("there").isNotNull().alias("deleted"), F.when(F.col("there").isNull(), "not found").alias("reason"))


# fixed values: name space of URLs, and the prefix of the name
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
MEMORY_NAME = "agent-memory:"


def memory_document_id(session_id: Column) -> Column:
    """Name-based id (SHA-1, version 5) under which a session's memory chunks are stored."""
    name = F.encode(F.concat(F.lit(MEMORY_NAME), session_id.cast("string")), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
