"""Filters, gates and context building for ranked chunks.

Frames here are already cut to the top rows of each query, so a per-query list or
window is bounded by that cut and not by the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.functions.text import estimate_tokens, normalize_title
from docweave.operators.sizing import broadcast_if_small

UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
DEFAULT_EXCLUDED_KINDS = "wiki,wiki_syn"


def _kind(value: str) -> str:
    value = str(value)
    if len(value) > 16 or not all(c.isalnum() or c == "_" for c in value):
        raise ValueError(f"bad source kind: {value[:32]}")
    return value


def _ids(values: list[str]) -> list[str]:
    for v in values:
        if not UUID.match(str(v)):
            raise ValueError(f"bad id: {str(v)[:64]}")
    return [str(v) for v in values]


def retrieval_filter(kb_ids: list[str] | None = None, document_ids: list[str] | None = None,
                     source_kind: str | None = None, exclude_kinds: list[str] | None = None) -> Column:
    """AND of the given conditions. None or an empty list sets no condition; a null kind is ``raw``."""
    cond = F.lit(True)
    kind = F.coalesce("source_kind", F.lit("raw"))
    if kb_ids:
        cond = cond & F.col("kb_id").isin(_ids(kb_ids))
    if document_ids:
        cond = cond & F.col("document_id").isin(_ids(document_ids))
    if source_kind:
        cond = cond & (kind == _kind(source_kind))
    if exclude_kinds:
        cond = cond & ~kind.isin([_kind(k) for k in exclude_kinds])
    return cond


def excluded_kinds(configured: str = DEFAULT_EXCLUDED_KINDS) -> list[str]:
    return [k.strip() for k in configured.split(",") if k.strip()]


def relevance_gate(hits: DataFrame, threshold: float = 0.3, score: str = "rerank_score") -> DataFrame:
    """(query_id, chunks, max_score, avg_score, passed) over the rows that vote.

    Neighbour rows vote only when a query has nothing else. A query flagged
    ``rerank_fallback`` has no relevance scores: it passes and its average is null.
    """
    own = ~F.col("neighbor_expand") if "neighbor_expand" in hits.columns else F.lit(True)
    fallback = F.col("rerank_fallback") if "rerank_fallback" in hits.columns else F.lit(False)
    value = F.coalesce(F.col(score), F.lit(0.0))
    agg = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(own).alias("_own"),
        F.max(F.when(own, value)).alias("_max_own"), F.avg(F.when(own, value)).alias("_avg_own"),
        F.max(value).alias("_max"), F.avg(value).alias("_avg"),
        F.coalesce(F.bool_or(fallback & own), F.lit(False)).alias("_fb_own"), F.bool_or(fallback).alias("_fb"))
    has = F.col("_own") > 0
    top, mean = F.when(has, F.col("_max_own")).otherwise(F.col("_max")), F.when(has, F.col("_avg_own")).otherwise(F.col("_avg"))
    fb = F.when(has, F.col("_fb_own")).otherwise(F.col("_fb"))
    return agg.select(
        "query_id", F.when(has, F.col("_own")).otherwise(F.col("_all")).alias("chunks"),
        F.when(~fb, top).alias("max_score"), F.when(~fb, mean).alias("avg_score"),
        (fb | (top >= threshold) | (mean >= threshold)).alias("passed"))


def gate_suppressions(hits: DataFrame, threshold: float = 0.3, score: str = "rerank_score") -> DataFrame:
    """What the gate threw away: scores, distance to the threshold, start of the first chunk."""
    first = hits.groupBy("query_id").agg(F.min_by("content", "rank").alias("first"))
    gate = relevance_gate(hits, threshold, score).filter(~F.col("passed"))
    return gate.join(first, "query_id").select(
        "query_id", F.lit(float(threshold)).alias("threshold"), "chunks",
        F.round("max_score", 4).alias("max_score"), F.round("avg_score", 4).alias("avg_score"),
        F.round(F.lit(float(threshold)) - F.col("max_score"), 4).alias("gap_to_threshold"),
        F.regexp_replace(F.substring(F.coalesce("first", F.lit("")), 1, 80), "\n", " ").alias("top1_preview"))


def neighbor_positions(base: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_index) next to a base row, index >= 0, each once."""
    return (
        base.select("query_id", "document_id", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
        .filter(F.col("chunk_index") >= 0).distinct()
    )


def neighbor_rows(base: DataFrame, chunks: DataFrame, same_heading: bool = True) -> DataFrame:
    """One row per (base row, side) with the chunk found there, optionally same section only.

    Columns: query_id, parent_rank, side (-1 or 1), parent_score, and the chunk columns.
    A neighbour with a heading is dropped when every selected parent beside it has
    another non-empty heading.
    """
    sides = base.select(
        "query_id", "document_id", F.col("rank").alias("parent_rank"), F.col("score").alias("parent_score"),
        F.coalesce("heading_path", F.lit("")).alias("parent_heading"), F.col("chunk_index").alias("parent_index"),
        F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"),
    ).withColumn("chunk_index", F.col("parent_index") + F.col("side")).filter(F.col("chunk_index") >= 0)
    # few rows per query, so the chunks are not shuffled to meet them
    found = chunks.select("document_id", "chunk_index", "content", "heading_path").join(broadcast_if_small(sides), ["document_id", "chunk_index"])
    if same_heading:
        child = F.coalesce("heading_path", F.lit(""))
        fits = (child == "") | (F.col("parent_heading") == "") | (F.col("parent_heading") == child)
        kept = found.groupBy("query_id", "document_id", "chunk_index").agg(F.bool_or(fits).alias("_fits")).filter("_fits")
        found = found.join(kept.drop("_fits"), ["query_id", "document_id", "chunk_index"], "left_semi")
    return found


def expand_neighbors(base: DataFrame, chunks: DataFrame, budget_chars: int | None = None,
                     same_heading: bool = True) -> DataFrame:
    """Base rows first, then for each in rank order its -1 and +1 neighbour.

    A neighbour already present, or one that would exceed the character budget, is
    skipped and later ones are still tried. It inherits the score of the parent before
    it, else of the one after it, and is flagged ``neighbor_expand``.
    """
    found = neighbor_rows(base, chunks, same_heading)
    found = found.join(base.select("query_id", "document_id", "chunk_index"),
                       ["query_id", "document_id", "chunk_index"], "left_anti")
    # one row per neighbour, placed where it is first met; the parent before it has side +1
    each = found.groupBy("query_id", "document_id", "chunk_index").agg(
        F.min(F.struct("parent_rank", "side")).alias("place"),
        F.max_by("parent_score", "side").alias("score"),
        F.first("content").alias("content"), F.first("heading_path").alias("heading_path"))
    used = base.groupBy("query_id").agg(F.sum(F.length("content")).cast("long").alias("used"), F.max("rank").alias("last"))
    listed = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.length("content").cast("long").alias("grow"), "document_id", "chunk_index", "score", "content", "heading_path",
    ))).alias("items")).join(used, "query_id")
    empty = F.filter("items", lambda x: F.lit(False))
    if budget_chars is None:
        listed = listed.withColumn("taken", F.col("items"))
    else:
        listed = listed.withColumn("taken", F.aggregate(
            "items", F.struct(F.col("used").alias("used"), empty.alias("kept")),
            lambda acc, x: F.when(
                acc["used"] + x["grow"] <= budget_chars,
                F.struct((acc["used"] + x["grow"]).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept")),
            ).otherwise(acc), lambda acc: acc["kept"]))
    added = listed.select("query_id", "last", F.posexplode("taken").alias("pos", "x")).select(
        "query_id", "x.document_id", "x.chunk_index", (F.col("last") + F.col("pos") + 1).cast("int").alias("rank"), "x.score",
        "x.content", "x.heading_path", F.lit(True).alias("neighbor_expand"))
    kept = base.select("query_id", "document_id", "chunk_index", F.col("rank").cast("int").alias("rank"), "score",
                       "content", "heading_path", F.lit(False).alias("neighbor_expand"))
    return kept.unionByName(added)


def table_refill(base: DataFrame, chunks: DataFrame, header: Column, budget_chars: int) -> DataFrame:
    """Other rows of the tables a query hit, in document order, under the budget."""
    heads = base.withColumn("_h", header).filter(F.col("_h").isNotNull()).groupBy("query_id", "document_id", "_h").agg(
        F.min("rank").alias("parent_rank"))
    rows = chunks.withColumn("_h", header).filter(F.col("_h").isNotNull()).select("document_id", "chunk_index", "content", "_h")
    new = rows.join(heads, ["document_id", "_h"]).join(
        base.select("query_id", "document_id", "chunk_index"), ["query_id", "document_id", "chunk_index"], "left_anti")
    used = base.groupBy("query_id").agg(F.sum(F.length("content")).cast("long").alias("used"))
    order = W.partitionBy("query_id").orderBy("parent_rank", "document_id", "chunk_index")
    new = new.withColumn("pos", F.row_number().over(order))
    return greedy_budget(new.join(used, "query_id"), ["document_id", "chunk_index", "content"],
                         F.col("pos"), F.length("content").cast("long"), budget_chars, F.col("used"))


def greedy_budget(items: DataFrame, payload: list[str], order: Column, cost: Column, budget: int,
                  used: Column | None = None) -> DataFrame:
    """Take rows of a query in order while they fit; rows that do not are skipped, not a stop.

    The fold runs in the JVM over the ordered list of the query's candidate rows.
    """
    start = F.lit(0).cast("long") if used is None else used.cast("long")
    fits = items.withColumn("_o", order).withColumn("_c", cost.cast("long")).withColumn("_u", start).filter(
        F.col("_c") + F.col("_u") <= budget)
    listed = fits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_o", "_c", *payload))).alias("items"), F.first("_u").alias("_u"))
    taken = F.aggregate(
        "items", F.struct(F.col("_u").alias("used"), F.filter("items", lambda x: F.lit(False)).alias("kept")),
        lambda acc, x: F.when(
            acc["used"] + x["_c"] <= budget,
            F.struct((acc["used"] + x["_c"]).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc), lambda acc: acc["kept"])
    return listed.select("query_id", F.posexplode(taken).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("position"), *[F.col(f"x.{c}").alias(c) for c in payload])


def content_key(content: Column) -> Column:
    return F.md5(F.regexp_replace(F.trim(F.coalesce(content, F.lit(""))), r"(?U)\s+", " "))


def dedupe_content(hits: DataFrame) -> DataFrame:
    """Best scored row of every content per query; equal scores keep the earlier rank."""
    w = W.partitionBy("query_id", "_k").orderBy(F.col("score").desc(), F.col("rank"))
    return hits.withColumn("_k", content_key(F.col("content"))).withColumn("_n", F.row_number().over(w)).filter(
        "_n = 1").drop("_k", "_n")


def pack_context(hits: DataFrame, budget: int = 4000, reserve: int = 512, min_score: float = 0.0) -> DataFrame:
    """Rows that enter the context, by score and length, under the token budget.

    ``position`` is the selection order; ties of score prefer the longer chunk.
    """
    rows = hits.withColumn("tokens", estimate_tokens(F.col("content")))
    if min_score > 0:
        rows = rows.filter(F.col("score") >= min_score)
    order = F.struct((-F.col("score")).alias("s"), (-F.col("tokens")).alias("t"), F.col("rank").alias("r"))
    return greedy_budget(rows, ["document_id", "chunk_index", "score", "tokens", "content"],
                         order, F.col("tokens") + 10, max(budget - reserve, 0))


def lost_in_the_middle(selected: DataFrame) -> DataFrame:
    """Final slot of every selected row: best at both ends, weakest in the middle."""
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    i = F.col("position") - 1
    slot = F.when((n <= 2), F.col("position")).when(i % 2 == 0, (i / 2).cast("int") + 1).otherwise(n - ((i - 1) / 2).cast("int"))
    return selected.withColumn("source_index", slot.cast("int"))


def context_header(kind: Column, index: Column, title: Column, url: Column) -> Column:
    """``[n] title (url)`` for web, ``[n] filename`` for base, ``[n] 工具:name`` for tools."""
    title, url = F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("["), index.cast("string"), F.lit("]"))
    web = F.concat(head, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""),
                   F.when(url != "", F.concat(F.lit(" ("), url, F.lit(")"))).otherwise(""))
    return (F.when(kind == "web", web).when(kind == "kb", F.concat(head, F.lit(" "), F.when(title != "", title).otherwise("unknown")))
            .when(kind == "tool", F.concat(head, F.lit(" 工具:"), F.when(title != "", title).otherwise("tool"))).otherwise(head))


def context_text(numbered: DataFrame, header: Column) -> DataFrame:
    """One numbered context per query; its size is bounded by the token budget."""
    part = F.concat(header, F.lit("\n"), F.col("content"))
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("source_index", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def chunk_surroundings(chunks: DataFrame, n: int = 2) -> DataFrame:
    """Each chunk with the text of chunks n before to n after it and its offset inside.

    Neighbours are fetched by an equi-join on shifted positions, so a document of any
    number of chunks is spread over tasks.
    """
    shifted = chunks.select(
        "document_id", F.col("chunk_index").alias("at"), "content",
        F.explode(F.sequence(F.col("chunk_index") - n, F.col("chunk_index") + n)).alias("chunk_index"))
    listed = shifted.groupBy("document_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("at", "content"))).alias("near"),
        F.max(F.col("at") == F.col("chunk_index")).alias("exists")).filter("exists")
    before = F.filter("near", lambda x: x["at"] < F.col("chunk_index"))
    return listed.select(
        "document_id", "chunk_index",
        F.array_join(F.transform("near", lambda x: x["content"]), "\n\n").alias("context"),
        F.aggregate(before, F.lit(0), lambda s, x: s + F.length(x["content"]) + 2).alias("start_offset"))


def expand_links(hits: DataFrame, pages: DataFrame, chunks: DataFrame, per_page: int = 2, in_all: int = 6) -> DataFrame:
    """First chunks of the active pages that hit pages link to, within the same base.

    Targets already hit are left out; score 0 so that no hit is displaced. Chunk order
    is (hit rank, link position, chunk index).
    """
    active = pages.filter(F.col("status") == "active")
    hit_pages = hits.filter(F.col("source_kind") == "wiki").groupBy("query_id", "document_id").agg(F.min("rank").alias("hit_rank"))
    links = hit_pages.join(active.select(F.col("id").alias("document_id"), "kb_id", "links"), "document_id").select(
        "query_id", "hit_rank", "kb_id", F.posexplode("links").alias("link_pos", "title"))
    target = active.select(F.col("id").alias("target_id"), "kb_id", normalize_title(F.col("title")).alias("_t"))
    # pages sharing a title: the one read last wins, as a lookup table would keep it
    target = target.groupBy("kb_id", "_t").agg(F.max("target_id").alias("target_id"))
    reached = links.withColumn("_t", normalize_title(F.col("title"))).join(target, ["kb_id", "_t"])
    reached = reached.join(hit_pages.select("query_id", F.col("document_id").alias("target_id")), ["query_id", "target_id"], "left_anti")
    reached = reached.groupBy("query_id", "target_id").agg(F.min(F.struct("hit_rank", "link_pos")).alias("place"))
    rows = reached.join(chunks.select(F.col("document_id").alias("target_id"), "chunk_index", "content"), "target_id")
    per = W.partitionBy("query_id", "target_id").orderBy("chunk_index")
    rows = rows.withColumn("_n", F.row_number().over(per)).filter(F.col("_n") <= per_page)
    whole = W.partitionBy("query_id").orderBy("place", "chunk_index")
    rows = rows.withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= in_all)
    return rows.select("query_id", F.col("target_id").alias("document_id"), "chunk_index", "content", "position",
                       F.lit(0.0).alias("score"), F.lit(True).alias("link_expanded"))
