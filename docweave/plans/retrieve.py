"""Retrieval for a table of questions as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions.text import tokens
from docweave.operators import context, fusion
from docweave.operators.dense import dense_top_k
from docweave.operators.lexical import bm25_top_k
from docweave.operators.sizing import broadcast_if_small
from docweave.session import cut_lineage


@dataclass(frozen=True)
class RetrievalConfig:
    pool: int = 20
    k: int = 5
    rerank_window: int = 20
    rrf_k: int = 60
    min_score: float = 0.0
    gate: float = 0.3
    fold: bool = False
    expand: bool = False
    budget_chars: int | None = None
    token_budget: int = 4000
    exclude_kinds: tuple[str, ...] = ("wiki", "wiki_syn")


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Stand-in for a model: word hashes added up and scaled to length 1."""
    import re

    import xxhash

    word = re.compile(r"\w+")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, tuple[int, float]] = {}
        for texts in batches:
            out = []
            for text in texts:
                v = np.zeros(dim, np.float32)
                for w in word.findall((text or "").lower()):
                    slot = seen.get(w)
                    if slot is None:
                        h = xxhash.xxh64_intdigest(w)
                        slot = (h % dim, 1.0 if (h >> 32) & 1 else -1.0)
                        if len(seen) < 1_000_000:
                            seen[w] = slot
                    v[slot[0]] += slot[1]
                n = np.linalg.norm(v)
                out.append(v / n if n > 0 else v)
            yield pd.Series(out)

    return embed


def word_overlap(question: Column, content: Column) -> Column:
    """Stand-in scorer: share of the question's words found in the chunk; null without a word."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(content))) / F.size(q))


def retrieve(questions: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(),
             scorer: Callable[[Column, Column], Column] = word_overlap, where: Column | None = None) -> DataFrame:
    """(query_id, rank, document_id, chunk_index, scores, content) that enter the context.

    ``questions``: query_id, text, embedding. ``chunks``: document_id, chunk_index,
    content, embedding, heading_path, source_kind. The filter comes first, each
    channel is cut to its pool, and chunk texts are joined only to the fused pool.
    """
    if where is not None:
        chunks = chunks.filter(where)
    if config.exclude_kinds:
        chunks = chunks.filter(context.retrieval_filter(exclude_kinds=list(config.exclude_kinds)))
    # one 64-bit key per chunk position for the vector channel
    keyed = chunks.withColumn("_key", F.xxhash64("document_id", "chunk_index"))
    near = cut_lineage(dense_top_k(questions, keyed, config.pool, "query_id", "_key"))
    dense = keyed.select(F.col("_key").alias("id"), *fusion.KEY).join(broadcast_if_small(near), "id").select(
        "query_id", F.lit("dense").alias("channel"), *fusion.KEY, "rank", "score")
    sparse = bm25_top_k(chunks, questions, fusion.KEY, "query_id", config.pool, "content_text") if "content_text" in chunks.columns \
        else bm25_top_k(chunks.withColumn("text", F.col("content")), questions, fusion.KEY, "query_id", config.pool)
    sparse = sparse.select("query_id", F.lit("sparse").alias("channel"), *fusion.KEY, "rank", "score")
    # a pool per question, so the chunks are not shuffled to meet it
    fused = cut_lineage(fusion.reciprocal_rank_fusion(dense.unionByName(sparse), ["dense", "sparse"], config.rrf_k))
    pool = chunks.select(*fusion.KEY, "content", "heading_path", "source_kind").join(broadcast_if_small(fused), fusion.KEY)
    if config.fold:
        pool = fusion.fold_table_rows(pool)
    pool = pool.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    hits = fusion.rerank(pool, scorer(F.col("question"), F.col("content")), config.k, config.rerank_window, config.min_score)
    hits = cut_lineage(hits)  # k rows per question, read by every later step
    gate = context.relevance_gate(hits, config.gate).filter("passed").select("query_id")
    hits = hits.join(gate, "query_id", "left_semi").withColumn("score", F.col("rerank_score"))
    if config.expand:
        hits = context.expand_neighbors(hits, chunks, config.budget_chars)
    packed = context.pack_context(context.dedupe_content(hits), config.token_budget)
    return context.lost_in_the_middle(packed)
