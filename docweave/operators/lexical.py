"""BM25: frozen vocabulary, term weights, top-k for a table of queries, statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from docweave.functions.rules import text_windows
from docweave.functions.text import rows_of, tokens
from docweave.operators.sequential import null_safe_join
from docweave.operators.sizing import BROADCAST_ROWS, at_most, broadcast_if_small, salted_join
from docweave.session import cut_lineage

# fixed values: saturation and length normalisation of the term weight
K1 = 1.5
B = 0.75


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5)); negative for terms in over half of the corpus."""
    return F.log((n_docs - df + 0.5) / (df + 0.5))


def term_weight(idf_col: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf_col * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def fit_vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, idf, corpus_size, mean_length): one pass, one shuffle on the term.

    Each document adds one row per distinct term and one row with a null term that
    carries its length, so corpus totals come out of the same aggregation.
    Save the result: later chunks are weighted with this table, never with a refit.
    """
    words = docs.select(tokens(F.col(text_col)).alias("words"))
    length = F.size("words").cast("long")
    total = F.struct(F.lit(None).cast("string").alias("term"), length.alias("length"))
    per_term = F.transform(
        F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("length"))
    )
    counts = (
        words.select(rows_of(F.concat(F.array(total), per_term)).alias("e"))
        .groupBy("e.term").agg(F.count(F.lit(1)).alias("df"), F.sum("e.length").alias("length"))
    )
    corpus = counts.filter(F.col("term").isNull())
    return (
        counts.filter(F.col("term").isNotNull()).select("term", "df")
        .withColumn("corpus_size", corpus.select("df").scalar())
        .withColumn("mean_length", corpus.select(F.col("length") / F.col("df")).scalar())
        .withColumn("idf", idf(F.col("corpus_size"), F.col("df")))
    )


def corpus_totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: corpus_size, mean_length."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("n")).agg(
        F.count(F.lit(1)).alias("corpus_size"), F.avg("n").alias("mean_length"))


def made_once(name: str, array: Column) -> Column:
    """A column that later expressions read and do not make again, not even once per element inside a lambda: the row of a generator over one element."""
    return rows_of(F.array(array)).alias(name)


def counted_terms(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, length, terms): the words of each row counted inside the row, as (term, tf), by sorting them; nothing is shuffled."""
    ordered = docs.select(*keys, made_once("_words", F.array_sort(tokens(F.col(text_col)))))
    n = F.size("_words")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    placed = ordered.select(*keys, "_words", made_once("_at", F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))))
    until = lambda j: F.coalesce(F.get("_at", j + 1), n)
    counts = F.transform("_at", lambda i, j: F.struct(F.get("_words", i).alias("term"), (until(j) - i).cast("long").alias("tf")))
    return placed.select(*keys, n.cast("long").alias("length"), made_once("terms", counts))


def postings(docs: DataFrame, keys: list[str], text_col: str = "text",
             only_terms: DataFrame | None = None, few_terms: bool | None = None) -> DataFrame:
    """(keys, term, tf, length). ``only_terms`` prunes before anything is shuffled; pass
    ``few_terms`` when their number is already checked.

    All words are counted inside their row, so that only distinct terms are hashed on the document; the few words that
    ``only_terms`` leaves are hashed as they are and counted there, which spares sorting the rest. Adding up scores per
    question and document and taking norms then happen where the rows lie.
    """
    if only_terms is None:
        rows = counted_terms(docs, keys, text_col).select(*keys, "length", rows_of(F.col("terms")).alias("e"))
        return rows.select(*keys, "e.term", "e.tf", "length").filter(F.col("term").isNotNull()).repartition(*keys)
    words = docs.select(*keys, tokens(F.col(text_col)).alias("words"))
    rows = words.select(*keys, F.size("words").cast("long").alias("length"), rows_of(F.col("words")).alias("term")).filter(
        F.col("term").isNotNull())
    few = at_most(only_terms, BROADCAST_ROWS) if few_terms is None else few_terms
    rows = rows.join(F.broadcast(only_terms) if few else only_terms, "term", "left_semi")
    return rows.repartition(*keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def query_terms(queries: DataFrame, query_key: str, text_col: str = "text") -> DataFrame:
    return queries.select(query_key, rows_of(F.array_distinct(tokens(F.col(text_col)))).alias("term")).filter(F.col("term").isNotNull())


def weighted_postings(docs: DataFrame, keys: list[str], text_col: str = "text",
                      only_terms: DataFrame | None = None, vocabulary: DataFrame | None = None,
                      few_terms: bool | None = None) -> DataFrame:
    """(keys, term, weight) with positive weights only.

    Without a saved vocabulary the document frequencies of the wanted terms are
    counted from the postings themselves.
    """
    if only_terms is not None and few_terms is None:
        few_terms = at_most(only_terms, BROADCAST_ROWS)
    hits = postings(docs, keys, text_col, only_terms, few_terms)
    if vocabulary is None:
        totals = corpus_totals(docs, text_col).select(F.struct("corpus_size", "mean_length")).scalar()
        # an aggregate of all columns keeps both uses of the rows on one shuffle
        stats = (
            hits.groupBy("term").agg(F.count(F.when((F.col("length") > 0) & (F.col("tf") > 0), 1)).alias("df")).withColumn("_t", totals)
            .withColumn("corpus_size", F.col("_t.corpus_size")).withColumn("mean_length", F.col("_t.mean_length"))
            .withColumn("idf", idf(F.col("corpus_size"), F.col("df")))
        )
    else:
        stats = vocabulary
    stats = stats.filter(F.col("idf") > 0).select("term", "idf", "mean_length")
    if few_terms:
        stats = F.broadcast(stats)  # no more rows than wanted terms
    return hits.join(stats, "term").select(
        *keys, "term", term_weight(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean_length")).alias("weight"))


def bm25_scores(docs: DataFrame, queries: DataFrame, keys: list[str], query_key: str,
                text_col: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_key, keys, score) for every pair that shares a term of positive weight.

    Terms are pruned to those some query asks for before the shuffle. The query
    terms are broadcast when their number is proven small; otherwise the join is
    salted by document so that a term found in half of the corpus is spread out.
    """
    asked = query_terms(queries, query_key, text_col)
    few = at_most(asked, BROADCAST_ROWS)
    # few rows hold few distinct terms; many rows may still, so that is then checked by itself
    weights = weighted_postings(docs, keys, text_col, asked.select("term").distinct(), vocabulary, few or None)
    joined = weights.join(F.broadcast(asked), "term") if few else salted_join(weights, asked, ["term"], keys)
    return joined.groupBy(query_key, *keys).agg(F.sum("weight").alias("score"))


def top_k(scored: DataFrame, query_key: str, keys: list[str], k: int, score_col: str = "score") -> DataFrame:
    """First k per query by rounded score, ties by key; the cut runs before the shuffle too."""
    order = [F.round(F.col(score_col), 6).desc(), *[F.col(c) for c in keys]]
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, keys: list[str], query_key: str, k: int,
               text_col: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_key, keys, score, rank): k best rows of ``docs`` per query.

    Query terms of checked number travel to the tasks: each scores its rows where they lie and keeps k per query, so
    neither words nor pairs of query and row are shuffled, only terms' frequencies and queries x k x tasks rows.
    More query terms, or keys that are neither whole numbers nor strings, go by a join of the words.
    """
    plain = all(isinstance(docs.schema[c].dataType, (T.IntegralType, T.StringType)) for c in keys)
    asked = query_terms(queries, query_key, text_col).select(F.col(query_key).alias("q"), "term").limit(BROADCAST_ROWS + 1).collect() if plain else []
    if not plain or len(asked) > BROADCAST_ROWS:
        return top_k(bm25_scores(docs, queries, keys, query_key, text_col, vocabulary), query_key, keys, k)
    return top_k(_scored_in_task(docs, asked, queries.schema[query_key], keys, k, text_col, vocabulary), query_key, keys, k)


def rows_of_words(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, words, length, n): the words of each row; the n rows that share their keys are one."""
    words = docs.select(*keys, tokens(F.col(text_col)).alias("words"))
    size = F.size("words").cast("long")
    again = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    one = lambda rows: rows.withColumns({"length": size, "n": F.lit(1).cast("long")})
    if at_most(again, 0):
        return one(words)
    again = cut_lineage(again)
    both = null_safe_join(words, again, keys).groupBy(*keys).agg(
        F.flatten(F.collect_list("words")).alias("words"), F.first(size).alias("length"), F.count(F.lit(1)).alias("n"))
    return one(null_safe_join(words, again, keys, "left_anti")).unionByName(both)


def _occurrences(lists: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``terms``, tf) of the wanted terms, by row and place."""
    at = pc.index_in(lists.flatten(), value_set=terms)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[known]
    code, tf = np.unique(row * max(1, len(terms)) + at.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
    return code // max(1, len(terms)), code % max(1, len(terms)), tf


def _weighted_terms(rows: DataFrame, terms: list[str]) -> tuple[dict[str, float], float]:
    """Terms with a positive idf, and the mean length; a task gives one row per term and two for the totals."""
    packed = rows.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(packed.value) + 2, np.int64)
        for batch in batches:
            n[2:] += np.bincount(_occurrences(batch.column("words"), packed.value)[1], minlength=len(packed.value))
            n[:2] += pc.sum(batch.column("n")).as_py() or 0, pc.sum(pc.list_value_length(batch.column("words"))).as_py() or 0
        yield pa.record_batch({"at": pa.array(np.arange(len(n)), pa.int64()), "n": pa.array(n, pa.int64())})

    found = dict(rows.select("words", "n").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
    corpus, length = found.get(0, 0), found.get(1, 0)
    weights = {term: math.log((corpus - found[i] + 0.5) / (found[i] + 0.5)) for i, term in enumerate(terms, 2) if found.get(i)}
    return {term: w for term, w in weights.items() if w > 0}, length / max(1, corpus)


#: Cells of row and query, and entries of row, term and query, that a task holds at once.
CELLS = 2_000_000


def _scored_in_task(docs: DataFrame, asked: list, query_field: T.StructField, keys: list[str], k: int,
                    text_col: str, vocabulary: DataFrame | None) -> DataFrame:
    """(query_key, keys, score): for each task and query, the k best rows that share a term of positive weight."""
    spark = docs.sparkSession
    rows = rows_of_words(docs, keys, text_col)
    wanted = sorted({term for _, term in asked})
    if vocabulary is None:
        weight, mean = _weighted_terms(rows, wanted)
        known = {term: (w, mean) for term, w in weight.items()}
    else:
        names = F.broadcast(spark.createDataFrame([(x,) for x in wanted], "term string"))
        known = {r[0]: (r[1], r[2]) for r in vocabulary.filter(F.col("idf") > 0).join(names, "term").select("term", "idf", "mean_length").collect()}
    terms, questions = sorted(known), list(dict.fromkeys(q for q, _ in asked))
    term_at, query_at = ({x: i for i, x in enumerate(xs)} for xs in (terms, questions))
    pairs = np.array(sorted((term_at[term], query_at[q]) for q, term in asked if term in known), np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    packed = spark.sparkContext.broadcast((pa.array(terms, pa.string()), np.array([known[x] for x in terms], float).reshape(-1, 2), first, pairs[:, 1].copy()))
    n, names = len(questions), [f"k{i}" for i in range(len(keys))]
    order = [("q", "ascending"), ("shown", "descending"), *[(c, "ascending") for c in names]]

    def scores_of(part: pa.RecordBatch) -> np.ndarray:
        terms, weights, first, who = packed.value
        row, term, tf = _occurrences(part.column("words"), terms)
        scores = np.zeros(part.num_rows * n)
        if len(row):
            length = part.column("length").to_numpy(zero_copy_only=False)[row]
            weight = weights[term, 0] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / weights[term, 1]))
            times = first[term + 1] - first[term]
            upto = np.cumsum(times)
            cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(CELLS, upto[-1], CELLS)) + 1, len(row)])
            for lo, hi in zip(cuts, cuts[1:]):
                t, base = times[lo:hi], row[lo] * n
                query = who[np.arange(t.sum()) + np.repeat(first[term[lo:hi]] - (np.cumsum(t) - t), t)]
                sums = np.bincount(np.repeat(row[lo:hi] * n - base, t) + query, weights=np.repeat(weight[lo:hi], t))
                scores[base:base + len(sums)] += sums
        return scores.reshape(part.num_rows, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, size = None, np.full(n, -np.inf), 64
        for batch in batches:
            at = 0
            while at < batch.num_rows and n:
                # the first pieces are small: they set a bound for the others
                part = batch.slice(at, min(size, max(1, CELLS // n)))
                at, size = at + part.num_rows, min(size * 2, CELLS)
                scores = scores_of(part)
                x, q = np.nonzero((scores > 0) & (scores * 1e6 + 0.5 >= low))
                if not len(x):
                    continue
                score = scores[x, q]
                new = pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(score), "shown": pa.array(np.floor(score * 1e6 + 0.5)),
                                **{c: part.column(c).take(pa.array(x)) for c in names}})
                held = new if held is None else pa.concat_tables([held, new])
                held = held.take(pc.sort_indices(held, sort_keys=order, null_placement="at_start"))
                q = held["q"].to_numpy()
                place = np.arange(len(q)) - np.searchsorted(q, q)
                last = place == k - 1
                low[q[last]] = held["shown"].to_numpy()[last]
                held = held.filter(pa.array(place < k)).combine_chunks()
        if held is not None:
            yield from held.drop_columns(["shown"]).to_batches()

    schema = ", ".join(["q long", "score double", *[f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(names, keys)]])
    found = rows.select("words", "length", *[F.col(c).alias(name) for name, c in zip(names, keys)]).mapInArrow(scan, schema)
    listed = spark.createDataFrame(list(enumerate(questions)), T.StructType([T.StructField("q", T.LongType()), T.StructField("_key", query_field.dataType)]))
    return found.join(F.broadcast(listed), "q").select(
        F.col("_key").alias(query_field.name), *[F.col(name).alias(c) for name, c in zip(names, keys)], "score")


def sparse_statistics(docs: DataFrame, keys: list[str], vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows, rows with a weight, their share, mean weights per row, and the warning flag.

    The vocabulary is suspect when it was fitted on under a tenth of the rows.
    """
    weights = weighted_postings(docs, keys, text_col, vocabulary=vocabulary)
    per_row = weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("nnz"))
    rows = docs.agg(F.count(F.lit(1)).alias("rows"))
    fitted = vocabulary.agg(F.max("corpus_size").alias("n"))
    return (
        per_row.agg(F.count(F.lit(1)).alias("non_empty"), F.sum("nnz").alias("nnz"))
        .withColumn("n_rows", rows.scalar())
        .select(
            "n_rows", "non_empty",
            F.round(F.col("non_empty") / F.col("n_rows"), 6).alias("non_empty_ratio"),
            F.round(F.col("nnz") / F.col("n_rows"), 6).alias("mean_nnz"),
            (fitted.scalar() * 10 < F.col("n_rows")).alias("suspect"),
        )
    )


#: Short passages that one expression tests.
FEW_PASSAGES = 1000


def containing_documents(docs: DataFrame, passages: DataFrame, doc_key: str, passage_key: str) -> DataFrame:
    """(passage_key, doc_key) for documents whose text contains the passage verbatim.

    Every container of a passage holds its inner words, so the rarest inner word is
    an exact anchor: an equi-join on it gives the candidates, then the text decides.
    Passages of fewer than three words have no inner word; a few are tested against
    every text by one expression, more of them are joined with the texts' windows of their lengths.
    """
    words = tokens(F.col("text"))
    body = passages.select(passage_key, F.col("text").alias("passage"), words.alias("w"))
    inner = body.filter(F.size("w") >= 3).select(
        passage_key, F.explode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("term")).distinct()
    wanted = inner.select("term").distinct()
    doc_terms = docs.select(doc_key, rows_of(F.array_distinct(words)).alias("term")).join(
        broadcast_if_small(wanted), "term", "left_semi")
    df = doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    anchors = inner.join(df, "term", "left").groupBy(passage_key).agg(
        F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    pairs = doc_terms.join(broadcast_if_small(anchors), "term").select(passage_key, doc_key)
    texts = docs.select(doc_key, "text")
    found = pairs.join(texts, doc_key).join(body.select(passage_key, "passage"), passage_key).filter(
        F.contains("text", "passage")).select(passage_key, doc_key)
    short = body.filter((F.size("w") < 3) & (F.col("passage") != "")).select(passage_key, "passage")
    few = short.limit(FEW_PASSAGES + 1).collect()
    if len(few) > FEW_PASSAGES:
        windows = text_windows(docs, doc_key, "text", short, "passage").distinct()
        found = found.unionByName(windows.join(short, F.col("window") == F.col("passage")).select(passage_key, doc_key))
    elif few:
        listed = F.array(*[F.struct(F.lit(r[0]).alias("key"), F.lit(r[1]).alias("passage")) for r in few])
        hit = F.filter(listed, lambda p: F.contains(F.col("text"), p["passage"]))
        found = found.unionByName(
            docs.select(doc_key, F.explode(hit).alias("p")).select(F.col("p.key").alias(passage_key), doc_key))
    return found
