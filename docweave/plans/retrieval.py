"""Retrieval queries over whole tables: channels, fusion, folding, gates, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docweave.functions.text import rows_of, tokens
from docweave.operators import context, dense, fusion, lexical
from docweave.operators.chunking import chunk_documents, line_chunks
from docweave.operators.sequential import in_ranges, null_safe_join
from docweave.operators.sizing import broadcast_if_small
from docweave.plans import sqlparts as s
from docweave.plans.catalog import query
from docweave.session import cut_lineage
from docweave.plans.retrieve import RetrievalConfig, hashing_embedder, retrieve


@query("bm25_vocab", f"""
WITH body AS (SELECT doc_id, {s.words('text')} AS w FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM body) GROUP BY term)
SELECT term, df, (SELECT count(*) FROM body) AS corpus_size, round((SELECT avg(len(w)) FROM body), 6) AS mean_length,
  round(ln(((SELECT count(*) FROM body) - df + 0.5) / (df + 0.5)), 6) AS idf FROM df""")
def bm25_vocab(t) -> DataFrame:
    """Frozen vocabulary of the corpus."""
    return lexical.fit_vocabulary(t.documents).withColumns(
        {"mean_length": F.round("mean_length", 6), "idf": F.round("idf", 6)})


BM25_DOCS = s.bm25("documents", "doc_id", "text", "benchmark", "item_id", "text")


@query("bm25_topk", f"""WITH {BM25_DOCS}
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM ({s.ranked('scores', 'item_id', 'doc_id', 10)})""")
def bm25_topk(t) -> DataFrame:
    """Ten best documents for every benchmark text."""
    top = lexical.bm25_top_k(t.documents, t.benchmark, ["doc_id"], "item_id", 10)
    return top.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("sparse_stats", f"""WITH {BM25_DOCS}
SELECT (SELECT count(*) FROM documents) AS n_rows, count(*) AS non_empty,
  round(count(*) / (SELECT count(*) FROM documents), 6) AS non_empty_ratio,
  round(sum(nnz) / (SELECT count(*) FROM documents), 6) AS mean_nnz,
  (SELECT n FROM totals) * 10 < (SELECT count(*) FROM documents) AS suspect
FROM (SELECT doc_id, count(*) AS nnz FROM weights GROUP BY doc_id)""")
def sparse_stats(t) -> DataFrame:
    """State of the sparse index of the corpus."""
    return lexical.sparse_statistics(t.documents, ["doc_id"], lexical.fit_vocabulary(t.documents))


@query("query_coverage", f"""WITH {BM25_DOCS}
SELECT item_id, count(*) AS terms, count(idf) AS known, count(CASE WHEN idf > 0 THEN 1 END) AS weighted
FROM asked LEFT JOIN idf USING (term) GROUP BY item_id""")
def query_coverage(t) -> DataFrame:
    """Terms of each question that the vocabulary knows and weights; none means an empty search."""
    asked = lexical.query_terms(t.benchmark, "item_id")
    vocab = lexical.fit_vocabulary(t.documents).select("term", "idf")
    return asked.join(vocab, "term", "left").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("terms"), F.count("idf").alias("known"),
        F.count(F.when(F.col("idf") > 0, 1)).alias("weighted"))


@query("sparse_self_check", f"""WITH {s.LINE_CHUNKS},
long AS (SELECT document_id, chunk_index, content FROM chunks WHERE length(content) >= 80),
numbered AS (SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS n, count(*) OVER () AS total FROM long),
picked AS (SELECT document_id * 1000000 + chunk_index AS q, substr(content, 1, 200) AS probe FROM numbered
  WHERE n % greatest(total // 50, 1) = 0 AND n // greatest(total // 50, 1) < 50),
{s.bm25('chunks', 'document_id, chunk_index', 'content', 'picked', 'q', 'probe')},
top AS ({s.ranked('scores', 'q', 'document_id, chunk_index', 5)})
SELECT (SELECT count(*) FROM picked) AS probes, count(*) AS found, round(count(*) / (SELECT count(*) FROM picked), 6) AS hit_share
FROM top WHERE q = document_id * 1000000 + chunk_index""")
def sparse_self_check(t) -> DataFrame:
    """Fifty evenly spaced chunks must find themselves in the top five by their first 200 characters."""
    chunks = line_chunks(t.documents)
    probes = evenly_spaced(chunks.filter(F.length("content") >= 80), ["document_id", "chunk_index"], 50)
    probes = cut_lineage(probes.select((F.col("document_id") * 1000000 + F.col("chunk_index")).alias("q"),
                                       F.substring("content", 1, 200).alias("text")))
    top = lexical.bm25_top_k(chunks.withColumnRenamed("content", "text"), probes, ["document_id", "chunk_index"], "q", 5)
    n = probes.agg(F.count(F.lit(1)))
    return top.filter(F.col("q") == F.col("document_id") * 1000000 + F.col("chunk_index")).agg(
        F.count(F.lit(1)).alias("found")).withColumn("probes", n.scalar()).select(
        "probes", "found", F.round(F.col("found") / F.col("probes"), 6).alias("hit_share"))


def evenly_spaced(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every (count // n)-th row in key order, n at most, without one global sort task.

    Rows are counted per value of the first key, and the counts summed up in ranges of about equal size; only the
    rows of the at most n values that hold a wanted number are put in order.
    """
    lead = order[0]
    per = in_ranges(rows.groupBy(lead).agg(F.count(F.lit(1)).alias("_c")), [lead])
    step = max((per.agg(F.sum("_c")).first()[0] or 0) // n, 1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = per.groupBy("_range").agg(F.sum("_c").alias("_sum")).select("_range", before("_sum", W.orderBy("_range")).alias("_before"))
    placed = per.withColumn("_in", before("_c", W.partitionBy("_range").orderBy(lead))).join(F.broadcast(ranges), "_range").select(
        lead, "_c", (F.col("_before") + F.col("_in")).alias("_start"))
    first = F.ceil(F.col("_start") / step) * step
    some = cut_lineage(placed.filter((first < F.col("_start") + F.col("_c")) & (first < n * step)).select(lead, "_start"))
    number = F.row_number().over(W.partitionBy(lead).orderBy(*order)) - 1 + F.col("_start")
    return null_safe_join(rows, F.broadcast(some), [lead]).withColumn("_i", number).filter(
        (F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < n)).drop("_i", "_start")


@query("dense_topk", f"""WITH {s.CHANNELS}
SELECT query_id, document_id AS id, rank, round(score, 6) AS score FROM dense WHERE rank <= 5""")
def dense_topk(t) -> DataFrame:
    """Five nearest other vectors of every vector by inner product."""
    top = dense.dense_top_k(t.embeddings, t.embeddings, 5, "vec_id", "vec_id", exclude_self=True)
    return top.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("dense_topk_cells", f"""WITH {s.CHANNELS}
SELECT query_id, document_id AS id, rank, round(score, 6) AS score FROM dense WHERE rank <= 5""")
def dense_topk_cells(t) -> DataFrame:
    """The same five neighbours by pruned cells, for query tables as large as the corpus."""
    top = dense.dense_top_k_cells(t.embeddings, t.embeddings, 5, "vec_id", "vec_id", cells=16, exclude_self=True)
    return top.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("semantic_duplicates", f"""WITH {s.VECTORS}, p AS (SELECT a.vec_id, b.vec_id AS similar_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, similar_id, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, similar_id) AS rank FROM p WHERE score >= 0.35""")
def semantic_duplicates(t) -> DataFrame:
    """Vectors at or above a cosine of 0.35 with each vector, closest first."""
    pairs = dense.similar_pairs(t.embeddings, "vec_id", 0.35, strict=False)
    both = dense.all_pairs(pairs, t.embeddings, "vec_id").select(F.col("id").alias("vec_id"), F.col("other").alias("similar_id"), "score")
    w = W.partitionBy("vec_id").orderBy(F.round("score", 6).desc(), "similar_id")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("score", F.round("score", 6))


@query("new_syntheses", f"""WITH {s.VECTORS}, p AS (SELECT a.vec_id FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND list_inner_product(a.e, b.e) >= 0.3)
SELECT vec_id, label FROM v WHERE vec_id % 2 = 0 AND vec_id NOT IN (SELECT vec_id FROM p)""")
def new_syntheses(t) -> DataFrame:
    """Even vectors without a close odd one: pages worth adding."""
    even, odd = (t.embeddings.filter(F.col("vec_id") % 2 == r) for r in (0, 1))
    return dense.unlike_existing(even, odd, "vec_id", "vec_id", 0.3).select("vec_id", "label")


@query("self_similarity", f"""WITH {s.VECTORS},
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT a, b, round(score, 6) AS score, 1::BIGINT AS copies_a, 1::BIGINT AS copies_b FROM p WHERE round(score, 6) > 0.3""")
def self_similarity(t) -> DataFrame:
    """Pairs of distinct vectors whose cosine exceeds the threshold."""
    return dense.similar_pairs(t.embeddings, "vec_id", 0.3).withColumn("score", F.round("score", 6))


@query("nearest_class", f"""WITH {s.VECTORS},
m AS (SELECT a.vec_id AS query_id, b.label::VARCHAR AS label, round(max(list_cosine_similarity(a.e, b.e)), 6) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n,
  lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, label) AS second FROM m)
SELECT query_id, CASE WHEN score >= 0.35 THEN label END AS mode, score AS top_score, round(score - second, 6) AS gap FROM r WHERE n = 1""")
def nearest_class(t) -> DataFrame:
    """Mode of every vector by its best example; undecided under the threshold."""
    best = dense.best_class(t.embeddings, t.embeddings, "vec_id", "vec_id", "label", exclude_self=True)
    return classify_modes(best.withColumn("score", F.round("score", 6)), 0.35)


def classify_modes(best: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(query_id, mode or null, top_score, gap to the second mode) from one row per mode."""
    pair = F.struct((-F.col("score")).alias("s"), F.col("label").alias("l"))
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(pair)).alias("m"))
    top = -F.get("m", 0)["s"]
    return listed.select("query_id", F.when(top >= threshold, F.get("m", 0)["l"]).alias("mode"),
                         top.alias("top_score"), F.round(top + F.get("m", 1)["s"], 6).alias("gap"))


#: The vector of a question is the one stored under its number; its words are those of its text.
HYBRID = f"""{s.VECTORS}, {BM25_DOCS},
near AS (SELECT item_id AS query_id, b.vec_id AS document_id, list_inner_product(a.e, b.e) AS score FROM benchmark JOIN v a ON a.vec_id = item_id JOIN v b ON b.vec_id <> a.vec_id),
channels AS (SELECT 1 AS c, query_id, document_id, score, rank FROM ({s.ranked('near', 'query_id', 'document_id', 20)})
  UNION ALL SELECT 2 AS c, item_id, doc_id, score, rank FROM ({s.ranked('scores', 'item_id', 'doc_id', 20)}))"""


def channels(t, size: int = 20) -> DataFrame:
    """Two ranked channels of every benchmark question over the documents: vectors, and BM25 over the words."""
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.dense_top_k(asked, t.embeddings, size, "vec_id", "vec_id", exclude_self=True)
    lexical_ = lexical.bm25_top_k(t.documents, t.benchmark, ["doc_id"], "item_id", size).withColumnsRenamed({"item_id": "query_id", "doc_id": "id"})
    out = [f.select("query_id", F.lit(name).alias("channel"), F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), "rank", "score")
           for name, f in (("dense", near), ("sparse", lexical_))]
    return out[0].unionByName(out[1])


def _fused_sql(score: str, name: str) -> str:
    return f"""fused AS (SELECT query_id, document_id, sum({score}) AS fused,
  coalesce(max(CASE WHEN c = 1 THEN score END), 0) AS dense_score, coalesce(max(CASE WHEN c = 2 THEN score END), 0) AS sparse_score,
  min(c * 1000 + rank) AS seen FROM {name} GROUP BY 1, 2),
out AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, seen, document_id) AS rank FROM fused)"""


def _top(fused: DataFrame, score: str, name: str, k: int = 10, extra: tuple[str, ...] = ()) -> DataFrame:
    return fused.filter(F.col("rank") <= k).select(
        "query_id", "document_id", F.col("rank").cast("long").alias("rank"), F.round(score, 9).alias(name),
        *[F.round(c, 6).alias(c) for c in extra])


@query("rrf_fuse", f"""WITH {HYBRID}, {_fused_sql('1.0 / (60 + rank)', 'channels')}
SELECT query_id, document_id, rank, round(fused, 9) AS rrf_score, round(dense_score, 6) AS dense_score,
  round(sparse_score, 6) AS sparse_score FROM out WHERE rank <= 10""")
def rrf_fuse(t) -> DataFrame:
    return _top(fusion.reciprocal_rank_fusion(channels(t), ["dense", "sparse"]), "rrf_score", "rrf_score",
                extra=("dense_score", "sparse_score"))


@query("weighted_rrf", f"""WITH {HYBRID}, {_fused_sql('CASE c WHEN 1 THEN 0.7 ELSE 0.3 END / (60 + rank)', 'channels')}
SELECT query_id, document_id, rank, round(fused, 9) AS rrf_score FROM out WHERE rank <= 10""")
def weighted_rrf(t) -> DataFrame:
    return _top(fusion.reciprocal_rank_fusion(channels(t), ["dense", "sparse"], weights={"dense": 0.7, "sparse": 0.3}),
                "rrf_score", "rrf_score")


@query("minmax_fuse", f"""WITH {HYBRID},
span AS (SELECT *, min(score) OVER (PARTITION BY query_id, c) AS lo, max(score) OVER (PARTITION BY query_id, c) AS hi FROM channels),
{_fused_sql("CASE c WHEN 1 THEN 0.7 ELSE 0.3 END * CASE WHEN hi > lo THEN 0.5 + 0.5 * (score - lo) / (hi - lo) ELSE 1 END", 'span')}
SELECT query_id, document_id, rank, round(fused, 9) AS fused_score FROM out WHERE rank <= 10""")
def minmax_fuse(t) -> DataFrame:
    return _top(fusion.minmax_fusion(channels(t), {"dense": 0.7, "sparse": 0.3}), "fused_score", "fused_score")


@query("union_candidates", f"""WITH {HYBRID},
u AS (SELECT query_id, document_id, min((3 - c) * 1000 + rank) AS seen FROM channels GROUP BY 1, 2),
out AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, document_id) AS rank FROM u)
SELECT query_id, document_id, rank FROM out WHERE rank <= 25""")
def union_candidates(t) -> DataFrame:
    out = fusion.union_candidates(channels(t), ["sparse", "dense"], 25)
    return out.select("query_id", "document_id", F.col("rank").cast("long").alias("rank"))


VARIANTS = r"""variants AS (SELECT item_id * 2 + v AS qv, array_to_string(list_filter(w, lambda x, i: v = 0 OR i % 3 = 1), ' ') AS vtext
  FROM (SELECT item_id, string_split(text, ' ') AS w, unnest([0, 1]) AS v FROM benchmark))"""


@query("multi_query_fusion", f"""WITH {VARIANTS}, {s.bm25('documents', 'doc_id', 'text', 'variants', 'qv', 'vtext')},
top AS ({s.ranked('scores', 'qv', 'doc_id', 20)}),
fused AS (SELECT qv // 2 AS item_id, doc_id, sum(1.0 / (60 + rank)) AS f, min((qv % 2) * 1000 + rank) AS seen FROM top GROUP BY 1, 2),
out AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(f, 12) DESC, seen, doc_id) AS rank FROM fused)
SELECT item_id, doc_id, rank, round(f, 9) AS rrf_score FROM out WHERE rank <= 10""")
def multi_query_fusion(t) -> DataFrame:
    """Each question and a rewording (every third word) fused in one ranking."""
    w = F.split("text", " ")
    both = F.array(F.array_join(w, " "), F.array_join(F.filter(w, lambda x, i: i % 3 == 0), " "))
    variants = t.benchmark.select("item_id", F.posexplode(both).alias("variant", "text")).select(
        (F.col("item_id") * 2 + F.col("variant")).alias("qv"), "text")
    top = lexical.bm25_top_k(t.documents, variants, ["doc_id"], "qv", 20)
    ranked = top.select(
        F.floor(F.col("qv") / 2).alias("query_id"), F.concat(F.lit("q"), (F.col("qv") % 2).cast("string"), F.lit("_sparse")).alias("channel"),
        F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "rank", "score")
    fused = fusion.reciprocal_rank_fusion(ranked, ["q0_sparse", "q1_sparse"])
    return fused.filter(F.col("rank") <= 10).select(
        F.col("query_id").alias("item_id"), F.col("document_id").alias("doc_id"),
        F.col("rank").cast("long").alias("rank"), F.round("rrf_score", 9).alias("rrf_score"))


TABLE_ROWS = """rows AS (SELECT l_suppkey AS query_id, l_orderkey AS document_id, l_linenumber AS chunk_index, l_extendedprice AS score,
  CASE WHEN l_linestatus = 'O' THEN '| ' || l_returnflag || ' | part |' || chr(10) || '| x | ' || l_partkey || ' |'
       ELSE 'part ' || l_partkey END AS content FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM rows)"""


@query("table_fold", f"""WITH {TABLE_ROWS},
pool AS (SELECT *, CASE WHEN content LIKE '|%' THEN string_split(content, chr(10))[1] END AS h FROM ranked WHERE rank <= 200),
marked AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, h ORDER BY rank) AS n FROM pool)
SELECT query_id, document_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
FROM marked WHERE h IS NULL OR n = 1""")
def table_fold(t) -> DataFrame:
    """Candidates per supplier with the rows of one order's table folded into the best one."""
    pool = ranked_rows(t).filter(F.col("rank") <= 200)
    return fusion.fold_table_rows(pool).select(
        "query_id", "document_id", "chunk_index", F.col("rank").cast("long").alias("rank"))


def ranked_rows(t) -> DataFrame:
    row = F.concat(F.lit("| "), F.col("l_returnflag"), F.lit(" | part |\n| x | "), F.col("l_partkey").cast("string"), F.lit(" |"))
    content = F.when(F.col("l_linestatus") == "O", row).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    rows = t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("document_id"),
                             F.col("l_linenumber").alias("chunk_index"), F.col("l_extendedprice").alias("score"), content.alias("content"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id", "chunk_index")
    return rows.withColumn("rank", F.row_number().over(w))


LINE_HITS = f"""{s.LINE_CHUNKS}, {s.bm25('chunks', 'document_id, chunk_index', 'content', 'benchmark', 'item_id', 'text')},
hits AS (SELECT h.item_id AS query_id, document_id, chunk_index, rank, round(score, 6) AS score, content
  FROM ({s.ranked('scores', 'item_id', 'document_id, chunk_index', 8)}) h JOIN chunks USING (document_id, chunk_index))"""


def line_hits(t, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits, chunks): the k best lines of every benchmark text, and all lines."""
    chunks = line_chunks(t.documents).withColumn("heading_path", F.lit(""))
    top = lexical.bm25_top_k(chunks.withColumnRenamed("content", "text"), t.benchmark, ["document_id", "chunk_index"], "item_id", k)
    # k rows per question, so the lines are not shuffled to meet them
    hits = chunks.join(broadcast_if_small(cut_lineage(top)), ["document_id", "chunk_index"]).select(
        F.col("item_id").alias("query_id"), "document_id", "chunk_index", "rank", F.round("score", 6).alias("score"), "content", "heading_path")
    # k rows per question, read several times by what follows
    return cut_lineage(hits), chunks


@query("neighbor_expand", f"""WITH RECURSIVE {LINE_HITS},
near AS (SELECT query_id, document_id, rank AS parent_rank, score, side, chunk_index + side AS chunk_index
  FROM hits, (SELECT unnest([-1, 1]) AS side) WHERE chunk_index + side >= 0),
found AS (SELECT n.query_id, n.document_id, n.chunk_index, min(parent_rank * 10 + side) AS place,
    arg_max(n.score, side) AS score, any_value(c.content) AS content
  FROM near n JOIN chunks c USING (document_id, chunk_index)
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = n.query_id AND h.document_id = n.document_id AND h.chunk_index = n.chunk_index)
  GROUP BY 1, 2, 3),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i FROM found),
base AS (SELECT query_id, sum(length(content)) AS used, max(rank) AS last FROM hits GROUP BY 1),
walk AS (SELECT query_id, 0::BIGINT AS i, used::BIGINT AS used, 0::BIGINT AS taken, FALSE AS kept FROM base
  UNION ALL
  SELECT w.query_id, w.i + 1, CASE WHEN w.used + length(o.content) <= 2500 THEN w.used + length(o.content) ELSE w.used END,
    w.taken + CASE WHEN w.used + length(o.content) <= 2500 THEN 1 ELSE 0 END, w.used + length(o.content) <= 2500
  FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.i = w.i + 1)
SELECT query_id, document_id, chunk_index, rank::BIGINT AS rank, score, FALSE AS neighbor_expand FROM hits
UNION ALL
SELECT o.query_id, o.document_id, o.chunk_index, b.last + w.taken, o.score, TRUE
FROM walk w JOIN ordered o USING (query_id, i) JOIN base b USING (query_id) WHERE w.kept""")
def neighbor_expand(t) -> DataFrame:
    """Hits of every question with the lines around them, within 2500 characters."""
    hits, chunks = line_hits(t)
    out = context.expand_neighbors(hits, chunks, 2500)
    return out.select("query_id", "document_id", "chunk_index", F.col("rank").cast("long").alias("rank"), "score", "neighbor_expand")


DEDUPED = f"""{LINE_HITS},
unique_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, md5(regexp_replace(trim(content), '\\s+', ' ', 'g'))
  ORDER BY score DESC, rank) AS n FROM hits) WHERE n = 1)"""

PACKED = f"""{DEDUPED},
sized AS (SELECT *, len(regexp_extract_all(content, '\\S+')) AS tokens FROM unique_hits),
fitting AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tokens DESC, rank) AS i FROM sized WHERE tokens + 10 <= 200),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS position, FALSE AS kept FROM fitting
  UNION ALL
  SELECT w.query_id, w.i + 1, CASE WHEN w.used + f.tokens + 10 <= 200 THEN w.used + f.tokens + 10 ELSE w.used END,
    w.position + CASE WHEN w.used + f.tokens + 10 <= 200 THEN 1 ELSE 0 END, w.used + f.tokens + 10 <= 200
  FROM walk w JOIN fitting f ON f.query_id = w.query_id AND f.i = w.i + 1),
packed AS (SELECT f.*, w.position, count(*) OVER (PARTITION BY w.query_id) AS total FROM walk w JOIN fitting f USING (query_id, i) WHERE w.kept),
slots AS (SELECT *, CASE WHEN total <= 2 THEN position WHEN position % 2 = 1 THEN (position + 1) // 2
  ELSE total - (position - 2) // 2 END AS source_index FROM packed)"""


@query("content_dedup", f"""WITH {DEDUPED} SELECT query_id, document_id, chunk_index, rank, score FROM unique_hits""")
def content_dedup(t) -> DataFrame:
    """Hits with repeated contents of a question removed."""
    out = context.dedupe_content(line_hits(t)[0])
    return out.select("query_id", "document_id", "chunk_index", F.col("rank").cast("long").alias("rank"), "score")


def packed(hits: DataFrame) -> DataFrame:
    return context.pack_context(context.dedupe_content(hits), budget=712)


@query("pack_context", f"""WITH RECURSIVE {PACKED}
SELECT query_id, document_id, chunk_index, position, tokens FROM slots""")
def pack_context(t) -> DataFrame:
    """Selected lines per question under a token budget of 712 with 512 kept free."""
    return packed(line_hits(t)[0]).select("query_id", "document_id", "chunk_index", F.col("position").cast("long").alias("position"), "tokens")


@query("lost_in_middle", f"""WITH RECURSIVE {PACKED}
SELECT query_id, document_id, chunk_index, position, source_index FROM slots""")
def lost_in_middle(t) -> DataFrame:
    """Best lines at both ends of the context."""
    return context.lost_in_the_middle(packed(line_hits(t)[0])).select(
        "query_id", "document_id", "chunk_index", F.col("position").cast("long").alias("position"),
        F.col("source_index").cast("long").alias("source_index"))


@query("context_text", f"""WITH RECURSIVE {PACKED}
SELECT query_id, string_agg('[' || source_index || '] src' || document_id || chr(10) || content, chr(10) || chr(10) ORDER BY source_index) AS context
FROM slots GROUP BY query_id""")
def context_text(t) -> DataFrame:
    """Numbered context of every question."""
    slots = context.lost_in_the_middle(packed(line_hits(t)[0]))
    header = context.context_header(F.lit("kb"), F.col("source_index"),
                                    F.concat(F.lit("src"), F.col("document_id").cast("string")), F.lit(None).cast("string"))
    return context.context_text(slots, header)


@query("chunk_surroundings", f"""WITH {s.LINE_CHUNKS}
SELECT c.document_id, c.chunk_index, string_agg(n.content, chr(10) || chr(10) ORDER BY n.chunk_index) AS context,
  coalesce(sum(CASE WHEN n.chunk_index < c.chunk_index THEN length(n.content) + 2 END), 0)::INTEGER AS start_offset
FROM chunks c JOIN chunks n ON n.document_id = c.document_id AND n.chunk_index BETWEEN c.chunk_index - 2 AND c.chunk_index + 2
GROUP BY 1, 2""")
def chunk_surroundings(t) -> DataFrame:
    """Every line with two lines on each side and its offset in that text."""
    return context.chunk_surroundings(line_chunks(t.documents))


GATE = """scored AS (SELECT query_id, document_id, rank, score / 20 AS rerank_score FROM hits)"""


def gate_hits(t) -> DataFrame:
    """Hits with a score in the range of the gate: a twentieth of the BM25 score."""
    return line_hits(t)[0].withColumn("rerank_score", F.col("score") / 20)


@query("relevance_gate", f"""WITH {LINE_HITS}, {GATE}
SELECT query_id, count(*) AS chunks, round(max(rerank_score), 6) AS max_score, round(avg(rerank_score), 6) AS avg_score,
  max(rerank_score) >= 1.2 OR avg(rerank_score) >= 1.2 AS passed FROM scored GROUP BY query_id""")
def relevance_gate(t) -> DataFrame:
    """Questions whose hits are good enough to answer from."""
    out = context.relevance_gate(gate_hits(t), 1.2)
    return out.withColumns({"max_score": F.round("max_score", 6), "avg_score": F.round("avg_score", 6)})


@query("gate_suppressions", f"""WITH {LINE_HITS}, {GATE}
SELECT query_id, 1.2::DOUBLE AS threshold, count(*) AS chunks, round(max(rerank_score), 4) AS max_score, round(avg(rerank_score), 4) AS avg_score,
  round(1.2 - max(rerank_score), 4) AS gap_to_threshold, arg_min(substr(content, 1, 80), rank) AS top1_preview
FROM scored JOIN hits USING (query_id, document_id, rank) GROUP BY query_id
HAVING max(rerank_score) < 1.2 AND avg(rerank_score) < 1.2""")
def gate_suppressions(t) -> DataFrame:
    """What the gate refused and by how much."""
    return context.gate_suppressions(gate_hits(t), 1.2)


@query("filtered_chunks", """
SELECT source, count(*) AS chunks FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'wiki_syn' WHEN 2 THEN 'raw' ELSE 'memory' END AS kind FROM documents)
WHERE source IN ('src1', 'src2', 'src3', 'src5', 'src8') AND kind NOT IN ('wiki', 'wiki_syn') GROUP BY source""")
def filtered_chunks(t) -> DataFrame:
    """Documents of five bases outside the compiled kinds; base ids are UUIDs made of the source name."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("wiki", "wiki_syn", "raw", "memory")]), (F.col("doc_id") % 4 + 1).cast("int"))
    wanted = [uuid_of_name(f"src{i}") for i in (1, 2, 3, 5, 8)]
    chunks = t.documents.select("source", kb_uuid(F.col("source")).alias("kb_id"), kind.alias("source_kind"))
    cond = context.retrieval_filter(kb_ids=wanted, exclude_kinds=context.excluded_kinds())
    return chunks.filter(cond).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def kb_uuid(name):
    h = F.md5(name)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def uuid_of_name(name: str) -> str:
    import hashlib

    h = hashlib.md5(name.encode()).hexdigest()
    return "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])


@query("session_memory", r"""
WITH m AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations),
ask AS (SELECT conv_id, max(turn) AS turn FROM m WHERE role = 'user' GROUP BY conv_id),
q AS (SELECT DISTINCT m.conv_id, m.turn AS asked, unnest(m.w) AS term FROM m JOIN ask USING (conv_id, turn)),
mem AS (SELECT DISTINCT conv_id, turn, unnest(w) AS term FROM m),
sized AS (SELECT conv_id, turn, count(*) AS terms FROM mem GROUP BY 1, 2),
sc AS (SELECT mem.conv_id, mem.turn, round(count(*) / sqrt(any_value(terms)), 6) AS score
  FROM mem JOIN q ON q.conv_id = mem.conv_id AND q.term = mem.term AND mem.turn < q.asked
  JOIN sized ON sized.conv_id = mem.conv_id AND sized.turn = mem.turn GROUP BY 1, 2)
SELECT * FROM (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM sc) WHERE rank <= 3""")
def session_memory(t) -> DataFrame:
    """Three earlier messages of a conversation closest to its last question.

    The search is an equi-join on (conversation, word), so no other conversation is read
    for a question and a long conversation is spread over its words.
    """
    m = t.conversations.select("conv_id", "turn", "role", F.array_distinct(tokens(F.col("text"))).alias("w"))
    last = m.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("w", "turn").alias("w"), F.max("turn").alias("asked"))
    asked = last.select("conv_id", "asked", rows_of(F.col("w")).alias("term"))
    memory = m.select("conv_id", "turn", F.size("w").alias("terms"), rows_of(F.col("w")).alias("term"))
    scored = memory.join(asked, ["conv_id", "term"]).filter(F.col("turn") < F.col("asked")).groupBy("conv_id", "turn").agg(
        F.round(F.count(F.lit(1)) / F.sqrt(F.first("terms")), 6).alias("score"))
    w = W.partitionBy("conv_id").orderBy(F.col("score").desc(), "turn")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= 3)


@query("retrieve_context")
def retrieve_context(t) -> DataFrame:
    """The whole chain for every benchmark text over chunks of every document."""
    embed = hashing_embedder()
    chunks = cut_lineage(chunk_documents(t.documents, "doc_id").select(
        F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "content", "heading_path",
        F.lit("raw").alias("source_kind"), embed(F.col("content")).alias("embedding")))
    questions = t.benchmark.select(F.col("item_id").alias("query_id"), "text", embed(F.col("text")).alias("embedding"))
    out = retrieve(questions, chunks, RetrievalConfig(expand=True, fold=True))
    return out.select("query_id", "source_index", "document_id", "chunk_index", F.round("score", 6).alias("score"), "tokens")
