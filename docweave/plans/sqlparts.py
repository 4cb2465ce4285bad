"""SQL fragments shared by the checked twins of the queries."""

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"

LINES = ("list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')")

LINE_CHUNKS = f"""line_lists AS (SELECT doc_id, {LINES} AS l FROM documents),
chunks AS (SELECT doc_id AS document_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS chunk_index FROM line_lists)"""


def words(col: str) -> str:
    return WORDS.format(col)


def bm25(docs: str, keys: str, text: str, queries: str, qkey: str, qtext: str, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}scores(qkey, keys, score)``."""
    p = prefix
    return f"""{p}body AS (SELECT {keys}, {words(text)} AS w FROM {docs}),
{p}totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {p}body),
{p}tok AS (SELECT {keys}, len(w) AS length, unnest(w) AS term FROM {p}body),
{p}tf AS (SELECT {keys}, term, count(*) AS tf, any_value(length) AS length FROM {p}tok GROUP BY {keys}, term),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf, mean FROM {p}df, {p}totals),
{p}weights AS (SELECT {keys}, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) AS weight
  FROM {p}tf JOIN {p}idf USING (term) WHERE idf > 0),
{p}asked AS (SELECT DISTINCT {qkey}, unnest({words(qtext)}) AS term FROM {queries}),
{p}scores AS (SELECT {qkey}, {keys}, sum(weight) AS score FROM {p}weights JOIN {p}asked USING (term) GROUP BY {qkey}, {keys})"""


def ranked(scores: str, qkey: str, keys: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {qkey} ORDER BY round(score, 6) DESC, {keys}) AS rank
  FROM {scores}) WHERE rank <= {k}"""


# inner products of all embeddings with each other, one channel on all numbers and one on the first half
VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"""

CHANNELS = f"""{VECTORS},
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS document_id, list_inner_product(a.e, b.e) AS dense,
    list_inner_product(a.e[1:32], b.e[1:32]) AS sparse FROM v a JOIN v b ON a.vec_id <> b.vec_id),
dense AS (SELECT query_id, document_id, dense AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 6) DESC, document_id) AS rank FROM pairs),
sparse AS (SELECT query_id, document_id, sparse AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(sparse, 6) DESC, document_id) AS rank FROM pairs),
channels AS (SELECT 1 AS c, * FROM dense WHERE rank <= 20 UNION ALL SELECT 2 AS c, * FROM sparse WHERE rank <= 20)"""
