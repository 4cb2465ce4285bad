"""Equal vectors keep every pair and every page."""

from docweave.plans import QUERIES

ROWS = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.9, 0.1]), (4, 1, [0.0, 1.0]), (6, 1, [0.0, 0.0]), (7, 0, [1.0, 0.0]), (8, 1, [1.0, 0.0]), (9, 1, [0.9, 0.1]), (10, 0, [0.9, 0.1])]


def embeddings(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def cosine(a, b):
    size = lambda v: sum(x * x for x in v) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (size(a) * size(b)) if size(a) * size(b) else 0.0


def test_semantic_duplicates_lists_every_copy(spark, tmp_path):
    got = {(r.vec_id, r.similar_id): (r.score, r["rank"]) for r in QUERIES["semantic_duplicates"](spark, embeddings(spark, tmp_path, ROWS)).collect()}
    want = {}
    for a, _, x in ROWS:
        near = sorted((-round(cosine(x, y), 6), b) for b, _, y in ROWS if b != a and round(cosine(x, y), 6) >= 0.35)
        want |= {(a, b): (-s, n) for n, (s, b) in enumerate(near, 1)}
    assert got == want and {(3, 2), (2, 7), (7, 2)} <= set(got)


def test_match_titles_offers_every_copy(spark, tmp_path):
    rows = [*ROWS, (101, 5, [0.3, 0.4]), (102, 6, [0.3, 0.4]), (104, 5, [0.3, 0.4]), (105, 5, [0.3, 0.4]), (106, 5, [0.3, 0.4]), (107, 5, [0.3, 0.5])]
    got = {(r.kb_id, r.cand_id): r.page_id for r in QUERIES["match_titles"](spark, embeddings(spark, tmp_path, rows)).collect()}
    want, taken = {}, set()
    for a, kb, x in sorted(r for r in rows if r[0] % 2):
        near = sorted((-round(cosine(x, y), 9), b) for b, k, y in rows if b % 2 == 0 and k == kb and cosine(x, y) >= 0.2 and b not in taken)
        if near:
            want[(kb, a)] = near[0][1]
            taken.add(near[0][1])
    assert got == want and got[(5, 101)] == 104 and got[(5, 105)] == 106
