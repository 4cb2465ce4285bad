"""Matching in turn from short lists equals choosing one after the other among all pages."""

import random

import pytest

from docweave.operators import dense
from docweave.operators.matching import nearest_in_turn
from docweave.plans import QUERIES


@pytest.mark.parametrize("entries, listed", [(9, 1), (200, 2), (2_000_000, 64)])
def test_lists_of_any_length_give_the_greedy_choice(spark, entries, listed):
    rnd = random.Random(entries)
    grid = [(float(x), float(y)) for x in range(-1, 4) for y in range(-1, 4) if (x, y) != (0, 0)]
    vectors = {i: v for i, v in enumerate(grid, 100)}
    wanted = [(kb, c, c, rnd.choice(list(vectors))) for kb in (1, 2, 3) for c in rnd.sample(range(1000), 18)] + [(None, 7, 7, 100)]
    queues = [(kb, rnd.choice(list(vectors)), p) for kb in (1, 2) for p in rnd.sample(range(1000), 15)] + [(None, 100, 5)]
    size = lambda v: (v[0] ** 2 + v[1] ** 2) ** 0.5
    want, taken = set(), set()
    for kb, pos, c, k in sorted(w for w in wanted if w[0]):
        x = vectors[k]
        near = sorted((-round((x[0] * y[0] + x[1] * y[1]) / size(x) / size(y), 6), p) for b, cls, p in queues for y in [vectors[cls]] if b == kb and (kb, p) not in taken)
        if near and -near[0][0] >= 0.2:
            want.add((kb, c, near[0][1]))
            taken.add((kb, near[0][1]))
    got = nearest_in_turn(spark.createDataFrame(wanted, "kb_id int, pos long, cand_id long, cand_class long"), spark.createDataFrame(queues, "kb_id int, class_id long, page_id long"),
                          spark.createDataFrame([(i, list(v)) for i, v in vectors.items()], "id long, v array<double>"), 0.2, entries, listed)
    assert {tuple(r) for r in got.collect()} == want


def test_match_titles_makes_no_row_per_pair(spark, tmp_path, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("every pair at or above the threshold")

    monkeypatch.setattr(dense, "similar_pairs", pairs)
    spark.createDataFrame([(i, 0, [1.0, i / 100]) for i in range(1, 41)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["match_titles"](spark, str(tmp_path)).collect()
    assert len(got) == 20 and len({r.page_id for r in got}) == 20
