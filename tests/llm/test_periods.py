"""Periodic runs against every lag and every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docweave.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        j = q
        while j < n:
            k = j
            while k < n and words[k] == words[k - q]:
                k += 1
            size = k - j + q
            if k > j and size >= max(6, 4 * q):
                stretch = words[j - q:k]
                if not any(all(stretch[x] == stretch[x - p] for x in range(p, size)) for p in range(1, q)):
                    out.append((j - q, size, q))
            j = max(k, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, text, plant):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
    if plant and n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n, len(gone))


def generated(rng):
    words = []
    for _ in range(rng.randrange(6)):
        if rng.random() < 0.4:
            words += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(30))]
        else:
            q = rng.randrange(1, rng.choice([3, 6, 20, 70]))
            base = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(q)]
            words += [base[i % q] for i in range(rng.randrange(2 * q, 7 * q + 1))]
    return words


@pytest.mark.parametrize("wide", [False, True])
def test_runs_are_those_of_all_lags(wide):
    rng = random.Random(3)
    for _ in range(150):
        docs = [generated(rng) for _ in range(8)]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        codes = np.array(sum(docs, []), np.int64) + (2 ** 21 if wide else 0)
        found = [[] for _ in docs]
        for t, *r in zip(*(x.tolist() for x in periods.find_runs(codes, bounds))):
            found[t].append(tuple(r))
        assert found == [brute(d) for d in docs]


@pytest.mark.parametrize("plant, most", [(True, 4_000_000), (False, 900)])
def test_rows_are_those_of_the_contract(spark, monkeypatch, plant, most):
    monkeypatch.setattr(periods, "SLICE_BYTES", most)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in generated(rng))) for i in range(150)]
    rows += [(150 + i, "\n".join(" \t".join(rng.choice(["ab", "é", "日本", "#", "x" * 50]) for _ in range(rng.randrange(40))) for _ in range(3))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "a " * 5), (1005, "a " * 6), (1006, "a b " * 4), (1007, "a b " * 3 + "a"), (1008, "\x1c \x85 a" * 9), (1009, "a " * 30_000)]
    rows += [(None, "z " * 40), (3, "other text of the id " * 5), rows[5], rows[5], (-12, "x y z " * 9), (2 ** 62, "x y z w " * 9)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, start string, length int").repartition(3)
    got = periods.periodic_runs(docs, plant=plant).collect()
    small = [r for r in got if r.doc_id != 1009]
    assert sorted((tuple(r) for r in small), key=str) == sorted((expected(*r, plant) for r in rows if r[0] != 1009), key=str)
    long = [r for r in got if r.doc_id == 1009]
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.n_dropped) for r in long] == [(1, 0, 30_000, 1, 30_000_000, 29_999)]
    assert periods.periodic_runs(docs.filter("false")).count() == 0


def test_kept_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "say it  again\nagain again again again again now"), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(docs, keep=True).collect()}
    assert [tuple(x) for x in got[1].runs] == [(2, 6, 1)] and got[1].collapsed == "say it again now" and got[2].runs == [] and got[2].collapsed == "a b"


def test_time_does_not_grow_with_the_square_of_a_word(spark):
    """A million times the same word, or seven words, in one text; every pair of equal words would be 5 x 10^11."""
    for period in (1, 7):
        codes = np.arange(1_000_000) % period
        assert [x.tolist() for x in periods.find_runs(codes, np.array([0, len(codes)]))] == [[0], [0], [1_000_000], [period]]


def test_query_reads_the_whole_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_words for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()} == {1: 2, 2: 0}
