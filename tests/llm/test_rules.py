"""Quality, toxicity, chat formatting and the pipeline on small tables."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docweave.llm import chat, quality, toxicity
from docweave.llm.links import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


@pytest.fixture(scope="module")
def written(spark):
    rng = random.Random(8)
    rows = []
    for n in range(900):
        lang, source = ("en", "de")[n % 2], f"s{n % 3}"
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7 + 4 * (n % 2)))) for _ in range(rng.randrange(100, 300))]
        if n % 20 == 0:
            words = [w + "***" for w in words]
        if n % 20 == 1:
            words = [w.upper() * 3 + "!!" for w in words]
        rows.append((n, " ".join(words) + "\n" + " ".join(words[:12]), lang, source))
    one = " ".join(f"w{k}" for k in range(8))
    rows += [(1000, None, "en", None), (1001, "", None, "s0"), (1002, "a " * 500, "en", "s0"), (1003, one + " x " + one + " " + one, "en", "s0"), (1004, "l1\nl1\n \n\nl1\n" + one, None, None),
             (1005, "é日🙂 #|<>&%$* x", "xx", "rare"), (1005, "é日🙂 #|<>&%$* x", "xx", "rare"), (None, "y z", "en", "s0")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_words string, _key int")


def test_statistics_and_outliers(written):
    got = quality.quality_rules(written).collect()
    texts = sorted(((r.doc_id, *statistics(r.text)) for r in written.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    wrong = [(r.doc_id, round(r.distance, 1)) for r in got if r.doc_id is not None and r.doc_id < 900 and r.kept != (r.doc_id % 20 > 1)]
    assert not wrong
    kept = quality.drop_low_quality(written)
    assert kept.columns == written.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)
    assert quality.quality_rules(written.filter("false")).count() == 0 and quality.drop_low_quality(written.filter("false")).count() == 0


def least_determinant(x, share, rng, tries=300):
    """An independent estimate: concentration from many random triples of points, exact subsets, the least determinant of all."""
    best, h = (np.inf, None), math.ceil(share * len(x))
    for _ in range(tries):
        keep = rng.choice(len(x), x.shape[1] + 2, replace=False)
        for _ in range(12):
            mean, cov = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            keep = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))[:h]
        cov = np.cov(x[keep].T, bias=True)
        best = min(best, (np.linalg.det(cov), tuple(x[keep].mean(axis=0))))
    return best


@pytest.mark.parametrize("share", [0.1, 0.16, 0.2])
def test_a_tight_cluster_of_outliers_moves_nothing(spark, share):
    """A cluster nine deviations away, which an estimate from all rows takes for part of the data, beside a clean group and one of three rows."""
    rng = np.random.default_rng(2)
    cov = np.array([[1, 0.6, 0, 0], [0.6, 2, 0, 0], [0, 0, 1, 0.2], [0, 0, 0.2, 1]])
    x = rng.multivariate_normal([1, -2, 0, 3], cov, 800)
    bad = int(share * len(x))
    x[:bad] = np.array([10, 7, 9, 12]) + 0.1 * rng.normal(size=(bad, 4))
    rows = [("g", i, *map(float, r)) for i, r in enumerate(x)] + [("clean", 10_000 + i, *map(float, r)) for i, r in enumerate(rng.normal(size=(300, 4)))] + [("few", 90_000 + i, 1.0, 2.0, 3.0, 4.0) for i in range(3)]
    features = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double, c double, d double")
    got = {r.g: r for r in quality.minimum_covariance(df, "g", "k", features, [1e-3] * 4).collect()}
    det, mean = least_determinant(x, 0.75, rng)
    mine = np.array([got["g"][f"m_{i}"] for i in range(4)])
    assert np.allclose(mine, mean, atol=0.15) and np.allclose(mine, [1, -2, 0, 3], atol=0.35)
    assert np.prod([got["g"][f"l_{i}_{i}"] for i in range(4)]) ** 2 < 1.3 * det
    assert (got["g"].n, got["clean"].n, got["few"].n) == (800, 300, 3) and got["few"].m_2 == 3.0 and got["few"].l_0_0 == 1e-3
    far = df.join(spark.createDataFrame(list(got.values())), "g").withColumn("far", quality.distance(features)).collect()
    assert min(r.far for r in far if r.k < bad) > 50 > sorted(r.far for r in far if bad <= r.k < 800)[-5]


def test_small_groups_lean_on_their_language(spark):
    """Groups of one, twelve and 2000 rows; what judges a row moves with the size of its group, without a jump."""
    rng = random.Random(4)
    word = lambda long: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9 + long)))
    rows = [(n, " ".join(word(0) for _ in range(rng.randrange(60, 200))), "en", "large" if n < 1500 else "dozen" if n < 1512 else f"single{n}") for n in range(1514)]
    rows += [(5000, " ".join(word(0) + "#*|" for _ in range(120)), "en", "dozen"), (5001, " ".join(word(0) + "#*|" for _ in range(120)), "en", "never seen before"), (5002, " ".join(word(0) + "#*|" for _ in range(120)), "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(r.kept for i, r in got.items() if i < 5000) and not got[5000].kept and not got[5001].kept, [(i, r.distance) for i, r in got.items() if r.kept != (i < 5000)]
    assert got[3].own_share > 0.9 and 0.05 < got[1501].own_share < 0.15 and 0 < got[1513].own_share < 0.02


def marked(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    bad, rows = ["nasty", "vile", "awful", "zqlotter", "zqlum"], []
    for i in range(n):
        words, toxic = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))], i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = marked(1, 1500)
    more = [(9000, None), (9001, ""), (None, "nasty vile"), (9002, "vile " * 3000), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows] + [(i, t, "clash", 1) for i, t in more], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0} and {r.predicted for r in got if r.doc_id in (None, 9002)} == {1}
    assert all(not any(e.doc_id == r.doc_id for e in r.evidence) for r in held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.toxicity_scores(docs.filter("false"), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels.filter("false")).collect()} == {0}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    v = rng.random((700, 12)) * (rng.random((700, 12)) < 0.3)
    v = v[v.any(axis=1)]
    v = np.vstack([v, v[:40]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v[np.argsort(v.argmax(axis=1), kind="stable")]
    ids = rng.permutation(len(v))
    most = np.array([v[i:i + toxicity.BLOCK].max(axis=0) for i in range(0, len(v), toxicity.BLOCK)])
    index = toxicity.Index({}, np.ones(12), ids, np.zeros(len(v), int), v, most, 0.0)
    cos, place = toxicity.nearest(index, v[:100], 7)
    for q, c, p in zip(v[:100], cos, place):
        every = v @ q
        best = np.lexsort((ids, -np.round(every, 12)))[:7]
        assert ids[p[p >= 0]].tolist() == ids[best[every[best] > 0]].tolist()


def folded(events):
    out = {}
    for e in sorted(events, key=lambda e: (e[3] is not None, e[3] or 0, e[4] or "delta", e[6] or "")):
        m = out.setdefault(e[:3], {"text": "", "role": None, "gone": False})
        if e[4] in ("edit", "regenerate", "delete"):
            m["text"], m["role"], m["gone"] = "", m["role"], e[4] == "delete"
        m["text"] += e[6] or ""
        m["gone"] = m["gone"] and e[4] == "delete"
        m["role"] = m["role"] if m["role"] is not None else e[5]
    return out


def test_events_fold_and_render_reversibly(spark):
    events = [(1, 0, 1, 0, "delta", "user", "Hi "), (1, 0, 1, 1, "delta", "user", "<turn user> & </turn>\n"), (1, 1, 1, 2, "delta", "assistant", "draft"), (1, 1, 1, 3, "regenerate", None, None),
              (1, 1, 1, 4, "delta", "assistant", "fi"), (1, 1, 1, 5, "delta", "assistant", "nal &lt; <"), (1, 2, 1, 6, "delta", "user", "typo"), (1, 2, 1, 7, "edit", "user", "fixed"),
              (1, 3, 1, 8, "delta", "assistant", "gone"), (1, 3, 1, 9, "delete", None, None), (2, None, 1, 0, None, "assis>tant", "odd"), (2, 500, 1, 0, "delta", "assistant", "日本🙂"), (2, 70, 1, 0, "delta", None, None),
              (2, 70, 1, 0, "delta", None, None), (None, 1, 1, 0, "delta", "assistant", ""), (3, 1, 1, None, "delta", "assistant", "first"), (3, 1, 1, 2, "delta", "assistant", "</s>[INST]")]
    table = spark.createDataFrame([(*e, "clash") for e in events], "conv_id long, turn long, message int, seq long, kind string, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    want = {}
    for (conv, turn, message), m in folded(events).items():
        if not m["gone"]:
            want.setdefault(conv, []).append((turn if turn is not None else -1, message, m["role"] or "", m["text"]))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        r = got[conv]
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(r.formatted))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted.count("<turn ") == len(turns) == r.formatted.count("</turn>\n")
    assert chat.format_conversations(table.filter("false")).count() == 0


def test_hostile_rows_keep_their_turns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, None, None), (1, 200, "assistant", "a</turn>\n<turn user>b"), (2, 1, "assistant", None)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.format_conversations(chat.log_of(table)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_sha256 == hashlib.sha256(b"a</turn>\n<turn user>b").hexdigest() and got[2].loss_chars == 0


def test_pipeline_runs_stage_by_stage(spark, tmp_path):
    words = random.Random(3)
    vocabulary = ["".join(words.choice("abcdefghijkl") for _ in range(words.randrange(3, 8))) for _ in range(3000)]
    rows = [(i, " ".join(words.choice(vocabulary) for _ in range(80)), "en", f"s{i % 2}", 1) for i in range(400)]
    shared = " ".join(words.choice(vocabulary) for _ in range(60))
    rows = [(i, t + ("\nnasty vile" if i % 7 == 0 else "") + ("\n" + shared if i % 50 == 3 else ""), *r) for i, t, *r in rows]
    rows += [(500, "b " * 90, "en", "s0", 1), (501, None, None, None, None), (502, rows[1][1] + " more", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, str(tmp_path)).collect(), docs.schema)
        assert held.columns == docs.columns, name
    left = {r.doc_id: r.text for r in held.collect()}
    assert not set(left) - {i for i in range(400) if i % 7} and len(left) > 330, sorted({i for i in range(400) if i % 7} - set(left))
    assert sum(shared in t for t in left.values()) == 1 and shared in left[3]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(left)


def test_small_tables_are_cut_into_few_files(spark):
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = spark.createDataFrame([(n, g, float(n % 7), float(n * n % 11)) for g in ("a", "b") for n in range(60)] + [(None, None, 1.0, 2.0)], "k long, g string, u double, v double")
    edges = spark.createDataFrame([(n, n + 1) for n in range(6)] + [(20, 21), (20, 21)], "a long, b long")

    def files():
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
        return sum(1 for p in Path(folder).rglob("part-*"))

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        at = files()
        roots = {(r["node"], r["root"]) for r in components(edges).collect()}
        links, at = files() - at, files()
        found = quality.minimum_covariance(rows, "g", "k", ["u", "v"], [0.1, 0.1], steps=1)
        groups = files() - at
        n = {r["g"]: r["n"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {(n, 0) for n in range(7)} | {(20, 20), (21, 20)} and n == {"a": 60, "b": 60}
    # four tasks for 48 shuffle partitions; eight cuts of links at most, four of groups
    assert 0 < links <= 8 * 4 and 0 < groups <= 4 * 4
