"""The filter audit against plain counting, whole and in steps."""

import random
import re
from itertools import permutations

import pytest

from docweave.llm import audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, code string, n int"


def brute(rows, labels):
    least, marks = {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, good, toxic in labels:
        a, b = marks.get(i, (False, False))
        marks[i] = (a or good == 1, b or toxic == 1)
    held = {}
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        good, toxic = marks.get(i, (False, False)) if i is not None else (False, False)
        held.setdefault(part or "", []).append(({f for f in fails if fails[f]}, good, toxic))
    out = {}
    for part, docs in held.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                before = set(order[:step])
                removed = [d for d in docs if f in d[0] and not d[0] & before]
                shapley[f] += len(removed)
                out[part, order, step + 1] = [sum(not d[0] & (before | {f}) for d in docs), len(removed), sum(f in d[0] and bool(d[0] & before) for d in docs),
                                              sum(d[0] == {f} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def report(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def corpus():
    rng = random.Random(6)
    words = [f"w{n}" for n in range(600)]
    some = [" ".join(rng.choice(words[:rng.choice([20, 600])]) for _ in range(rng.randrange(150, 260))) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2]) for _ in range(60)]
    rows = [(rng.randrange(10_000), rng.choice(some[:rng.choice([1, 60])]), rng.choice(["a", "b", None])) for _ in range(700)]
    rows += [(i, None if i % 2 else "", "a") for i in (9, 4, 20_000)] + [(None, some[0], "b"), (None, None, None), (rows[0][0], rows[0][1], "c"), rows[0], rows[0], (-5, some[0], "late")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows[:400]] + [(None, 1, 1)]
    return rows, labels


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def marks(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_report_is_that_of_plain_counting(spark, tmp_path, monkeypatch):
    rows, labels = corpus()
    table(spark, rows).repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    marks(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op12_filter_audit(spark, str(tmp_path))
    assert got.columns == audit.REPORT and report(got) == brute(rows, labels)
    monkeypatch.setattr(audit, "TEXTS_PER_CELL", 1)
    again = audit.failure_counters(spark, f"{tmp_path}/documents.parquet", marks(spark, labels), f"{tmp_path}/one", batches=9)
    assert report(audit.interaction_report(again)) == brute(rows, labels)
    assert spark.read.parquet(f"{tmp_path}/one/counters/batch=*").filter("n < 0").count() > 0  # masks were taken back


def test_new_files_change_what_was_counted(spark, tmp_path):
    """Ids fall from file to file, so the second run must take back what the first has counted, in the same folder."""
    rows, labels = corpus()
    rows = sorted(rows, key=lambda r: -1 if r[0] is None else -r[0])
    docs, folder = f"{tmp_path}/documents.parquet", f"{tmp_path}/audit"
    table(spark, rows[:300]).coalesce(2).write.parquet(docs)
    first = audit.filter_audit(spark, docs, marks(spark, labels), folder)
    assert report(first) == brute(rows[:300], labels)
    table(spark, rows[300:]).coalesce(3).write.mode("append").parquet(docs)
    assert report(audit.filter_audit(spark, docs, marks(spark, labels), folder)) == brute(rows, labels)
    assert report(audit.filter_audit(spark, docs, marks(spark, labels), folder)) == brute(rows, labels)  # nothing new


def test_one_file_and_an_empty_table(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"doc_id": [2, 1], "text": ["x #", "x #"], "source": ["s", None]})
    frame.to_parquet(f"{tmp_path}/documents.parquet")
    assert report(audit.filter_audit(spark, f"{tmp_path}/documents.parquet", marks(spark, []), f"{tmp_path}/a")) == brute([(2, "x #", "s"), (1, "x #", None)], [])
    table(spark, []).write.parquet(f"{tmp_path}/none.parquet")
    assert audit.filter_audit(spark, f"{tmp_path}/none.parquet", marks(spark, []), f"{tmp_path}/b").count() == 0


def test_a_repeated_micro_batch_counts_once(spark, tmp_path):
    counters = spark.createDataFrame([("p", 3, 2), ("p", 16 + 32, 1)], audit.COUNTED)
    for _ in range(2):
        counters.write.mode("overwrite").parquet(f"{tmp_path}/counters/batch=0")
    got = report(audit.interaction_report(spark.read.schema(audit.COUNTED).parquet(f"{tmp_path}/counters/batch=*")))
    assert len(got) == 600 and got["p", "ABCDE", 1] == (1, 2, 0, 0, 0, 0, 2 * 60) and got["p", "ABCDE", 5] == (0, 1, 0, 1, 1, 0, 120)


@pytest.mark.parametrize("text, bits", [("", 1), ("a " * 200, 2), ("A" * 3 + "b" * 96, 5), ("#", 9), ("a" * 98 + "AA", 1)])
def test_failures(spark, text, bits):
    assert spark.range(1).select(audit.failures(audit.F.lit(text)).alias("x")).first().x == bits
