"""Repeated lines against all pairs of lines."""

import random

import numpy as np
import pytest

from docweave.llm import lines

SCHEMA = "doc_id long, text string, line string, n int"
TRIM = "\t\n\x0b\x0c\r "


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, times):
    out = list(text)
    for _ in range(times):
        at, what = rng.randrange(max(1, len(out))), rng.randrange(3)
        if what == 0 or not out:
            out.insert(at, rng.choice("abé日"))
        elif what == 1:
            out.pop(at)
        else:
            out[at] = rng.choice("abé日")
    return "".join(out)


def corpus(seed):
    rng = random.Random(seed)
    some = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(4, 14))) for _ in range(40)]
    rows = []
    for n in range(60):
        own = [changed(rng, rng.choice(some), rng.randrange(4)) for _ in range(rng.randrange(5))]
        rows.append((n, "\n".join([*own, f"a line that only number {n} has, of {rng.random()}"])))
    hot = "a very common line that many many documents share with small edits here and there"
    rows += [(100 + n, changed(rng, hot, n % 3) + "\n" + hot * (n % 2)) for n in range(40)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "too short"), (204, "too short"), (205, hot + " \n\t" + hot), (206, "word " * 4000), (207, "word " * 4000 + "w")]
    return rows


def brute(rows, rule):
    first, order = {}, []
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = x.strip(TRIM)
            if len(x.split()) >= rule.words:
                first.setdefault(x, []).append((i, n))
    names = list(first)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(names):
        for b in range(a):
            y = names[b]
            if min(len(x), len(y)) >= rule.chars and abs(len(x) - len(y)) <= rule.edits and find(a) != find(b):
                far = len(x) - len(y) if x.startswith(y) else distance(x, y)
                if far <= rule.edits:
                    root[find(a)] = find(b)
    members = {}
    for a, x in enumerate(names):
        members.setdefault(find(a), []).extend((at, x) for at in first[x])
    return {(at, min(of)[0], x == min(of)[1]) for of in members.values() for at, x in of if at != min(of)[0]}


@pytest.mark.parametrize("edits, block, points", [(2, 2048, 4_000_000), (1, 8, 700), (3, 16, 4_000_000)])
def test_repeats_are_those_of_all_pairs(spark, monkeypatch, edits, block, points):
    monkeypatch.setattr(lines, "GROUP_BLOCK", block)
    monkeypatch.setattr(lines, "POINTS", points)
    rows, rule = corpus(edits), lines.Rule(edits=edits)
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = {((r.doc_id, r.line), (r.first_doc, r.first_line), r.exact) for r in lines.repeated_lines(table, rule).collect()}
    assert got == brute(rows, rule)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    left = ["".join(rng.choice("ab日 ") for _ in range(rng.randrange(0, 40))) for _ in range(500)] + ["", "", "abc"]
    right = [changed(rng, x, rng.randrange(5)) if x else "a" for x in left[:500]] + ["", "ab", ""]
    codes, n = [lines.points_of(x) for x in left + right], len(left)
    assert (lines.within(codes, np.arange(n), np.arange(n, 2 * n), edits) == np.array([distance(a, b) <= edits for a, b in zip(left, right)])).all()


def test_lines_go_and_rows_stay(spark):
    one, two = "the first line is said only once", "this line is said again and again by all of them"
    rows = [(2, f"{one}\n{two}"), (1, f"{two}\nshort\nshort"), (3, two), (3, two), (None, f"{two}\n"), (4, None), (5, "")]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    out = lines.drop_repeated_lines(table)
    assert out.columns == table.columns
    # the line stays where the id is null, which comes first; rows of the id 3 are one document
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(
        [(2, one), (1, "short\nshort"), (3, ""), (3, ""), (None, f"{two}\n"), (4, None), (5, "")], key=str)
    report = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.line_report(table.filter("doc_id in (1, 2, 4)")).collect()}
    assert report == {1: (3, 0), 2: (2, 1), 4: (1, 0)}
    assert lines.drop_repeated_lines(table.filter("false")).count() == 0 and lines.line_report(table.filter("false")).count() == 0


def test_rows_of_one_id_keep_the_lines_that_are_found_nowhere_else(spark):
    line, own = "a line that is said in two documents of them", "a line of its own that no other row has at all"
    rows = [(1, line), (5, f"own\n{line}"), (5, f"x\n{own}"), (None, f"{own}\nz"), (None, f"{line}\n{own}")]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in lines.drop_repeated_lines(table).collect()), key=str)
    assert sum(t.count(line) for _, t in got) == 1 == sum(t.count(own) for _, t in got)
    assert [t for i, t in got if i == 5] in (["own", "x"], ["own", f"x\n{own}"]) and (1, "") in got
    report = lines.line_report(table).collect()
    assert len(report) == 5 and sum(r.n_removed for r in report) == 4
