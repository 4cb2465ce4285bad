"""Every line of a class has its class and the number of distinct lines near it."""

import random

import pytest

from docweave.llm import lines
from tests.llm.test_lines import changed, distance

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("block", [2048, 6])
def test_near_counts_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "GROUP_BLOCK", block)
    rng = random.Random(5)
    base = "one line of many words that is said with small edits"
    some = [base, "x" + base[1:], "xy" + base[2:], "xyz" + base[3:], "xyzt" + base[4:]] + [changed(rng, base, n % 4) for n in range(25)]
    rows = [(n, x) for n, x in enumerate([*some, base, "a line that stays alone and has no other one near it"])]
    got = lines.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {x.strip(lines.TRIM) for _, x in rows}
    want = {n: sum(y != x.strip(lines.TRIM) and distance(x.strip(lines.TRIM), y) <= 2 for y in texts) for n, x in rows}
    assert {r.doc_id: r.near for r in got} == {n: w for n, w in want.items() if w}
    report = {r.doc_id: r for r in lines.line_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [x.near for x in report[0].leads] == [want[0]] and [(x.first_doc, x.near) for x in report[4].links] == [(0, want[4])]
