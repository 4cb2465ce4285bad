import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docweave.operators import chunking as c


def test_recursive_sizes_and_overlap():
    text = " ".join(f"word{i}" for i in range(200))
    parts = c.split_recursive(text, c.TEXT_SEPARATORS, 100, 20)
    assert all(len(p) <= 100 for p in parts) and parts[0].startswith("word0")
    for a, b in zip(parts, parts[1:]):
        assert a.split()[-1] in b.split()[:4]


def test_recursive_prefers_paragraphs_and_cuts_long_words():
    assert c.split_recursive("aaaa\n\nbbbb\n\ncccc", c.TEXT_SEPARATORS, 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert c.split_recursive("x" * 25, c.TEXT_SEPARATORS, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert c.split_recursive("", c.TEXT_SEPARATORS, 10, 0) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300))
def test_recursive_loses_no_character(text):
    parts = c.split_recursive(text, c.TEXT_SEPARATORS, 20, 0)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(len(p) <= 20 for p in parts)


MD = "# A\nintro\n## B\n| h1 | h2 |\n|----|----|\n| 1 | 2 |\n| 3 | 4 |\n```py\nx = 1\n# not a heading\n```\n### C\ntail\n# D\nend"


def test_markdown_structure():
    out = c.split_markdown(MD, 512, 64)
    assert [(k, p) for _, p, k in out] == [
        ("text", "A"), ("table_row", "A > B"), ("table_row", "A > B"), ("code", "A > B"), ("text", "A > B > C"), ("text", "D")]
    assert out[1][0] == "A > B\n| h1 | h2 |\n| 1 | 2 |"
    assert out[3][0].endswith("# not a heading\n```")
    assert out[4][0] == "A > B > C\ntail"


def test_markdown_long_fence_is_cut_at_lines_and_fenced_again():
    body = "\n".join(f"line {i:04d}" for i in range(400))
    out = c.split_markdown(f"```\n{body}\n```", 512, 0)
    assert len(out) > 1 and all(t.startswith("```\n") and t.endswith("\n```") for t, _, _ in out)
    assert "\n".join(t[4:-4] for t, _, _ in out) == body


def test_html_structure():
    html = "<h1>T</h1><p>para one</p><h2>S</h2><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><h2>Only</h2><script>x()</script>"
    out = c.split_html(html, 512, 64)
    assert out == [("T\npara one", "T", "text"), ("T > S\n| a | b |\n| 1 | 2 |", "T > S", "table_row")]


def test_html_body_drops_furniture():
    assert c.html_body("<nav>menu</nav><p> a <b>b</b></p><footer>f</footer><p>c\n d</p>") == "a\nb\nc\nd"


def test_element_stream():
    out = c.split_elements([("Title", "A"), ("NarrativeText", "x"), ("Title", "B"), ("Title", "C"), ("Header", "page 1"), ("Table", "t"), ("NarrativeText", "y")], 512, 0)
    assert [(p, k) for _, p, k in out] == [("A", "text"), ("B > C", "table"), ("B > C", "text")]


@pytest.mark.parametrize("path,want", [("a/b.MD", "markdown"), ("x.htm", "html"), ("m.rs", "code"), ("r.docx", "word"), ("n.txt", "recursive"), ("none", "recursive")])
def test_strategy(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(c.strategy_of(F.col("p"))).first()[0] == want


def test_chunk_table(spark):
    df = spark.createDataFrame([("a.md", MD), ("b.py", "class A:\n    pass\n\ndef f():\n    return 1\n" * 20), ("c.txt", "")], "path string, text string")
    out = c.chunk_documents(df, "path", strategy=c.strategy_of(F.col("path")), extension=F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)), size=120, overlap=0)
    n = {r["path"]: r["n"] for r in out.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert n["a.md"] == 6 and n["b.py"] > 5 and "c.txt" not in n
    for r in out.groupBy("path").agg(F.max("chunk_index").alias("m"), F.max("total_chunks").alias("t")).collect():
        assert r["m"] + 1 == r["t"]


def test_elements_table(spark):
    df = spark.createDataFrame([(1, 0, "Title", "A"), (1, 1, "NarrativeText", "x"), (2, 0, "Table", "t")], "d int, pos int, category string, text string")
    got = {(r["d"], r["heading_path"], r["kind"]) for r in c.chunk_elements(df, "d").collect()}
    assert got == {("1", "A", "text"), ("2", "", "table")}
