"""The query and the pipeline leave out no line for its number of words."""

import corpus_pipeline
from docweave.llm import queries

SHORT, LONG = "All rights reserved.", "文" * 30 + "字" * 30


def test_short_lines_and_scripts_without_spaces(spark, tmp_path):
    rows = [(1, f"{SHORT}\n{LONG}"), (2, f"own\n{SHORT}"), (3, LONG[:-1] + "子"), (4, " \n\n"), (5, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [(x.line, x.first_doc, x.exact) for x in r.links or []] for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [(1, 1, True)], 3: [(0, 1, False)], 4: [], 5: []}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: rows[0][1], 2: "own", 3: "", 4: " \n\n", 5: "\n\n"}
