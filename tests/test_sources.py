import json

import pytest
from pyspark.sql import functions as F

from docweave.plans import QUERIES, SQL
from docweave.plans.ingest import ingest
from docweave.sources import files, sinks


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "docs" / "deep"
    d.mkdir(parents=True)
    (d / "a.md").write_text("# T\nbody 文字", encoding="utf-8")
    (d / "b.csv").write_text('name,note\nann,"two\nlines"\n\nbob\nx,y,z\n', encoding="utf-8")
    (d / "c.json").write_text(json.dumps({"a": ["x", 1, {"b": "y"}], "c": None, "d": "z"}), encoding="utf-8")
    (d / "bad.json").write_text("{", encoding="utf-8")
    (d / "skip.bin").write_bytes(b"\x00")
    (d / "p.pdf").write_bytes(b"%PDF")
    return str(tmp_path / "docs")


def test_readers(spark, folder):
    csv = files.read_csv_texts(spark, f"{folder}/deep/b.csv").orderBy("row").collect()
    assert [r["text"] for r in csv] == ["name: ann\nnote: two\nlines", "name: bob", "name: x\nnote: y"]
    assert files.read_json_texts(spark, f"{folder}/deep/c.json").first()["text"] == "x\ny\nz"
    assert files.read_texts(spark, f"{folder}/deep/a.md").first()["text"] == "# T\nbody 文字"
    objects = {r["key"]: r["size"] for r in files.list_objects(spark, folder).collect()}
    assert objects["deep/skip.bin"] == 1 and len(objects) == 6


def test_folder_keeps_going_and_records_errors(spark, folder):
    texts, errors = files.read_folder(spark, folder)
    assert {r["path"].rsplit("/", 1)[1] for r in errors.collect()} == {"bad.json", "p.pdf"}
    assert texts.count() == 5
    _, errors = files.read_folder(spark, folder, {".pdf": lambda b: [b.decode()]})
    assert errors.count() == 1
    docs, chunks, _ = ingest(spark, folder)
    assert docs.count() == 5 and chunks.filter("heading_path = 'T'").first()["content"] == "T\nbody 文字"


def test_cache_decoding(spark):
    good = json.dumps({"question": "q", "answer": "a", "created_at": 1.5, "kb_ids": ["k"], "sources": []})
    raw = spark.createDataFrame([("s", "f", good), ("s", "g", "not json")], "scope_key string, field string, value string")
    entries, bad = files.decode_cache(raw)
    assert entries.first()["entry_id"] == "s#f" and bad.first()["undecodable"] == 1


CHUNK = "kb_id string, document_id string, chunk_index int, content string"


def test_chunk_sink_copy_and_reingest(spark, tmp_path):
    c = spark.createDataFrame([("k1", "d1", i, f"text {i}") for i in range(4)] + [("k2", "d2", 0, " ")], CHUNK)
    sinks.write_chunks(c, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert {r["source_kind"] for r in back.collect()} == {"raw"}
    assert "PartitionFilters: [isnotnull(kb_id" in back.filter("kb_id = 'k1'")._jdf.queryExecution().toString()
    embed = lambda col: F.array(F.length(col).cast("float"), F.lit(1.0).cast("float"))
    n = sinks.copy_with_vectors(back, embed, 2, str(tmp_path / "v"))
    assert n == {"scanned": 5, "written": 4, "skipped": 1}
    with pytest.raises(Exception, match="another length"):
        sinks.copy_with_vectors(back, embed, 3, str(tmp_path / "w"))


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_reingest_replaces_documents_in_their_buckets(spark, tmp_path):
    store, staged = tmp_path / "store", str(tmp_path / "stage")
    chunks = spark.createDataFrame([("k", f"d{d}", i, f"text {d} {i}") for d in range(40) for i in range(4)], CHUNK)
    sinks.write_bucketed(chunks, str(store), buckets=16)
    before = files_of(store)
    fresh = spark.createDataFrame([("k", "d3", i, f"new {i}") for i in range(3)] + [("k", "d99", 0, "first"), ("k", "d99", 1, None)], CHUNK)
    got = sinks.reingest(spark, str(store), fresh, staged, buckets=16)
    assert (got["removed"], got["added"]) == (4, 4) and got["buckets"] in (1, 2)
    rows = {(r.document_id, r.chunk_index): r.content for r in spark.read.parquet(str(store)).collect()}
    assert rows == {(f"d{d}", i): f"text {d} {i}" for d in range(40) for i in range(4) if d != 3} | {("d3", i): f"new {i}" for i in range(3)} | {("d99", 0): "first"}
    after = files_of(store)
    touched = {name.split("/")[0] for name in before.keys() ^ after.keys()}
    assert len(touched) == got["buckets"] and all(after[n] == t for n, t in before.items() if n.split("/")[0] not in touched)
    for bad, shrink in ([("k", "d5", 0, "one")], False), ([("k", "d5", 0, None)], True), ([("k", "d5", i, "x") for i in range(4)] + [("k", "d6", 0, None)], True):
        with pytest.raises(sinks.IngestRefused):
            sinks.reingest(spark, str(store), spark.createDataFrame(bad, CHUNK), staged, buckets=16, allow_shrink=shrink)
    assert files_of(store) == after
    assert sinks.reingest(spark, str(store), fresh.filter("false"), staged, buckets=16) == {"removed": 0, "added": 0, "buckets": 0}


def test_reingest_is_finished_after_a_crash(spark, tmp_path, monkeypatch):
    store, staged = str(tmp_path / "store"), str(tmp_path / "stage")
    sinks.write_bucketed(spark.createDataFrame([("k", "d1", 0, "old"), ("k", "d2", 0, "old")], CHUNK), store, buckets=4)
    fresh = spark.createDataFrame([("k", "d1", 0, "new")], CHUNK)
    real = sinks.finish_reingest
    calls = []

    def crash(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(sinks, "finish_reingest", crash)
    with pytest.raises(RuntimeError):
        sinks.reingest(spark, store, fresh, staged, buckets=4)
    read = lambda: {r.document_id: r.content for r in spark.read.parquet(store).collect()}
    assert read() == {"d1": "old", "d2": "old"}
    monkeypatch.setattr(sinks, "finish_reingest", real)
    assert sinks.finish_reingest(spark, store, staged) and read() == {"d1": "new", "d2": "old"}
    assert not sinks.finish_reingest(spark, store, staged)


def test_traces_export_and_reindex(spark, tmp_path):
    tr = spark.createDataFrame([(1, "u", "x")], "id int, user_id string, extra string")
    assert sinks.write_traces(tr, str(tmp_path / "t"), ["id", "user_id"]) == ["extra"]
    sinks.export_owner({"traces": (tr, "user_id", ["id"])}, "u", str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "traces")).first()["id"] == 1
    docs = spark.createDataFrame([(i, f"alpha{i} common") for i in range(6)], "id int, text string")
    vocab, stats = sinks.reindex_sparse(docs, ["id"], "text", str(tmp_path / "x"))
    s = stats.first()
    assert vocab.count() == 7 and (s["n_rows"], s["non_empty"], s["mean_nnz"], s["suspect"]) == (6, 6, 1.0, False)


def test_catalog_is_complete(spark):
    assert len(QUERIES) > 140 and set(SQL) <= set(QUERIES)


def test_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first()["num_questions"] == 40
