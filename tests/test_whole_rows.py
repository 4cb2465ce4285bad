"""No row is lost to nulls, equal vectors, long lists or one-sided groups."""

from pyspark.sql import functions as F

from docweave.functions import routing, rules
from docweave.operators import context, lexical
from docweave.streaming import limits

AT = "2024-01-01 10:00:0{}"


def events(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def test_limits_answer_every_event(spark):
    rows = [("a", 1, AT.format(0)), ("a", 2, AT.format(1)), (None, 3, AT.format(0)), (None, 4, AT.format(1)), ("a", 5, None), (None, 6, None)]
    got = {r.event_id: r.admitted for r in limits.rate_limit(events(spark, rows, "k string, event_id long, ts string"), "k", "event_id", 1, 60).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_quota_counts_null_amounts_as_nothing(spark):
    rows = [("a", 1, AT.format(0), 6.0), ("a", 2, AT.format(1), None), ("a", 3, AT.format(2), 6.0), (None, 4, AT.format(0), 6.0), (None, 5, AT.format(1), 6.0), (None, 6, None, 11.0), ("b", 7, None, 6.0), ("b", 8, None, 6.0)]
    found = limits.daily_quota(events(spark, rows, "k string, event_id long, ts string, amount double"), "k", "event_id", "amount", 10.0).collect()
    assert {r.event_id: r.admitted for r in found} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True, 8: False} and len(found) == 8


def test_slots_with_releases_only(spark):
    schema = "k string, event_id long, ts string, action string"
    rows = [("r", n, AT.format(n), "release") for n in range(5)]
    assert limits.slots(events(spark, rows, schema), "k", "event_id", 1).count() == 0
    more = [(None, 10, AT.format(0), "acquire"), (None, 11, AT.format(1), None), (None, 12, AT.format(2), "release"), (None, 13, AT.format(3), "acquire"), ("x", 14, None, "acquire"), ("x", 15, None, "release")]
    got = {r.event_id: r.admitted for r in limits.slots(events(spark, rows + more, schema), "k", "event_id", 1).collect()}
    assert got == {10: True, 11: False, 13: True, 14: True}


def test_null_kinds_are_raw(spark):
    df = spark.createDataFrame([(1, "raw"), (2, None), (3, "wiki")], "id int, source_kind string").withColumns({"kb_id": F.lit("k"), "document_id": F.lit("d")})
    ids = lambda **how: sorted(r.id for r in df.filter(context.retrieval_filter(**how)).collect())
    assert ids(exclude_kinds=["wiki"]) == [1, 2] and ids(source_kind="raw") == [1, 2] and ids(kb_ids=[], document_ids=[]) == [1, 2, 3]


def test_long_lexicon_and_short_one_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aaa badword xbad" + " bad" * 600), (2, ""), (3, None), (4, "none of it")], "id int, text string")
    lexicon = spark.createDataFrame([("bad", "c", 1), ("aa", "c", 2), ("badword", "d", 3), ("of it", "d", 4)], "word string, category string, position int")
    seen = lambda: {(r.id, r.word, r.n) for r in rules.lexicon_findings(docs, "id", "text", lexicon).collect()}
    short = seen()
    monkeypatch.setattr(rules, "PATTERN_WORDS", 1)
    assert short == seen() == {(1, "bad", 602), (1, "aa", 2), (1, "badword", 1), (4, "of it", 1)}


def test_many_short_passages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three"), (2, "onetwo"), (3, None)], "doc int, text string")
    passages = spark.createDataFrame([(1, "one"), (2, "two three"), (3, "etw"), (4, "")], "item int, text string")
    seen = lambda: {(r.item, r.doc) for r in lexical.containing_documents(docs, passages, "doc", "item").collect()}
    few = seen()
    monkeypatch.setattr(lexical, "FEW_PASSAGES", 1)
    assert few == seen() == {(1, 1), (1, 2), (2, 1), (3, 2)}


def test_weather_questions_ask_for_the_place(spark):
    df = spark.createDataFrame([(1, "北京今天天气"), (2, "服务器温度"), (3, None)], "id int, q string")
    got = {r.id: r.x for r in df.select("id", routing.rewrite_queries(F.col("q"), "2024-01-31", places=["北", "北京"]).alias("x")).collect()}
    assert got[1][:3] == ["北京今天天气", "北京 今天 天气预报 实时温度", "北京 weather today"] and got[2] == ["服务器温度"] and got[3] == []
