import datetime as dt
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from docweave.functions.numbers import value_clusters
from docweave.operators.sequential import segments
from docweave.sources import folders
from docweave.streaming import limits, runs, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = [(i, T0 + dt.timedelta(seconds=rng.uniform(0, 40000)), rng.choice("aaaab"), rng.choice([1.0, 5.0, 20.0, 0.0])) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, ts timestamp, k string, v double").repartition(3)


def in_order(rows):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by[r[2]].append(r)
    return by


def test_segments_cross_slices(spark, events):
    rows, df = events
    got = {r["id"]: r["s"] for r in segments(df.withColumn("at", F.unix_micros("ts") / 1e6), ["k"], "at", 120.0, 500.0, ["id"], "s").collect()}
    for key, part in in_order(rows).items():
        start = last = None
        for i, ts, *_ in part:
            at = ts.replace(tzinfo=dt.timezone.utc).timestamp()
            if last is None or at - last > 120:
                start = at
            last = at
            assert got[i] == pytest.approx(start)


def test_rate_limit_matches_one_pass(events):
    rows, df = events
    got = {r["id"]: r["admitted"] for r in limits.rate_limit(df, "k", "id", 3, 300.0).collect()}
    for part in in_order(rows).values():
        seen = deque()
        for i, ts, *_ in part:
            while seen and (ts - seen[0]).total_seconds() > 300:
                seen.popleft()
            ok = len(seen) < 3
            if ok:
                seen.append(ts)
            assert got[i] == ok, i


def test_rejected_events_do_not_extend_the_window(spark):
    rows = [(i, T0 + dt.timedelta(seconds=s), "a") for i, s in enumerate([0, 1, 30, 59, 61.5])]
    out = limits.rate_limit(spark.createDataFrame(rows, "id long, ts timestamp, k string"), "k", "id", 2, 60.0)
    assert [r["admitted"] for r in out.orderBy("id").collect()] == [True, True, False, False, True]


def test_daily_quota_matches_one_pass(events):
    rows, df = events
    got = {r["id"]: r["admitted"] for r in limits.daily_quota(df, "k", "id", "v", 100.0).collect()}
    assert len(got) == len(rows)
    for part in in_order(rows).values():
        used = 0.0
        for i, _, _, v in part:
            ok = v <= 0 or used + v <= 100
            used += v if ok and v > 0 else 0
            assert got[i] == ok


def test_slots_with_time_to_live(spark):
    data = [(0, 0, "acquire"), (1, 1, "acquire"), (2, 2, "acquire"), (3, 3, "release"), (4, 4, "acquire"), (5, 4000, "acquire")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), "a", x) for i, s, x in data], "id long, ts timestamp, k string, action string")
    assert [r["admitted"] for r in limits.slots(df, "k", "id", 2).orderBy("id").collect()] == [True, True, False, True, True]


def write(spark, df, path, n=3):
    df.repartition(n).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_rate_limit_equals_batch(spark, events, tmp_path):
    rows, df = events
    stream = write(spark, df, str(tmp_path / "in"))
    out = limits.rate_limit_stream(stream, "k", "id", 3, 300.0)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(q)
    got = {(r["id"], r["admitted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["id"], r["admitted"]) for r in limits.rate_limit(df, "k", "id", 3, 300.0).collect()}


def judged_by_stream(spark, tmp_path, batches, schema, rule, **columns):
    """Each batch is a run of the stream from the checkpoint of the one before, so every batch is a restart."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
            stream = limits.admission_stream(spark.readStream.schema(schema).parquet(path), "k", "id", rule, "600 seconds", **columns)
            drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return {r.id: r.admitted for r in spark.read.parquet(out).collect()}


ADMISSIONS = "id long, ts timestamp, k string, v double, action string"


def admissions(seed):
    """Rows of three batches, each out of order by less than the delay, and a last one that moves the watermark past all."""
    rng = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(seconds=rng.uniform(0, 200_000)), rng.choice("aab"), rng.choice([1.0, 5.0, 20.0, 40.0, 0.0, -3.0]), rng.choice([None, "acquire", "release", "refund"])) for i in range(240)]
    rows.sort(key=lambda r: (r[1].timestamp() + rng.uniform(0, 590)))
    last = (9999, T0 + dt.timedelta(days=30), "z", 0.0, None)
    return rows, [rows[:120], rows[120:], [last]]


@pytest.mark.parametrize("kind", ["rate", "quota", "slots"])
def test_admission_streams_equal_the_table_forms(spark, tmp_path, kind):
    rows, batches = admissions(len(kind))
    table = spark.createDataFrame(rows, ADMISSIONS)
    if kind == "rate":
        got, want = judged_by_stream(spark, tmp_path, batches, ADMISSIONS, lambda: limits.RateLimit(3, 4000.0)), limits.rate_limit(table, "k", "id", 3, 4000.0)
    elif kind == "quota":
        got, want = judged_by_stream(spark, tmp_path, batches, ADMISSIONS, lambda: limits.DailyQuota(200.0), amount="v", action="action"), limits.daily_quota(table, "k", "id", "v", 200.0, "action")
    else:
        got, want = judged_by_stream(spark, tmp_path, batches, ADMISSIONS, lambda: limits.Slots(2, 3000.0), action="action"), limits.slots(table, "k", "id", 2, 3000.0)
    want = {r.id: r.admitted for r in want.collect()}
    got.pop(9999, None)
    assert got == want and len(set(want.values())) == 2


def test_a_refund_makes_room_for_one_admission(spark):
    data = [(0, 0, 50.0, None), (1, 1, 50.0, None), (2, 2, 1.0, None), (3, 3, 50.0, "refund"), (4, 4, 50.0, None), (5, 5, 1.0, None), (6, 90_000, 100.0, None), (7, 90_001, 500.0, "refund"), (8, 90_002, 101.0, None), (9, 90_003, 100.0, None)]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), "u", v, x) for i, s, v, x in data], ADMISSIONS.replace("k string, v", "k string, v"))
    got = {r.id: r.admitted for r in limits.daily_quota(df, "k", "id", "v", 100.0, "action").collect()}
    assert got == {0: True, 1: True, 2: False, 4: True, 5: False, 6: True, 8: False, 9: True}


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "ts timestamp, failed boolean"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    path = str(tmp_path / "in")
    stream = lambda: windows.error_rates(spark.readStream.schema(schema).parquet(path).withWatermark("ts", "1 minute"), [], "5 minutes").writeStream.format(
        "parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    for batch in ([(at(1), True), (at(2), False)], [(at(30), False)], [(at(3), True), (at(31), False)], [(at(60), False)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(path)
        drain(stream())
    got = {r["window_start"]: (r["errors"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[T0] == (1, 2) and got[at(30)] == (0, 2)


def test_quiet_batches_stream_equals_batch(spark, events, tmp_path):
    _, df = events
    stream = write(spark, df.select("id", "ts", "k"), str(tmp_path / "in"), 1)
    out = windows.quiet_batches_stream(stream, "k", "id", "120 seconds", "1 hour")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(q)
    done = {(r["k"], r["batch_start"], tuple(r["items"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = windows.quiet_batches(df, "k", "id", 120.0).groupBy("k", "batch_start").agg(F.array_sort(F.collect_list("id")).alias("items"), F.max("batch_start").alias("m"))
    every = {(r["k"], r["batch_start"], tuple(r["items"])) for r in batch.collect()}
    assert done and done <= every


def test_usage_ledger_counts_each_batch_once(spark, tmp_path):
    schema = ("ts timestamp, provider_id string, model_id string, task string, currency string, latency_ms double, success boolean, "
              "input_tokens int, output_tokens int, in_price double, out_price double, error string")
    src, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    call = (T0, "p", "m", "t", "USD", 1.0, True, 10, 10, 1.0, 1.0, None)
    assert runs.usage_ledger(spark, ledger) is None and runs.compact_ledger(spark, ledger) == -1

    def run(rows, cp="cp"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        drain(runs.usage_ledger_stream(spark.readStream.schema(schema).parquet(src), ledger, str(tmp_path / cp)))
        return runs.usage_ledger(spark, ledger).collect()

    assert [r.calls for r in run([call] * 2)] == [2]
    other = (T0, "q", "m", "t", "USD", 1.0, False, 10, 10, 1.0, 1.0, "late")
    assert sorted((r.provider_id, r.calls) for r in run([call] * 3 + [other])) == [("p", 5), ("q", 1)]
    assert [spark.read.parquet(f"{ledger}/deltas/batch={b}").count() for b in (0, 1)] == [1, 2]  # a batch's own rows only
    assert runs.compact_ledger(spark, ledger) == 1 and folders.subfolders(spark, f"{ledger}/deltas") == []
    assert folders.subfolders(spark, f"{ledger}/compact") == ["upto=1"]
    rows = run([call, (T0, "q", "m", "t", "USD", 1.0, False, 1, 1, 1.0, 1.0, "later")])
    assert sorted((r.provider_id, r.calls, r.last_error) for r in rows) == [("p", 6, ""), ("q", 2, "later")]
    # a batch that runs again, and a compaction that stopped before it removed anything, add nothing
    spark.read.parquet(f"{ledger}/deltas/batch=2").write.mode("overwrite").parquet(f"{ledger}/deltas/_again")
    spark.read.parquet(f"{ledger}/deltas/_again").write.mode("overwrite").parquet(f"{ledger}/deltas/batch=2")
    kept = spark.read.parquet(f"{ledger}/deltas/batch=2").collect()
    assert runs.compact_ledger(spark, ledger) == 2
    spark.createDataFrame(kept).write.parquet(f"{ledger}/deltas/batch=2")
    assert sorted(map(str, runs.usage_ledger(spark, ledger).collect())) == sorted(map(str, rows))
    assert runs.compact_ledger(spark, ledger) == 2 and folders.subfolders(spark, f"{ledger}/deltas") in ([], ["_again"])


def test_guard_masks_across_fragments(spark):
    key = "sk-" + "a" * 20
    text = f"hello {key} world, nothing more to see here"
    for size in (1, 3, 7, 100):
        parts = [text[i:i + size] for i in range(0, len(text), size)]
        df = spark.createDataFrame([("r", i, p, i == len(parts) - 1) for i, p in enumerate(parts)], "run_id string, seq int, text string, last boolean")
        out = runs.guard_fragments(df).orderBy("seq").collect()
        assert "".join(r["text"] for r in out) == runs.mask(text)[0]
        assert any("openai_key" in r["rules"] for r in out)


def test_resume_idle_and_quantile(spark):
    frames = spark.createDataFrame([("r", i) for i in range(1, 11)], "run_id string, seq long")
    cur = spark.createDataFrame([("r", 2)], "run_id string, cursor long")
    after, state = windows.resume_frames(frames, cur, buffer=6)
    assert after.count() == 6 and state.first()["can_resume"] is False
    lat = spark.createDataFrame([(T0, float(v)) for v in [1, 2, 3, 4, 100]], "ts timestamp, value double")
    q = windows.bucket_quantile(lat, [], "1 hour", [2.0, 4.0, 8.0], 0.5).first()["quantile"]
    assert q == pytest.approx(2 + 2 * (2.5 - 2) / 2)
    assert windows.bucket_quantile(lat, [], "1 hour", [2.0, 4.0], 0.95).first()["quantile"] == 4.0


def test_clusters_match_one_pass(spark):
    rng = random.Random(9)
    vals = [(i, rng.choice([0.0, 1.0, 1.04, 1.08, 1.12, 10.0, 10.3, 500.0, -3.0, -3.1]) * rng.choice([1, 1, 1.01]), rng.choice("xyz")) for i in range(80)]
    df = spark.createDataFrame([(1, *v) for v in vals], "g int, pos int, value double, domain string")
    clusters = []
    for _, v, d in vals:
        home = next((c for c in clusters if c[0] != 0 and abs(v - c[0]) / abs(c[0]) <= 0.05), None)
        if home is None:
            clusters.append([v, 1, {d}])
        else:
            home[1] += 1
            home[2].add(d)
    got = sorted((r["base"], r["members"], r["domains"]) for r in value_clusters(df, ["g"]).collect())
    assert got == sorted((c[0], c[1], len(c[2])) for c in clusters)
