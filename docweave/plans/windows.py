"""Windowed queries on the event table, in the batch form of the stream rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave.plans.catalog import query
from docweave.streaming import limits, runs, windows

HOPS = "(SELECT unnest([0, 1, 2, 3]) AS o)"
HOUR = "time_bucket(INTERVAL 15 MINUTES, ts) - o * INTERVAL 15 MINUTES"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("error_rate_windows", f"""SELECT strftime({HOUR}, {STAMP}) AS window_start, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio FROM events, {HOPS} GROUP BY 1""")
def error_rate_windows(t) -> DataFrame:
    """Error ratio over an hour, every quarter of an hour."""
    out = windows.error_rates(t.events, [], "1 hour", "15 minutes", F.col("event_type") == "error")
    return _text(out, "window_start").withColumn("ratio", F.round("ratio", 6))


@query("held_alerts", f"""WITH r AS (SELECT {HOUR} AS w, count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio FROM events, {HOPS} GROUP BY 1),
b AS (SELECT w, w - row_number() OVER (ORDER BY w) * INTERVAL 15 MINUTES AS g FROM r WHERE ratio > 0.3)
SELECT strftime(min(w), {STAMP}) AS alert_start, strftime(max(w), {STAMP}) AS alert_end, count(*) AS windows FROM b GROUP BY g HAVING count(*) >= 4""")
def held_alerts(t) -> DataFrame:
    """Stretches of an hour or more in which the error ratio stayed above 0.3."""
    rates = windows.error_rates(t.events, [], "1 hour", "15 minutes", F.col("event_type") == "error").withColumn("label", F.lit("all"))
    return _text(windows.held_alerts(rates, ["label"], F.col("ratio") > 0.3, 900, 4).drop("label"), "alert_start", "alert_end")


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
LE = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le{i}" for i, b in enumerate(BOUNDS))
INTERPOLATED = "CASE " + " ".join(
    f"WHEN le{i} >= 0.95 * n THEN CASE WHEN le{i} - {'le%d' % (i - 1) if i else '0'} > 0 THEN {BOUNDS[i - 1] if i else 0.0} + ({b} - {BOUNDS[i - 1] if i else 0.0}) * (0.95 * n - {'le%d' % (i - 1) if i else '0'}) / (le{i} - {'le%d' % (i - 1) if i else '0'}) ELSE {BOUNDS[i - 1] if i else 0.0} END"
    for i, b in enumerate(BOUNDS)) + f" ELSE {BOUNDS[-1]} END"


@query("p95_windows", f"""WITH c AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS w, event_type, count(value) AS n, {LE} FROM events GROUP BY 1, 2)
SELECT strftime(w, {STAMP}) AS window_start, event_type, n, round(({INTERPOLATED})::DOUBLE, 6) AS quantile FROM c""")
def p95_windows(t) -> DataFrame:
    """95th percentile of the value per six hours and type, from histogram buckets."""
    out = windows.bucket_quantile(t.events, ["event_type"], "6 hours", BOUNDS)
    return _text(out, "window_start").withColumn("quantile", F.round("quantile", 6))


@query("latency_windows", f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {STAMP}) AS window_start, event_type, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY 1, 2""")
def latency_windows(t) -> DataFrame:
    """Mean value per hour and type."""
    return _text(windows.mean_latency(t.events, ["event_type"], "1 hour"), "window_start").withColumn("mean", F.round("mean", 6))


@query("target_down", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, user_id % 10 AS target, max((event_type <> 'error' AND event_type <> 'view')::INT) AS up FROM events GROUP BY 1, 2),
b AS (SELECT target, w, w - row_number() OVER (PARTITION BY target ORDER BY w) * INTERVAL 1 HOUR AS g FROM w WHERE up = 0)
SELECT target, strftime(min(w), {STAMP}) AS alert_start, strftime(max(w), {STAMP}) AS alert_end, count(*) AS windows FROM b GROUP BY target, g HAVING count(*) >= 2""")
def target_down(t) -> DataFrame:
    """Targets (groups of users) that only failed for two hours or more."""
    up = t.events.select("ts", (F.col("user_id") % 10).alias("target"), (~F.col("event_type").isin("error", "view")).cast("int").alias("up"))
    return _text(windows.target_down(up, ["target"], "1 hour", 3600, 2), "alert_start", "alert_end")


@query("session_batches", f"""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN ts END AS opened FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, event_id, max(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start FROM g)
SELECT DISTINCT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS batch_start, event_id FROM s""")
def session_batches(t) -> DataFrame:
    """Items of every key collected until six hours of silence."""
    out = windows.quiet_batches(t.events, "user_id", "event_id", 6 * 3600.0)
    return out.withColumn("batch_start", F.date_format("batch_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("idle_runs", """WITH r AS (SELECT user_id AS run_id, max(ts) AS last_at, max(CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN ts END) AS fin FROM events GROUP BY 1)
SELECT run_id, CASE WHEN fin IS NOT NULL THEN CASE WHEN TIMESTAMP '2024-01-30 23:00:00' - fin > INTERVAL 10 DAYS THEN 'expired' ELSE 'finished' END
  WHEN TIMESTAMP '2024-01-30 23:00:00' - last_at > INTERVAL 6 HOURS THEN 'stalled' ELSE 'running' END AS state FROM r""")
def idle_runs(t) -> DataFrame:
    """State of every run (user) at the end of January."""
    frames = t.events.select(F.col("user_id").alias("run_id"), "ts", ((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)).alias("terminal"))
    return windows.idle_runs(frames, F.lit("2024-01-30 23:00:00").cast("timestamp"), 6 * 3600, 10 * 86400).select("run_id", "state")


@query("resume_frames", """WITH e AS (SELECT user_id, greatest(0, max(event_id) - 4000) AS dropped FROM events GROUP BY 1), c AS (SELECT user_id, user_id * 37 % 9000 AS cursor FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id AS run_id, cursor <= 0 OR cursor >= dropped AS can_resume, (SELECT count(*) FROM events x WHERE x.user_id = c.user_id AND x.event_id > greatest(cursor, dropped)) AS frames FROM c JOIN e USING (user_id)""")
def resume_frames(t) -> DataFrame:
    """Frames a reader gets from its cursor on, and whether it missed any."""
    frames = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"))
    cursors = t.events.select(F.col("user_id").alias("run_id")).distinct().withColumn("cursor", F.col("run_id") * 37 % 9000)
    after, state = windows.resume_frames(frames, cursors)
    n = after.groupBy("run_id").agg(F.count(F.lit(1)).alias("frames"))
    return state.join(n, "run_id", "left").select("run_id", "can_resume", F.coalesce("frames", F.lit(0)).alias("frames"))


@query("document_status", """SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY 1""")
def document_status(t) -> DataFrame:
    """Latest status of every document (user)."""
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    return windows.latest_status(rows, "doc_id").select("doc_id", "status", "changes")


def in_turn(rows: str, state: str, step: str, groups: str = "k") -> str:
    """A twin that reads the rows of each group one after the other: ``rows`` selects k, id, moment and what ``step`` (the new state) needs."""
    keys = groups.split(", ")
    same = " AND ".join(f"e.{g} = st.{g}" for g in keys)
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY moment, id) AS n FROM ({rows})),
st AS (SELECT {groups}, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BOOLEAN AS admitted, {state} FROM (SELECT DISTINCT {groups} FROM e)
  UNION ALL SELECT {', '.join('e.' + g for g in keys)}, e.n, e.id, {step} FROM st JOIN e ON {same} AND e.n = st.n + 1)"""


LIVE = "list_filter(stamps, lambda x: moment - x <= 43200)"


@query("rate_limit", in_turn("SELECT user_id::VARCHAR AS k, event_id AS id, epoch_us(ts) / 1000000.0::DOUBLE AS moment FROM events", "[]::DOUBLE[] AS stamps",
       f"len({LIVE}) < 3, CASE WHEN len({LIVE}) < 3 THEN list_append({LIVE}, moment) ELSE {LIVE} END") + " SELECT k AS user_id, id AS event_id, admitted FROM st WHERE n > 0")
def rate_limit(t) -> DataFrame:
    """Events admitted at three per half day and user."""
    return limits.rate_limit(t.events, "user_id", "event_id", 3, 43200.0)


@query("daily_quota", in_turn("SELECT user_id::VARCHAR AS k, event_id AS id, epoch_us(ts) AS moment, ts::DATE AS day, value FROM events", "0.0::DOUBLE AS used",
       "value <= 0 OR used + value <= 100, CASE WHEN value > 0 AND used + value <= 100 THEN used + value ELSE used END", "k, day") + " SELECT k AS user_id, id AS event_id, admitted FROM st WHERE n > 0")
def daily_quota(t) -> DataFrame:
    """Amounts admitted up to 100 a day and user."""
    return limits.daily_quota(t.events, "user_id", "event_id", "value", 100.0)


@query("quota_refunds", in_turn("SELECT (user_id % 12)::VARCHAR AS k, event_id AS id, epoch_us(ts) AS moment, ts::DATE AS day, value, event_type = 'error' AS back FROM events", "0.0::DOUBLE AS used",
       "CASE WHEN back THEN NULL ELSE value <= 0 OR used + value <= 200 END, CASE WHEN back THEN greatest(0, used - greatest(0, value)) WHEN value > 0 AND used + value <= 200 THEN used + value ELSE used END", "k, day")
       + " SELECT k AS account, id AS event_id, admitted FROM st WHERE n > 0 AND admitted IS NOT NULL")
def quota_refunds(t) -> DataFrame:
    """Amounts admitted up to 200 a day and account, where failed events give theirs back."""
    rows = t.events.select((F.col("user_id") % 12).alias("account"), "event_id", "ts", "value", F.when(F.col("event_type") == "error", "refund").alias("action"))
    return limits.daily_quota(rows, "account", "event_id", "value", 200.0, "action")


LAPSED = "CASE WHEN open > 0 AND moment - last > 43200 THEN 0 ELSE open END"


@query("concurrency_slots", in_turn("SELECT user_id::VARCHAR AS k, event_id AS id, epoch_us(ts) / 1000000.0::DOUBLE AS moment, event_type = 'view' AS asks FROM events WHERE event_type IN ('view', 'error')",
       "0::BIGINT AS open, 0.0::DOUBLE AS last", f"""CASE WHEN asks THEN ({LAPSED}) < 2 END,
  CASE WHEN NOT asks THEN greatest(0, open - 1) WHEN ({LAPSED}) < 2 THEN ({LAPSED}) + 1 ELSE ({LAPSED}) END, CASE WHEN asks AND ({LAPSED}) < 2 THEN moment ELSE last END""")
       + " SELECT k AS user_id, id AS event_id, admitted FROM st WHERE admitted IS NOT NULL")
def concurrency_slots(t) -> DataFrame:
    """Slots acquired by views and freed by errors, two per user for 12 hours."""
    rows = t.events.filter(F.col("event_type").isin("view", "error")).withColumn("action", F.when(F.col("event_type") == "view", "acquire").otherwise("release"))
    return limits.slots(rows, "user_id", "event_id", 2, 43200.0)


@query("guard_fragments")
def guard_fragments(t) -> DataFrame:
    """Lines of every document as fragments of one answer, secrets masked across borders."""
    lines = t.documents.select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "(?<=\n)")).alias("seq", "text"), F.size(F.split("text", "(?<=\n)")).alias("n"))
    return runs.guard_fragments(lines.withColumn("last", F.col("seq") == F.col("n") - 1)).select("run_id", "seq", F.md5("text").alias("digest"), "rules")
