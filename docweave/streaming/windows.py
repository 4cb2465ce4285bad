"""Windowed rates, latencies and batches; the same expressions run on tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.operators.sequential import seconds, segments


def error_rates(events: DataFrame, by: list[str], size: str, slide: str | None = None, failed: Column | None = None) -> DataFrame:
    """(window_start, by, errors, total, ratio) per sliding window of ``ts``.

    On a stream the caller sets the watermark first; late rows then drop out.
    """
    failed = F.col("failed") if failed is None else failed
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.groupBy(w.alias("w"), *by).agg(F.count_if(failed).alias("errors"), F.count(F.lit(1)).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), *by, "errors", "total",
                      (F.col("errors") / F.greatest(F.col("total").cast("double"), F.lit(1e-9))).alias("ratio"))


def mean_latency(events: DataFrame, by: list[str], size: str, slide: str | None = None, value: str = "value") -> DataFrame:
    """Sum over count of a latency per window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.groupBy(w.alias("w"), *by).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
    return agg.select(F.col("w.start").alias("window_start"), *by, (F.col("sum") / F.col("n")).alias("mean"))


def bucket_quantile(events: DataFrame, by: list[str], size: str, bounds: list[float], q: float = 0.95,
                    slide: str | None = None, value: str = "value") -> DataFrame:
    """Quantile per window from histogram buckets, linear inside the bucket that holds it.

    ``bounds`` are the upper limits in order; what lies above the last one is reported as
    the last bound, as a histogram with an open top bucket gives it.
    """
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = [F.count_if(F.col(value) <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]
    agg = events.groupBy(w.alias("w"), *by).agg(F.count(value).alias("n"), *counts)
    rank = F.lit(q) * F.col("n")
    out = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        low = float(bounds[i - 1]) if i else 0.0
        inside = F.col(f"_le{i}") - below
        at = F.when(inside > 0, low + (bounds[i] - low) * (rank - below) / inside).otherwise(F.lit(low))
        out = F.when(F.col(f"_le{i}") >= rank, at).otherwise(out)
    return agg.select(F.col("w.start").alias("window_start"), *by, "n", out.alias("quantile"))


def held_alerts(windows: DataFrame, by: list[str], breach: Column, step_seconds: int, hold: int) -> DataFrame:
    """(by, alert_start, alert_end, windows): stretches of at least ``hold`` consecutive
    breaching windows. A missing window ends a stretch.

    One row per window comes in, so a label holds as many rows as there are windows.
    """
    hits = windows.filter(breach).withColumn("_at", F.unix_timestamp("window_start").cast("double"))
    runs = segments(hits, by, "_at", float(step_seconds), 86400.0 * 30, by, "_start")
    out = runs.groupBy(*by, "_start").agg(F.min("window_start").alias("alert_start"), F.max("window_start").alias("alert_end"),
                                          F.count(F.lit(1)).alias("windows"))
    return out.filter(F.col("windows") >= hold).drop("_start")


def target_down(samples: DataFrame, by: list[str], size: str, step_seconds: int, hold: int) -> DataFrame:
    """Targets whose ``up`` samples were all 0 for ``hold`` windows in a row."""
    w = samples.groupBy(F.window("ts", size).alias("w"), *by).agg(F.max("up").alias("up")).select(F.col("w.start").alias("window_start"), *by, "up")
    return held_alerts(w, by, F.col("up") == 0, step_seconds, hold)


def quiet_batches(events: DataFrame, key: str, item: str, gap_seconds: float, distinct: bool = True) -> DataFrame:
    """(key, batch_start, item): items collected until ``gap_seconds`` of silence.

    One row per item, so a batch of any size stays spread over tasks; read it sorted by
    item. Answers keep every item (``distinct=False``), documents each one once.
    """
    rows = events.select(key, item, "ts", seconds(F.col("ts")).alias("_at"))
    runs = segments(rows, [key], "_at", gap_seconds, 86400.0, [item], "_start")
    out = runs.select(key, F.timestamp_micros(F.round(F.col("_start") * 1e6).cast("long")).alias("batch_start"), item)
    return out.distinct() if distinct else out


def quiet_batches_stream(events: DataFrame, key: str, item: str, gap: str, watermark: str) -> DataFrame:
    """The stream form: a batch is emitted once the watermark passes its silence."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.array_sort(F.collect_set(item)).alias("items"), F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "items", "n")


def idle_runs(frames: DataFrame, now: Column, idle_seconds: int = 900, retention_seconds: int = 300) -> DataFrame:
    """(run_id, last_at, state): terminal runs past retention are expired, others without an
    event for too long are stalled.

    ``frames``: run_id, ts, terminal.
    """
    runs = frames.groupBy("run_id").agg(F.max("ts").alias("last_at"), F.max(F.when(F.col("terminal"), F.col("ts"))).alias("finished_at"))
    age = lambda c: F.unix_micros(now) - F.unix_micros(F.col(c))
    state = (F.when(F.col("finished_at").isNotNull(), F.when(age("finished_at") > retention_seconds * 1_000_000, "expired").otherwise("finished"))
             .when(age("last_at") > idle_seconds * 1_000_000, "stalled").otherwise("running"))
    return runs.select("run_id", "last_at", state.alias("state"))


def resume_frames(frames: DataFrame, cursors: DataFrame, buffer: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(frames after each cursor, resume report). Frames beyond the buffer are gone.

    ``frames``: run_id, seq, payload; ``cursors``: run_id, cursor. A cursor older than what
    was dropped has a gap; 0 replays what is left.
    """
    edge = frames.groupBy("run_id").agg(F.greatest(F.lit(0), F.max("seq") - buffer).cast("long").alias("dropped"))
    state = cursors.join(edge, "run_id").withColumn("can_resume", (F.col("cursor") <= 0) | (F.col("cursor") >= F.col("dropped")))
    after = frames.join(state.select("run_id", F.greatest("cursor", "dropped").alias("_from")), "run_id").filter(F.col("seq") > F.col("_from")).drop("_from")
    return after, state


def latest_status(changes: DataFrame, key: str) -> DataFrame:
    """Newest status per document; on a stream run it in update mode."""
    return changes.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("changes"))

