"""Admission rules: sliding-window rate limit, daily quota, concurrency slots.

The rule is one small class per key, fed in time order. On a table the rows of a key are
first cut where the rule cannot look across; on a stream the same class is the state.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.operators.sequential import null_safe_join, scan_groups, seconds, segments


class RateLimit:
    """Admit while fewer than ``limit`` admitted stamps lie inside the window; rejected ones do not count."""

    def __init__(self, limit: int, window: float, stamps: list[float] | None = None):
        self.limit, self.window = limit, window
        self.stamps = deque(stamps or [])

    def admit(self, at: float) -> bool:
        while self.stamps and at - self.stamps[0] > self.window:
            self.stamps.popleft()
        if len(self.stamps) >= self.limit:
            return False
        self.stamps.append(at)
        return True

    def judge(self, at: float, amount: float, action: str | None) -> bool | None:
        return self.admit(at)

    def held(self) -> list:
        return list(self.stamps)

    def load(self, held: list) -> None:
        self.stamps = deque(held)

    def until(self) -> float:
        """When, without further events, nothing of the past counts any more."""
        return self.stamps[-1] + self.window if self.stamps else 0.0


class DailyQuota:
    """Admit while the day's total stays within the limit; a refused amount is not added, a refund is taken off the day it comes on."""

    def __init__(self, limit: float, used: float = 0.0):
        self.limit, self.used, self.day = limit, used, 0

    def admit(self, amount: float) -> bool:
        if amount <= 0 or self.limit <= 0:
            return True
        if self.used + amount > self.limit:
            return False
        self.used += amount
        return True

    def refund(self, amount: float) -> None:
        self.used = max(0.0, self.used - max(0.0, amount))

    def judge(self, at: float, amount: float, action: str | None) -> bool | None:
        day = int(at // 86400)
        if day != self.day:
            self.day, self.used = day, 0.0
        return self.refund(amount) if action == "refund" else self.admit(amount)

    def held(self) -> list:
        return [self.day, self.used]

    def load(self, held: list) -> None:
        self.day, self.used = held

    def until(self) -> float:
        return (self.day + 1) * 86400.0


class Slots:
    """At most ``limit`` open slots; a release frees one, and all lapse ``ttl`` after the last acquire."""

    def __init__(self, limit: int, ttl: float = 1800.0, open_: int = 0, last: float = 0.0):
        self.limit, self.ttl, self.open, self.last = limit, ttl, open_, last

    def acquire(self, at: float) -> bool:
        if self.open and at - self.last > self.ttl:
            self.open = 0
        if self.open >= self.limit:
            return False
        self.open += 1
        self.last = at
        return True

    def release(self) -> None:
        self.open = max(0, self.open - 1)

    def judge(self, at: float, amount: float, action: str | None) -> bool | None:
        return self.release() if action == "release" else self.acquire(at)

    def held(self) -> list:
        return [self.open, self.last]

    def load(self, held: list) -> None:
        self.open, self.last = held

    def until(self) -> float:
        return self.last + self.ttl if self.open else 0.0


class _Admission(StatefulProcessor):
    """Rows of a key wait until the watermark has passed their time, then meet the rule in order; a timer wakes the key for the
    first waiting row, and later for the moment from which the rule's state counts no more (a lapsed lease, midnight), to drop it."""

    def __init__(self, rule: Callable[[], Any]):
        self.rule = rule

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, at double, amount double, action string")
        self.state = handle.getValueState("state", "held string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for r in pdf[["id", "at", "amount", "action"]].itertuples(index=False):
                self.waiting.appendValue((int(r.id), float(r.at), float(r.amount), r.action))
                first = r.at if first is None else min(first, r.at)
        if first is not None:
            self.handle.registerTimer(max(int(first * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0]))
        due, later = [r for r in rows if r[1] < now], [r for r in rows if r[1] >= now]
        rule = self.rule()
        if self.state.exists():
            rule.load(json.loads(self.state.get()[0]))
        judged = [(r[0], rule.judge(*r[1:])) for r in due]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][1] * 1000) + 1)
        else:
            self.waiting.clear()
        if later or rule.until() >= now:
            self.state.update((json.dumps(rule.held()),))
            if not later:
                self.handle.registerTimer(int(rule.until() * 1000) + 1001)
        else:
            self.state.clear()
        out = [(key[0], i, ok) for i, ok in judged if ok is not None]
        # Spark joins the frames of several keys, and joined strings of Arrow kind would come in pieces, which it refuses
        yield pd.DataFrame({"k": pd.Series([x[0] for x in out], dtype="object"), "id": pd.Series([x[1] for x in out], dtype="int64"), "admitted": pd.Series([bool(x[2]) for x in out], dtype="bool")})

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, key: str, event_id: str, rule: Callable[[], Any], delay: str = "10 minutes", amount: str | None = None,
                     action: str | None = None) -> DataFrame:
    """(key, event_id, admitted) on a stream, as the table forms give it: ``rule`` makes a fresh RateLimit, DailyQuota or Slots.

    An event is judged when the watermark (``delay`` behind the latest time) has passed it, so events that come
    out of order by up to ``delay`` are judged in order, and later ones are dropped by Spark; the state of a key is its
    waiting rows and a few numbers, and goes when it counts no more. Events without a time are admitted at once by the table forms
    and left out here. Needs the RocksDB state store provider.
    """
    rows = events.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.col(key).cast("string").alias("k"), F.col(event_id).cast("long").alias("id"), "ts", seconds(F.col("ts")).alias("at"),
        F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount") if amount else F.lit(0.0).alias("amount"),
        F.col(action).alias("action") if action else F.lit(None).cast("string").alias("action"))
    judged = rows.groupBy("k").transformWithStateInPandas(_Admission(rule), "k string, id long, admitted boolean", "Append", "EventTime")
    return judged.select(F.col("k").alias(key), F.col("id").alias(event_id), "admitted")


def _untimed(rows: DataFrame) -> DataFrame:
    return rows.filter("at is null").select("k", "id", F.lit(True).alias("admitted"))


def rate_limit(events: DataFrame, key: str, event_id: str, limit: int, window_seconds: float) -> DataFrame:
    """(key, event_id, admitted). A pause longer than the window empties it, so every stretch
    between such pauses is judged by itself, also within one busy key. A null key is a key;
    an event without a time can be in no window and is admitted."""
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(event_id).cast("long").alias("id"), seconds(F.col("ts")).alias("at"))
    cut = segments(rows.filter("at is not null"), ["k"], "at", window_seconds, max(86400.0, window_seconds), ["id"], "stretch")

    def step(state: RateLimit, rows: dict) -> tuple:
        return rows["k"], rows["id"], [state.admit(a) for a in rows["at"]]

    judged = scan_groups(cut, ["k", "stretch"], ["at", "id"], lambda: RateLimit(limit, window_seconds), step, "k string, id long, admitted boolean")
    return judged.unionByName(_untimed(rows)).select(F.col("k").alias(key), F.col("id").alias(event_id), "admitted")


def rate_limit_stream(events: DataFrame, key: str, event_id: str, limit: int, window_seconds: float) -> DataFrame:
    """Same rule on a stream; the state of a key is its admitted stamps inside the window.

    A key silent for the window loses its state by timeout.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(event_id).cast("long").alias("id"), seconds(F.col("ts")).alias("at"))

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamps = list(state.get[0]) if state.exists else []
        rule = RateLimit(limit, window_seconds, stamps)
        part = pd.concat(list(batches)).sort_values(["at", "id"])
        out = pd.DataFrame({"k": part["k"], "id": part["id"], "admitted": [rule.admit(a) for a in part["at"]]})
        state.update((list(rule.stamps),))
        state.setTimeoutDuration(int(window_seconds * 1000) + 1000)
        yield out

    return rows.groupBy("k").applyInPandasWithState(
        judge, "k string, id long, admitted boolean", "stamps array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def daily_quota(events: DataFrame, key: str, event_id: str, amount: str, limit: float, action: str | None = None) -> DataFrame:
    """(key, event_id, admitted) per key and UTC day, amounts in time order.

    Rows whose ``action`` is ``refund`` give their amount back to the day they come on, never below 0, and are not in the result.
    Amounts above the limit can never enter and are refused in the scan; days that stay
    within the limit are admitted whole from one sum, so only exhausted days are read in order.
    A null amount counts as 0; null keys and times are a key and a day like others, a null time comes first.
    """
    back = F.coalesce(F.col(action) == "refund", F.lit(False)) if action else F.lit(False)
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(event_id).cast("long").alias("id"), F.to_date("ts").cast("string").alias("day"),
                         seconds(F.col("ts")).alias("at"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"), back.alias("back"))
    fits = F.col("amount") <= limit
    totals = rows.filter(fits & ~F.col("back")).groupBy("k", "day").agg(F.sum(F.greatest("amount", F.lit(0.0))).alias("total"))
    marked = null_safe_join(rows, totals, ["k", "day"], "left")
    free = F.col("amount") <= 0
    easy = marked.filter(~F.col("back") & (~fits | free | (F.col("total") <= limit))).select("k", "id", (fits | free).alias("admitted"))

    def step(state: DailyQuota, rows: dict) -> tuple:
        out: list[tuple[Any, ...]] = []
        for k, i, amount_, returned in zip(rows["k"], rows["id"], rows["amount"], rows["back"]):
            if returned:
                state.refund(amount_)
            else:
                out.append((k, i, state.admit(amount_)))
        return tuple(zip(*out))

    hard = marked.filter(~free & (F.col("total") > limit) & (fits | F.col("back"))).select("k", "day", "id", "at", "amount", "back")
    judged = scan_groups(hard, ["k", "day"], ["at", "id"], lambda: DailyQuota(limit), step, "k string, id long, admitted boolean")
    return easy.unionByName(judged).select(F.col("k").alias(key), F.col("id").alias(event_id), "admitted")


def slots(events: DataFrame, key: str, event_id: str, limit: int, ttl_seconds: float = 1800.0) -> DataFrame:
    """(key, event_id, admitted) for acquire rows; ``action`` is acquire or release.

    Nothing survives a pause longer than the time to live, so stretches are judged apart.
    A null key is a key; a null action acquires; an acquire without a time is admitted.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(event_id).cast("long").alias("id"), seconds(F.col("ts")).alias("at"), "action")
    cut = segments(rows.filter("at is not null"), ["k"], "at", ttl_seconds, max(86400.0, ttl_seconds), ["id"], "stretch")

    def step(state: Slots, rows: dict) -> tuple:
        out: list[tuple[Any, ...]] = []
        for k, i, at, action in zip(rows["k"], rows["id"], rows["at"], rows["action"]):
            if action == "release":
                state.release()
            else:
                out.append((k, i, state.acquire(at)))
        return tuple(zip(*out))

    judged = scan_groups(cut, ["k", "stretch"], ["at", "id"], lambda: Slots(limit, ttl_seconds), step, "k string, id long, admitted boolean")
    return judged.unionByName(_untimed(rows.filter(~F.col("action").eqNullSafe("release")))).select(F.col("k").alias(key), F.col("id").alias(event_id), "admitted")
