"""Stream jobs: usage ledger, guarded answer fragments, cached answers, periodic checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.functions.rules import REDACTION, SECRET_RULES
from docweave.operators.sequential import scan_groups
from docweave.operators.usage import merge_versions, usage_daily, usage_measures
from docweave.sources.folders import folder_there, move_folder, remove_folder, subfolders


def usage_ledger_stream(calls: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Writes the daily sums of each batch of calls to ``ledger/deltas/batch=<batch id>``; ``usage_ledger`` merges them.

    A batch writes rows for its own days and keys only, however long the ledger is. A repeated batch
    overwrites its own folder, so a restart after a failure adds nothing twice.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        usage_daily(usage_measures(batch)).write.mode("overwrite").parquet(f"{ledger}/deltas/batch={batch_id}")

    return calls.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger_parts(spark: SparkSession, ledger: str) -> tuple[int, DataFrame | None]:
    """The last batch that is in a compacted version (-1: none), and that version with the deltas after it, numbered by batch."""
    done, version = -1, None
    if folder_there(spark, f"{ledger}/compact"):
        versions = spark.read.parquet(f"{ledger}/compact")
        done = versions.agg(F.max("upto")).first()[0]
        version = versions.filter(F.col("upto") == done).withColumnRenamed("upto", "batch")
    if folder_there(spark, f"{ledger}/deltas"):
        deltas = spark.read.parquet(f"{ledger}/deltas").filter(F.col("batch") > done)
        version = deltas if version is None else version.unionByName(deltas)
    return done, version


def usage_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger as of now: the newest compacted version and the deltas of later batches, summed; None before the first batch."""
    _, parts = _ledger_parts(spark, ledger)
    return None if parts is None else merge_versions(parts, "batch")


def compact_ledger(spark: SparkSession, ledger: str) -> int:
    """Folds all deltas into one version ``ledger/compact/upto=<batch id>`` and removes what it replaces; returns that batch id.

    The version counts for readers once it is written whole, and only then older versions and the deltas in it are removed; a
    compaction that is cut off leaves a ledger that reads the same. A stream may go on meanwhile: its new batches are later.
    """
    done, parts = _ledger_parts(spark, ledger)
    if parts is None:
        return -1
    last = parts.agg(F.max("batch")).first()[0]
    if last > done:
        part = f"{ledger}/compact/_making"
        merge_versions(parts.filter(F.col("batch") <= last), "batch").write.mode("overwrite").parquet(part)
        move_folder(spark, part, f"{ledger}/compact/upto={last}")
    for kind, name, stale in (("compact", "upto", lambda n: n < last), ("deltas", "batch", lambda n: n <= last)):
        for folder in subfolders(spark, f"{ledger}/{kind}"):
            if folder.startswith(f"{name}=") and stale(int(folder.split("=")[1])):
                remove_folder(spark, f"{ledger}/{kind}/{folder}")
    return last


# fixed values: text that may open a secret, and how much is held back
TRIGGERS = ["sk-", "AKIA", "Bearer ", "-----BEGIN", "postgres://", "postgresql://", "你是一个严谨的智能助手"]
HOLD_BACK, MOST_HELD = 8, 256
_PATTERNS = [(name, re.compile(p)) for name, p in SECRET_RULES]


def mask(text: str) -> tuple[str, list[str]]:
    hits = []
    for name, pattern in _PATTERNS:
        text, n = pattern.subn(REDACTION, text)
        if n:
            hits.append(name)
    return text, hits


class FragmentGuard:
    """Holds back the end of the text, and everything from a trigger on, until it can be judged."""

    def __init__(self, held: str = ""):
        self.held = held

    def feed(self, fragment: str) -> tuple[str, list[str]]:
        if not fragment:
            return "", []
        self.held += fragment
        starts = [at for at in (self.held.find(t) for t in TRIGGERS) if at >= 0]
        if not starts:
            cut = max(0, len(self.held) - HOLD_BACK)
            return self._emit(cut)
        out, hits = self._emit(min(starts))
        if len(self.held) > MOST_HELD:
            more, found = self._emit(len(self.held) - MOST_HELD)
            out, hits = out + more, hits + found
        return out, hits

    def _emit(self, cut: int) -> tuple[str, list[str]]:
        out, self.held = self.held[:cut], self.held[cut:]
        return mask(out)

    def flush(self) -> tuple[str, list[str]]:
        return self._emit(len(self.held))


GUARDED = "run_id string, seq long, text string, rules string"


def guard_fragments(fragments: DataFrame) -> DataFrame:
    """(run_id, seq, text, rules): what each fragment lets through; a run's last one flushes.

    ``fragments``: run_id, seq, text, last.
    """

    def step(guard: FragmentGuard, rows: dict) -> tuple:
        return _guarded(guard, rows)

    rows = fragments.select(F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), "text", "last")
    return scan_groups(rows, ["run_id"], ["seq"], FragmentGuard, step, GUARDED)


def _guarded(guard: FragmentGuard, rows) -> tuple:
    texts, rules = [], []
    for text, last in zip(rows["text"], rows["last"]):
        shown, hits = guard.feed(text or "")
        if last:
            rest, more = guard.flush()
            shown, hits = shown + rest, hits + more
        texts.append(shown)
        rules.append(",".join(hits))
    return rows["run_id"], rows["seq"], texts, rules


def guard_fragments_stream(fragments: DataFrame) -> DataFrame:
    """Same guard on a stream; the state of a run is the text held back."""
    rows = fragments.select(F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), "text", "last")

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = FragmentGuard(state.get[0] if state.exists else "")
        part = pd.concat(list(batches)).sort_values("seq")
        out = pd.DataFrame(dict(zip(["run_id", "seq", "text", "rules"], _guarded(guard, part))))
        if part["last"].any():
            state.remove() if state.exists else None
        else:
            state.update((guard.held,))
        yield out

    return rows.groupBy("run_id").applyInPandasWithState(judge, GUARDED, "held string", "append", GroupStateTimeout.NoTimeout)


def cached_answers_stream(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Questions of a stream answered from a table of cached answers by exact question and scope."""
    return questions.join(entries.select("scope_key", "question_norm", "entry_id", "answer"), ["scope_key", "question_norm"], "left")


def run_periodically(source: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One pass of a batch job over what arrived since the last pass; an outside scheduler starts it."""
    return source.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
