"""How filters of documents interact: their failures counted by one stream that takes back what smaller ids overtake."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from docweave.llm.shards import shared_folder
from docweave.operators.sizing import broadcast_if_small

FILTERS = "ABCDE"
REPEATED, GOOD, TOXIC = 16, 32, 64
#: Micro-batches that a table's files are dealt to, texts that share one entry of the state store, groups of rows that need no state.
BATCHES, TEXTS_PER_CELL, FREE_CELLS = 4, 32, 64
COUNTED = "part string, code int, n long"
REPORT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text fails (C: capitals against code points)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def least_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text in a block of rows only its least id needs the state; the others fail E whatever comes, and are counted at once."""
    for pdf in batches:
        least = pdf.groupby("seen")["doc_id"].transform("min")
        free = pdf["doc_id"].isna() | (pdf["doc_id"] > least)
        code = pdf["code"] + REPEATED * (pdf["doc_id"] > least)
        counted = pdf[free].assign(code=code[free]).groupby(["part", "code"], as_index=False).size()
        spread = [-1 - zlib.crc32(f"{c} {p}".encode("utf-8", "surrogatepass")) % FREE_CELLS for p, c in zip(counted["part"], counted["code"].tolist())]
        yield pd.DataFrame({"cell": spread, "seen": None, "doc_id": 0, "part": counted["part"], "code": counted["code"], "n": counted["size"]})
        yield pdf[~free].groupby(["cell", "seen", "doc_id", "part", "code"], as_index=False).size().rename(columns={"size": "n"})


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps, for each text of a cell, its least id and how many rows of what part and failures have it; yields changes of the counters."""
    held = pickle.loads(state.get[0]) if state.exists else {}
    counts: Counter = Counter()
    for pdf in batches:
        for text, doc, part, code, n in zip(pdf["seen"], pdf["doc_id"].tolist(), pdf["part"], pdf["code"].tolist(), pdf["n"].tolist()):
            if text is None:
                counts[part, code] += n
                continue
            least, rows = held.get(text) or (doc, {})
            if doc > least:
                counts[part, code + REPEATED] += n
                continue
            if doc < least:
                for (p, c), times in rows.items():
                    counts[p, c] -= times
                    counts[p, c + REPEATED] += times
                rows = {}
            rows[part, code] = rows.get((part, code), 0) + n
            held[text] = (doc, rows)
            counts[part, code] += n
    if key[0] >= 0:
        state.update((pickle.dumps(held),))
    yield pd.DataFrame({"part": [p for p, _ in counts], "code": [c for _, c in counts], "n": list(counts.values())})


def failure_counters(spark: SparkSession, documents: str, labels: DataFrame, folder: str, key: str = "doc_id", text: str = "text", part: str = "source",
                     batches: int = BATCHES) -> DataFrame:
    """(part, code, n): how many documents of each part fail which filters (bits of ``FILTERS``), are good (32) and toxic (64).

    Reads the Parquet files of ``documents`` as a stream, in about ``batches`` micro-batches that end when all files
    there are read. ``folder`` keeps the stream's progress, its state and one small table of changes per
    micro-batch; called again with the same folder, only new files are read, and a run that was cut off goes on.
    A micro-batch that is repeated writes its changes over itself. The state holds 16 bytes of a text's hash,
    its least id and the failures of the rows with that id; texts are hashed to cells of about ``TEXTS_PER_CELL``,
    so that one entry serves many texts, and a text that very many rows share reaches it once per block and task. The
    session's state store provider holds it: the default one in the executors' memory, about a fiftieth of the texts' size, RocksDB on their disks.
    """
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"):
        session.conf.set(name, spark.conf.get(name))
    table = session.read.parquet(documents)
    plan, inputs, where = f"{folder}/plan", table.inputFiles(), documents.rstrip("/")
    if [x.rsplit("/", 1)[1] for x in inputs] == [where.rsplit("/", 1)[-1]]:
        where = f"{where[:-1]}[{where[-1]}]"  # a stream reads a folder or a pattern, here one that means this file
    first = session.range(1).select(F.lit(max(1, table.count() // TEXTS_PER_CELL)).cast("long").alias("cells"), F.lit(max(1, -(-len(inputs) // batches))).alias("files"))
    first.write.mode("ignore").parquet(plan)
    cells, files = session.read.parquet(plan).first()
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))) * GOOD + F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))) * TOXIC).alias("marks"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = session.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(where).select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("seen"), failures(body).alias("code"))
    marked = rows.join(broadcast_if_small(marks), "doc_id", "left").select(
        F.pmod(F.xxhash64("seen"), F.lit(cells)).alias("cell"), "seen", "doc_id", "part", (F.col("code") + F.coalesce("marks", F.lit(0))).cast("int").alias("code"))
    changes = marked.mapInPandas(least_ids, "cell long, seen binary, doc_id long, part string, code int, n long").groupBy("cell").applyInPandasWithState(
        fold, COUNTED, "held binary", "update", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "code").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    stream = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    # an empty table of changes stands for a stream without a micro-batch
    session.createDataFrame([], COUNTED).write.mode("overwrite").parquet(f"{folder}/counters/batch=-1")
    return spark.read.schema(COUNTED).parquet(*[f"{folder}/counters/batch=*"]).groupBy("part", "code").agg(F.sum("n").alias("n"))


def positions() -> list[tuple[int, int, str, int]]:
    """(filter, filters before it, order, step) for all orders of the filters; filters are bits."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [(bit[f], sum(bit[x] for x in order[:i]), "".join(order), i + 1) for order in permutations(FILTERS) for i, f in enumerate(order)]


def interaction_report(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters of ``failure_counters``.

    A filter's figures depend on the set of filters before it only, so the 80 pairs of filter and set are counted and
    then spread over the 600 places of the 120 orders. ``shapley`` weighs each set by its number of orders.
    """
    of = lambda f, before: (F.lit(f).alias("f"), F.lit(before).alias("before"), F.lit(factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count())).alias("orders"))
    sets = F.array(*[F.struct(*of(f, before)) for f, before in sorted({x[:2] for x in positions()})])
    n, fails, mask = F.col("n"), (F.col("code").bitwiseAND(F.col("f")) != 0), F.col("code").bitwiseAND(F.lit(31))
    gone = F.col("code").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    total = lambda on, x=n: F.coalesce(F.sum(F.when(on, x)), F.lit(0)).cast("long")
    counted = counters.select("part", "code", "n", F.explode(sets).alias("s")).select("part", "code", "n", "s.*").groupBy("part", "f", "before", "orders").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"), total(mask == F.col("f")).alias("unique_fails"),
        total(removed & (F.col("code").bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"), total(removed & (F.col("code").bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"))
    shares = counted.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    places = counters.sparkSession.createDataFrame(positions(), "f int, before int, filter_order string, step int")  # 600 rows
    return counted.join(F.broadcast(places), ["f", "before"]).join(shares, ["part", "f"]).select(*REPORT)


def filter_audit(spark: SparkSession, documents: str, labels: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The report on the filters A (under 200 words), B (under half of the words distinct), C (over 2 % capitals), D (holds any of #$%&*|) and E
    (same text as a smaller id), for all documents by part, in all orders.

    Per part, order and step: documents kept after it, removed by it, failing it but removed before (redundant), failing it
    alone (unique_fails), removed though labelled good or toxic, and its removals over all orders (shapley).

    A null text is empty, a null part is the empty string. A null id fails E never and makes no other fail; rows of one id and text don't
    make each other fail; repeated rows count each; of several labels of an id the largest hold; a table without rows gives no rows; other columns are not read.
    """
    folder = folder or shared_folder(spark).replace("shards-", "audit-")
    return interaction_report(failure_counters(spark, documents, labels, folder, key, text, part))
