"""Token sequences in a keyed random order, written as shards of fixed stride."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.llm.tokens import encoded_units, library_tokenizer, slices, taken_bytes, text_of, units
from docweave.session import cut_lineage

ROUNDS = 6
#: Write tasks; slots are dealt to them evenly and in order, so no sample is needed to find their edges.
MOST_RANGES = 10_000
SPANS = "array<struct<doc_id: long, start: long, length: long>>"
SCHEMA = f"slot long, sequence long, shard long, byte_offset long, n_tokens long, ids_crc32 long, documents {SPANS}"


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on all bits of ``x`` and ``key``."""
    x = x.astype(np.uint64) + np.uint64(key & (2 ** 64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, applied to ``index``.

    A balanced Feistel network permutes the numbers of the next even bit width; a value that
    falls outside is permuted again until it is inside (cycle-walking), which keeps it a permutation.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right, key * 1_000_003 + r) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors share; one of its own in tests without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir or name a folder every executor can write to")
        top = tempfile.mkdtemp(prefix="spark-shards-")
    return f"{top.rstrip('/')}/shards-{uuid.uuid4().hex}"


def place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_shards(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, folder: str, length: int = 2048, per_shard: int = 4096, seed: int = 20_24,
                 lower: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``folder/shard-<number>.bin`` and returns a row per sequence.

    The ids of the documents of a scan split, each ended by ``end_id``, make one stream, cut into
    sequences of ``length`` ids of two bytes; the last of a split is filled with ``end_id``. A first
    pass counts the sequences of each split, so every sequence has a number, and keeps the ids of
    the split's distinct units in a small file of ``folder``; a keyed permutation of
    the numbers is its slot. Slot s is record s % per_shard of shard s // per_shard, at the byte
    (s % per_shard) * 2 * length, so a reader seeks to any slot and goes on from there. Shards are
    dealt in exact ranges of slots; a task holds one sequence at a time and puts a finished shard in place by
    renaming, so a repeated task writes the same file again. The second pass fails rather than
    number a split that has changed between the passes.

    Rows: slot, sequence, shard, byte_offset, n_tokens (without filling), ids_crc32 (of the record),
    documents (doc_id, start in the sequence, length). Null texts are empty (their end id alone), null keys stay null, repeated rows
    are written each, an empty table writes nothing, other columns are not read.
    """
    spark = docs.sparkSession
    place(folder)[0].create_dir(place(folder)[1], recursive=True)
    rows = docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text")
    per_split = cut_lineage(rows.mapInArrow(_counter(tokenizer, pattern, lower, length, folder), "split long, n long").groupBy("split").agg(F.sum("n").alias("n")))
    counted = {r["split"]: r["n"] for r in per_split.collect()}  # a number for each scan split, none for documents
    first, size = {}, 0
    for split in sorted(counted):
        first[split], size = size, size + counted[split]
    starts = spark.sparkContext.broadcast((first, counted, size))
    pieces = rows.mapInArrow(_cutter(folder, length, end_id, starts, seed), f"slot long, sequence long, n_tokens long, payload binary, documents {SPANS}")
    shards = max(1, -(-size // per_shard))
    ranges = min(shards, MOST_RANGES)
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    dealt = pieces.withColumn("shard", shard).repartitionById(ranges, F.floor(F.col("shard") * ranges / shards).cast("int")).sortWithinPartitions("slot")
    return dealt.mapInArrow(_writer(folder, length, per_shard), SCHEMA)


COUNTED = pa.schema([("ids", pa.large_binary())])


def _counter(tokenizer: str, pattern: str, lower: bool, length: int, folder: str):
    """Counts the sequences of a split and leaves the ids of its units, slice by slice, in a file for the second pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_tokenizer(tokenizer, pattern, lower)
        if coder.tokenizer.get_vocab_size() > 2 ** 16:
            raise ValueError("ids of two bytes need a vocabulary of at most 65,536")
        split, total, (store, top) = TaskContext.get().partitionId(), 0, place(folder)
        name = f"{top}/units-{split:08d}"
        part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
        with store.open_output_stream(part) as out, pa.ipc.new_file(out, COUNTED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as held:
            for batch in slices(batches):
                cut = units(text_of(batch))
                ids = encoded_units(cut.words, coder, "<u2")
                held.write_batch(pa.record_batch([ids], schema=COUNTED))
                total += int(pc.binary_length(ids).to_numpy()[cut.codes].sum()) // 2 + len(batch)
        store.move(part, f"{name}.arrow")
        yield pa.RecordBatch.from_pydict({"split": [split], "n": [-(-total // length)]})

    return run


def _ids(batches: Iterator[pa.RecordBatch], folder: str):
    """(batch, its ids, where each text's begin) from the file of the first pass."""
    store, top = place(folder)
    with store.open_input_file(f"{top}/units-{TaskContext.get().partitionId():08d}.arrow") as f:
        held = pa.ipc.open_file(f)
        for i, batch in enumerate(slices(batches)):
            cut = units(text_of(batch), named=False)
            data, starts = taken_bytes(held.get_batch(i)["ids"], cut.codes)
            yield batch, np.frombuffer(data, "<u2"), starts[cut.bounds] // 2


def _cutter(folder: str, length: int, end_id: int, starts, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, counted, size = starts.value
        split = TaskContext.get().partitionId()
        base, made = first.get(split, 0), 0
        held, held_docs, at = np.empty(0, "<u2"), [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def rows(records: np.ndarray, filled: list[int], documents: list) -> pa.RecordBatch:
            numbers = base + made + np.arange(len(records))
            return pa.RecordBatch.from_arrays(
                [pa.array(feistel(numbers, size, seed)), pa.array(numbers), pa.array(filled, pa.int64()),
                 pa.array([squeeze.compress(r.tobytes()) for r in records], pa.binary()),
                 pa.array(documents, pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])))],
                names=["slot", "sequence", "n_tokens", "payload", "documents"])

        for batch, ids, bounds in _ids(batches, folder):
            n = np.diff(bounds) + 1
            ends = np.cumsum(n)
            stream = np.full(int(n.sum()), end_id, "<u2")
            keep = np.ones(len(stream), bool)
            keep[ends - 1] = False
            stream[keep] = ids
            spans = list(zip(batch["doc_id"].to_pylist(), (ends - n + len(held)).tolist(), n.tolist()))
            stream, spans = np.concatenate([held, stream]), held_docs + spans
            whole = len(stream) // length
            documents: list[list] = [[] for _ in range(whole + 1)]
            for doc, start, count in spans:
                while count:
                    k = start // length
                    take = min(count, (k + 1) * length - start)
                    documents[k].append({"doc_id": doc, "start": start - k * length, "length": take})
                    start, count = start + take, count - take
            if whole:
                yield rows(stream[:whole * length].reshape(whole, length), [length] * whole, documents[:whole])
            made += whole
            held, held_docs = stream[whole * length:], [(d["doc_id"], d["start"], d["length"]) for d in documents[whole]]
        if len(held):
            last = np.full((1, length), end_id, "<u2")
            last[0, :len(held)] = held
            yield rows(last, [len(held)], [[{"doc_id": d, "start": s, "length": c} for d, s, c in held_docs]])
            made += 1
        if made != counted.get(split, 0):
            raise RuntimeError(f"split {split} has {made} sequences now and had {counted.get(split, 0)}: the input changed between two passes")

    return run


def _writer(folder: str, length: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = place(folder)
        store.create_dir(top, recursive=True)
        mark = f"{TaskContext.get().taskAttemptId()}.part"
        squeeze, shard, out = zstandard.ZstdDecompressor(), None, None

        def close():
            if out is not None:
                out.close()
                store.move(f"{top}/shard-{shard:08d}.{mark}", f"{top}/shard-{shard:08d}.bin")

        for batch in batches:
            sums = []
            for number, payload in zip(batch["shard"].to_pylist(), batch["payload"]):
                if number != shard:
                    close()
                    shard, out = number, store.open_output_stream(f"{top}/shard-{number:08d}.{mark}")
                record = squeeze.decompress(payload.as_py(), max_output_size=2 * length)
                out.write(record)
                sums.append(zlib.crc32(record))
            slots = batch["slot"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["slot"], batch["sequence"], batch["shard"], pa.array(slots % per_shard * 2 * length), batch["n_tokens"], pa.array(sums, pa.int64()),
                                              batch["documents"]], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32", "documents"])
        close()

    return run


def read_slots(folder: str, first: int, count: int, length: int = 2048, per_shard: int = 4096) -> Iterator[np.ndarray]:
    """The records of ``count`` slots from ``first`` on, in order: one seek, then sequential reads."""
    store, top = place(folder)
    slot, stop = first, first + count
    while slot < stop:
        with store.open_input_file(f"{top}/shard-{slot // per_shard:08d}.bin") as f:
            f.seek(slot % per_shard * 2 * length)
            for _ in range(min(stop, (slot // per_shard + 1) * per_shard) - slot):
                record = f.read(2 * length)
                if len(record) < 2 * length:
                    return
                yield np.frombuffer(record, "<u2")
                slot += 1


def check_records(rows: DataFrame, folder: str, length: int = 2048) -> DataFrame:
    """``rows`` of write_shards whose record, read from its file, has another checksum (none if all is well)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = place(folder)
        for pdf in frames:
            found = []
            for shard, of in pdf.groupby("shard"):
                with store.open_input_file(f"{top}/shard-{shard:08d}.bin") as f:
                    for row in of.itertuples():
                        f.seek(row.byte_offset)
                        if zlib.crc32(f.read(2 * length)) != row.ids_crc32:
                            found.append(row.Index)
            yield pdf.loc[found]

    cols = "slot long, shard long, byte_offset long, ids_crc32 long"
    return rows.select("slot", "shard", "byte_offset", "ids_crc32").mapInPandas(run, cols)
