"""Documents packed into sequences of bounded size by vector bin packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docweave.llm.tokens import WORD_PATTERN, LibraryTokenizer, encoded_texts, library_tokenizer, parts, slices, text_of

#: Bytes of text that a worker encodes at once.
CODED_BYTES = 8_000_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "segment int, loss_tokens long")


class Limits(NamedTuple):
    """What one sequence may hold at most; ``least_cut`` is the smallest gap filled by cutting an example."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    least_cut: int = 16


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length); every token of an example lies in one piece.

    ``loss[i]`` counts the loss-bearing tokens of example i, which are its last ones. Whole
    sequences are cut off long examples first. Then one sequence at a time is filled: of the
    examples that fit, the one with the largest dot product of its (tokens, segment, loss)
    vector with the room that is left, all as shares of the limits; ties go to the first.
    If none fits and the gap is worth it, the best one is cut to the gap. The last sequence
    is split into powers of two, which need no padding.
    """
    tokens, loss = tokens.astype(np.int64), np.minimum(loss, tokens).astype(np.int64)
    at, left = np.zeros(len(tokens), np.int64), tokens.copy()

    def bearing(start, length):
        """Loss-bearing tokens of a piece."""
        return np.maximum(0, np.minimum(length, start + length - (tokens - loss)))

    whole = min(limits.tokens, limits.loss)
    for i in np.flatnonzero(tokens >= whole).tolist():
        while left[i] >= whole:
            yield [(i, int(at[i]), whole)]
            at[i] += whole
            left[i] -= whole
    open_ = np.flatnonzero(left > 0)
    full = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    while len(open_):
        bin_, room = [], full.copy()
        size = np.stack([left[open_], np.ones(len(open_), np.int64), bearing(at, left)[open_]], 1).astype(np.float64)
        score_base = size / full
        live = np.ones(len(open_), bool)
        while room[0] > 0 and room[1] > 0 and live.any():
            fits = live & (size <= room).all(axis=1)
            if fits.any():
                best = int(np.where(fits, score_base @ (room / full), -1).argmax())
                i = int(open_[best])
                bin_.append((i, int(at[i]), int(left[i])))
                room -= size[best]
                at[i] += left[i]
                left[i] = 0
            else:
                gap = int(min(room[0], room[2]))
                if gap < limits.least_cut or gap <= 0:
                    break
                best = int(np.where(live & (left[open_] > gap), score_base @ (room / full), -1).argmax())
                i = int(open_[best])
                if not live[best] or left[i] <= gap:
                    break
                bin_.append((i, int(at[i]), gap))
                room -= [gap, 1, int(bearing(at, np.full_like(at, gap))[i])]
                at[i] += gap
                left[i] -= gap
            live[best] = False
        open_ = open_[left[open_] > 0]
        if len(open_):
            yield bin_
        else:
            yield from powers(bin_)


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of one sequence dealt over sequences whose sizes are falling powers of two."""
    total = sum(n for _, _, n in pieces)
    queue = list(pieces)
    while total:
        size, out = 1 << (total.bit_length() - 1), []
        total -= size
        while size:
            i, start, n = queue.pop(0)
            take = min(n, size)
            out.append((i, start, take))
            if take < n:
                queue.insert(0, (i, start + take, n - take))
            size -= take
        yield out


def ended_ids(batch: pa.RecordBatch, coder: LibraryTokenizer, end_id: int) -> list[bytes]:
    """The ids of each text with ``end_id``; only a few texts at a time are held in pieces, as those take many times their bytes."""
    tail, out = np.array([end_id], "<u4").tobytes(), []
    for part in parts(batch, most=CODED_BYTES):
        data, starts = encoded_texts(text_of(part), coder)
        out += [bytes(data[a:b]) + tail for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    return out


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, key: str = "doc_id", text: str = "text",
                   loss_start: str | None = None, pattern: str = WORD_PATTERN, lower: bool = True, window: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens.

    The ids of a text end with ``end_id``. ``loss_start`` names a column with the number of
    leading ids that bear no loss (a prompt); without it all do. Every task packs windows
    of ``window`` documents of its own scan split, so nothing is shuffled, memory is that of a
    window, and a lost task is packed again alike. ``sequence_id`` is the split's number times
    2^33 plus a counter.

    A null text is empty and packs its end id alone; null keys stay null; repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_tokenizer(tokenizer, pattern, lower)
        sequence = TaskContext.get().partitionId() << 33
        for piece in slices(batches):
            for batch in (piece.slice(i, window) for i in range(0, len(piece), window)):
                ids = ended_ids(batch, coder, end_id)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                free = batch["free"].fill_null(0).to_numpy(zero_copy_only=False)
                loss = np.clip(n - free, 0, n)
                names = batch["doc_id"].to_pylist()
                out = []
                for pieces in pack(n, loss, limits):
                    offset = 0
                    for place, (i, start, length) in enumerate(pieces):
                        bears = max(0, min(length, start + length - int(n[i] - loss[i])))
                        out.append((names[i], start, length, zlib.crc32(ids[i][4 * start:4 * (start + length)]), int(n[i]), sequence, offset, place, bears))
                        offset += length
                    sequence += 1
                cols = list(zip(*out)) or [[]] * 9
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    free = f"cast(`{loss_start}` as long)" if loss_start else "cast(0 as long)"
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text", f"{free} free").mapInArrow(run, SCHEMA)
