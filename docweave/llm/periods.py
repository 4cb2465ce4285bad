"""Stretches of words that repeat with a period: a sparse dynamic program on the diagonals of a text against itself."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docweave.llm.tokens import slices, text_of

#: Bytes of text in memory at once; a slice of more than one row has fewer than 2 ** 21 words.
SLICE_BYTES = 4_000_000
REPEATS, SHORTEST = 4, 6
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "n_words long, n_dropped long")


class Words(NamedTuple):
    """``codes[bounds[i]:bounds[i + 1]]`` are the words of text i, as places in ``names``."""

    codes: np.ndarray
    bounds: np.ndarray
    names: pa.Array


class Runs(NamedTuple):
    """Text, first word (in the text), number of words and smallest period of each run, by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def words_of(texts: pa.Array) -> Words:
    cut = pc.ascii_split_whitespace(texts)
    offsets = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.flatten()
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), before[offsets - offsets[0]], coded.dictionary)


def planted(words: Words, ids: list) -> np.ndarray:
    """The codes with the repetitions that the contract puts into texts whose hashed id ends in 0; a null id puts in none."""
    codes = words.codes.copy()
    for i, doc in enumerate(ids):
        lo, n = int(words.bounds[i]), int(words.bounds[i + 1] - words.bounds[i])
        if doc is None or not n:
            continue
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            codes[lo + a:lo + n] = words.codes[lo + a + np.arange(n - a) % p]
    return codes


def pair_ids(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, below their count."""
    return np.unique((one.astype(np.uint64) << np.uint64(32)) | two.astype(np.uint64), return_inverse=True)[1].astype(np.int64)


def earlier(gram: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For grams ending at the places ``at`` (ascending): distance to the nearest earlier one in the same text (0: none), and whether one is met again at all."""
    order = np.argsort(gram, kind="stable")
    same = (gram[order[1:]] == gram[order[:-1]]) & (text[at[order[1:]]] == text[at[order[:-1]]])
    lag, again = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return lag, again


def diagonals(at: np.ndarray, lag: np.ndarray, text: np.ndarray, words: int, low: int, high: int, start: np.ndarray) -> list[np.ndarray]:
    """Runs whose period is in ``low`` .. ``high`` - 1, from the nearest earlier grams of ``words`` words.

    A cell (place, lag) goes on from (place - 1, lag) with one match more; the first cell of a diagonal has
    ``words`` matches. A diagonal whose next cell is missing has ended, and gives a run if it is long enough.
    """
    on = (lag >= low) & (lag < high)
    at, lag = at[on], lag[on]
    if not len(at):
        return []
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (at[1:] == at[:-1] + 1) & (lag[1:] == lag[:-1]) & (text[at[1:]] == text[at[:-1]])
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(at)) - 1
    matches = words + at[last] - at[first]
    period = lag[first]
    length = matches + period
    enough = length >= np.maximum(SHORTEST, REPEATS * period)
    begin, of = (at[last] - length + 1)[enough], text[at[last][enough]]
    return [of, begin - start[of], length[enough], period[enough]]


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> Runs:
    """All runs of some texts.

    In a run of period q and at least four times that length, 3q words in a row equal the word q before
    them. Lags are taken in classes c .. 3c/2 - 1 and 3c/2 .. 2c - 1 with grams of 3c and 4c words: those fit into the
    3q matches, and are at least as long as the sum of any two lags up to their class's, so that by the theorem of Fine and
    Wilf only the nearest earlier gram can lie one smallest period back. So each place has one cell per class rather than
    one for every earlier occurrence of its word, and only places whose grams come again are looked at in the next class.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = bounds[:-1]
    found: list[list[np.ndarray]] = []
    at = np.arange(2, n)
    at = at[text[at] == text[at - 2]] if n > 2 else np.empty(0, np.int64)
    gram = np.zeros(n, np.int64)
    if len(at):
        if codes.max() < 2 ** 21:
            gram[at] = codes[at - 2] << 42 | codes[at - 1] << 21 | codes[at]
        else:
            gram[at] = pair_ids(pair_ids(codes[at - 2], codes[at - 1]), codes[at])
    alive, c = np.zeros(n, bool), 1
    while len(at):
        lag, again = earlier(gram[at], at, text)
        found.append(diagonals(at, lag, text, 3 * c, c, -(-3 * c // 2), start))
        at = at[again]
        gram[at] = np.unique(gram[at], return_inverse=True)[1]
        alive[:] = False
        alive[at] = True
        if c > 1:
            four = at[at >= c]
            four = four[alive[four - c] & (text[four] == text[four - c])]
            if len(four):
                lag, _ = earlier(pair_ids(gram[four - c], gram[four]), four, text)
                found.append(diagonals(four, lag, text, 4 * c, 3 * c // 2, 2 * c, start))
        at = at[at >= 3 * c]
        at = at[alive[at - 3 * c] & (text[at] == text[at - 3 * c])]
        if len(at):
            gram[at] = pair_ids(gram[at - 3 * c], gram[at])
        c *= 2
    found = [x for x in found if x]
    if not found:
        return Runs(*(np.empty(0, np.int64) for _ in range(4)))
    all_ = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((all_[3], all_[1], all_[0]))
    return Runs(*(x[order] for x in all_))


def dropped_words(runs: Runs, bounds: np.ndarray) -> np.ndarray:
    """True for every word in a run behind the run's first period."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    first = bounds[runs.text] + runs.start
    np.add.at(edge, first + runs.period, 1)
    np.add.at(edge, first + runs.length, -1)
    return np.cumsum(edge)[:-1] > 0


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """The periodic runs of every whole text, a row per row.

    Words are separated by ASCII white space and numbered from 0. A run is a stretch of words with smallest
    period q, at least ``SHORTEST`` words and ``REPEATS`` x q words long, that can't be longer with that period. Per row:
    ``n_runs``; ``start, length, period, exponent_milli`` of the longest (then first, then of least period; null without a
    run); ``runs_sha256`` of all runs as lines ``start,length,period``; ``collapsed_sha256`` of the text without the words
    that lie in a run behind its first q words, joined by spaces; ``n_words``, ``n_dropped``. With ``keep`` also ``runs``
    and the collapsed text itself. With ``plant``, texts whose hashed id ends in 0 are made periodic first, as op13's contract says.

    Nothing is shuffled; a task holds 4 MB of texts or one text, and needs time and memory in proportion to
    their words times the logarithm of the longest period, however often one word is said.

    A null text has no words; a null id stays null and plants nothing; repeated rows give a row each; an empty
    table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            words = words_of(text_of(batch))
            codes = planted(words, batch["doc_id"].to_pylist()) if plant else words.codes
            runs = find_runs(codes, words.bounds)
            gone = dropped_words(runs, words.bounds)
            kept = np.concatenate([[0], np.cumsum(~gone)])[words.bounds]
            told = words.names.take(pa.array(codes[~gone]))
            lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), told.cast(pa.large_string()))
            collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            at = np.searchsorted(runs.text, np.arange(len(batch) + 1))
            best = np.lexsort((runs.period, runs.start, -runs.length, runs.text))
            has = np.diff(at) > 0
            top = best[at[:-1][has]]
            columns = []
            for values in (runs.start, runs.length, runs.period, 1000 * runs.length // np.maximum(runs.period, 1)):
                whole = np.zeros(len(batch), np.int64)
                whole[has] = values[top]
                columns.append(pa.array(whole, mask=~has))
            rows = list(zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist()))
            each = [rows[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            told_runs = pa.array([sha("".join(f"{s},{n},{q}\n" for s, n, q in x).encode()) for x in each], pa.string())
            out = [batch["doc_id"], pa.array(np.diff(at).astype(np.int64)), *columns, told_runs, pa.array([sha(x.as_buffer() or b"") for x in collapsed], pa.string()),
                   pa.array(np.diff(words.bounds)), pa.array(np.diff(words.bounds) - np.diff(kept))]
            if keep:
                fields = ("start", "length", "period")
                out += [pa.array([[dict(zip(fields, r)) for r in x] for x in each], pa.list_(pa.struct([(f, pa.int64()) for f in fields]))), collapsed.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in SCHEMA.split(", ")] + ["runs", "collapsed"] * keep)

    schema = SCHEMA + ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * keep
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, schema)
