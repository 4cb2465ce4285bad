"""Byte-level BPE by recursive SQL: DuckDB runs inside each partition, Spark deals the partitions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from docweave.llm.tokens import joined, pre_tokens, slices, text_of, units

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Token rows that one recursive query starts from, unless a single pre-token has more.
START_ROWS = 1_000_000
#: Distinct pre-tokens a worker remembers between batches.
REMEMBERED = 600_000

#: ``step`` holds the tokens of unfinished words in order; places ``p`` run on from word to word, so that one ordered scan finds
#: the next token. Each round finds the leftmost pair of least rank of every word by a join with ``merges`` and contracts it;
#: a word without such a pair is done.
CONTRACT = """
with recursive step(w, p, t, done) as (
  select w, p, t, false from start
  union all
  select * from (
    with pairs as (select w, p, t, case when lead(w) over line = w then lead(t) over line end as nt, lead(p) over line as np from step where not done window line as (order by p)),
    ranked as (select w, p, t, np, m.r * 4294967296 + p as k from pairs left join merges m on m.pair = pairs.t * 4294967296 + pairs.nt),
    best as (select w, min(k) as k, arg_min(np, k) as bn from ranked group by w)
    select ranked.w, ranked.p, case when ranked.k = best.k then (best.k // 4294967296)::integer else ranked.t end, best.k is null
    from ranked join best using (w) where best.bn is null or ranked.p <> best.bn))
select w, list(t order by p) as ids from step where done group by w order by w
"""
#: Bytes of the tokens put together in order.
DECODE = "select c.w, unhex(string_agg(v.bytes, '' order by c.p)) as text from coded c join vocabulary v using (t) group by c.w order by c.w"


class Coder:
    """The ranks of one file as DuckDB tables, and the words already contracted."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*rows))
        self.fill("merges", pa.table({"pair": (a.to_numpy().astype(np.int64) << 32) + b.to_numpy(), "r": r}))
        self.fill("vocabulary", pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.hex() for t in self.ranks]}))
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def fill(self, name: str, rows: pa.Table) -> None:
        self.sql.register("incoming", rows)
        self.sql.execute(f"create or replace table {name} as select * from incoming")
        self.sql.unregister("incoming")

    def tokens(self, words: list[bytes]) -> pa.LargeListArray:
        """Ids of each word; a word that is a token is that token, as in the library."""
        held = [self.ranks.get(w) for w in words]
        todo = [i for i, t in enumerate(held) if t is None]
        sizes = np.array([len(words[i]) for i in todo], np.int64)
        ends, lo = np.cumsum(sizes), 0
        own = pa.array([t for t in held if t is not None], pa.int32())
        lists, order = [pa.LargeListArray.from_arrays(np.arange(len(own) + 1), own)], [i for i, t in enumerate(held) if t is not None]
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + START_ROWS, "right")))
            some, n = todo[lo:hi], sizes[lo:hi]
            flat = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
            self.fill("start", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "t": self.byte[flat], "p": np.arange(len(flat), dtype=np.int64)}))
            # a word without a byte has no rows
            found = self.sql.sql(CONTRACT).to_arrow_table()
            lists += [x.cast(pa.large_list(pa.int32())) for x in found["ids"].chunks]
            order += [some[w] for w in found["w"].to_pylist()]
            lo = hi
        at = np.full(len(words), -1, np.int64)
        at[order] = np.arange(len(order))
        return pa.chunked_array(lists).combine_chunks().take(pa.array(at, mask=at < 0))

    def decoded(self, ids: pa.LargeListArray) -> list[bytes]:
        """The bytes of each list of ids."""
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        flat = ids.flatten()
        self.fill("coded", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": np.arange(len(flat)), "t": flat}))
        found = self.sql.sql(DECODE).to_arrow_table()
        out = [b""] * len(ids)
        for w, text in zip(found["w"].to_pylist(), found["text"].to_pylist()):
            out[w] = text
        return out

    def coded(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each pre-token."""
        known = self.known
        if len(known) > REMEMBERED:
            # those met again now stay
            self.known = known = {w: known[w] for w in words if w in known}
        new = [w for w in words if w not in known]
        if new:
            ids = self.tokens([w.encode() for w in new])
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), 4 * np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            lo = 0
            for w, hi, text in zip(new, ends.tolist(), self.decoded(ids)):
                known[w] = (flat[lo:hi], text)
                lo = hi
        return [known[w] for w in words]


_coders: dict[str, Coder] = {}


def encode_decode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and ``ids`` (array of int) if asked for.

    In each scan split, the distinct pre-tokens of a block of texts (up to 32 MB) become token-position
    rows, which a recursive query contracts with the merge table to a fixpoint; an ordered
    aggregation turns their ids back to bytes. Texts are then put together from their pre-tokens.
    Nothing is shuffled, and a lost task repeats its own split. A pre-token of n bytes takes up to n
    rounds over its own rows, so one of many thousand letters without a break is slow, but right.

    A null text is empty (0 ids); null keys stay null; repeated rows give a row each; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _coders:
            _coders[ranks] = Coder(ranks)
        coder = _coders[ranks]
        for batch in slices(batches):
            cut = units(text_of(batch))
            parts = pre_tokens(cut.words, coder.find, str)
            coded = coder.coded(parts.words)
            out = []
            for which in (0, 1):
                flat, at = joined([c[which] for c in coded], parts.codes)
                of_unit = [bytes(flat[a:b]) for a, b in zip(at[parts.bounds[:-1]].tolist(), at[parts.bounds[1:]].tolist())]
                data, starts = joined(of_unit, cut.codes)
                out.append([data[a:b] for a, b in zip(starts[cut.bounds[:-1]].tolist(), starts[cut.bounds[1:]].tolist())])
            ids, texts = out
            cols = [batch["doc_id"].cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    schema = SCHEMA + ", ids array<int>" * keep_ids
    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, schema)
