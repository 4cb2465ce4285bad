"""Counts, byte-level BPE, packing and shards against the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from docweave.llm import bpe, counts, packing, shards
from docweave.llm.tokens import WORD_PATTERN

TEXTS = ["", None, "a", " a", "a ", "  two  spaces ", "tab\t x y", "line\n\nline \n end", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "it's DON'T we'll 's",
         "Ünïcode ß 日本語のテキスト 🙂🙂 é İ", "x" * 3000, "word " * 5000, "1234 56,78 %%%*** ...", "same text", "same text", "\x1c \x85   z", "ﬁ ½ ²³"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", -1, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "n", -1, "clash"), (3, " a", "n", -1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, unit int, sequence_id string")


def empty(docs):
    return docs.filter("false")


@pytest.mark.parametrize("name, pattern, lower", [("byte_bpe_50k.json", P.PATTERN, False), ("word_bpe_49k.json", WORD_PATTERN, True)])
def test_counts_are_the_library_s(docs, name, pattern, lower):
    got = counts.token_counts(docs, P.path(name), limit=100, pattern=pattern, lower=lower).collect()
    library = Tokenizer.from_file(P.path(name))
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order([(r.doc_id, r.n_bytes, r.n_tokens) for r in got]) == order(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert counts.token_counts(empty(docs), P.path(name)).count() == 0


def test_bpe_ids_and_bytes_are_the_library_s(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs, path, keep_ids=True).collect()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], key=str) == sorted(want, key=str)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_decode(empty(docs), path).count() == 0


def test_pieces_cover_every_id_once(docs):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for doc, pieces in by_doc.items():
        ids = np.array(library.encode(TEXTS[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda x: x.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda x: x.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_packing_keeps_every_limit_and_pads_little():
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(1, 900, 600), [5000, 4096, 2048]])
    loss = (tokens * rng.random(len(tokens))).astype(int)
    limits = packing.Limits(tokens=2048, segments=6, loss=1200, least_cut=16)
    held = np.zeros((len(tokens), tokens.max()), int)
    sums = []
    for pieces in packing.pack(tokens, loss, limits):
        assert len(pieces) <= 6 and sum(n for _, _, n in pieces) <= 2048
        bears = 0
        for i, start, n in pieces:
            held[i, start:start + n] += 1
            bears += sum(1 for x in range(start, start + n) if x >= tokens[i] - loss[i])
        assert bears <= 1200
        sums.append(sum(n for _, _, n in pieces))
    assert all((held[i, :t] == 1).all() and not held[i, t:].any() for i, t in enumerate(tokens))
    one = [sum(n for _, _, n in p) for p in packing.pack(tokens, tokens, packing.Limits())]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in one)
    assert padding < 0.01 * sum(one)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_feistel_is_a_keyed_permutation(size):
    a, b = (shards.feistel(np.arange(size), size, key) for key in (1, 2))
    assert sorted(a.tolist()) == list(range(size)) == sorted(b.tolist())
    if size > 50:
        assert (a != b).any() and (a != np.arange(size)).mean() > 0.9


def test_shards_hold_every_document_at_its_slot(spark, docs, tmp_path):
    path, folder = P.path("byte_bpe_50k.json"), str(tmp_path / "out")
    table = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    rows = shards.write_shards(table, path, P.PATTERN, 50256, folder, length=64, per_shard=10).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) == sorted(r.sequence for r in rows)
    records = list(shards.read_slots(folder, 0, len(rows) + 3, length=64, per_shard=10))
    assert len(records) == len(rows)
    late = list(shards.read_slots(folder, 25, 7, length=64, per_shard=10))
    assert all((x == y).all() for x, y in zip(late, records[25:32]))
    found = {}
    for r in sorted(rows, key=lambda x: x.sequence):
        record = records[r.slot]
        assert zlib.crc32(record.tobytes()) == r.ids_crc32 and r.shard == r.slot // 10 and r.byte_offset == r.slot % 10 * 128
        for d in r.documents:
            found.setdefault(d.doc_id, []).extend(record[d.start:d.start + d.length].tolist())
    library = Tokenizer.from_file(path)
    assert found == {i: library.encode(t or "", add_special_tokens=False).ids + [50256] for i, t in enumerate(TEXTS)}
    again = spark.createDataFrame([(r.slot, r.shard, r.byte_offset, r.ids_crc32) for r in rows], "slot long, shard long, byte_offset long, ids_crc32 long")
    assert shards.check_records(again, folder, length=64).count() == 0
    assert shards.write_shards(empty(docs), path, P.PATTERN, 50256, str(tmp_path / "none")).count() == 0


def test_bpe_keeps_the_words_met_again_when_it_remembers_too_many(monkeypatch):
    coder = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"))
    first = coder.coded(["zqxjk", "vwxyzq", "wqkjz"])
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    contracted, tokens = [], coder.tokens
    monkeypatch.setattr(coder, "tokens", lambda words: contracted.append(list(words)) or tokens(words))
    assert coder.coded(["zqxjk", "qqzzvv", "wqkjz"])[::2] == first[::2]
    assert contracted == [[b"qqzzvv"]] and "vwxyzq" not in coder.known


def test_packing_encodes_a_few_texts_at_a_time(monkeypatch):
    path, seen = P.path("word_bpe_49k.json"), []
    coder = packing.library_tokenizer(path, WORD_PATTERN, True)
    texts = ["one two three", None, "", "four  five", "x" * 50, "six seven"] * 3
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    whole = packing.ended_ids(batch, coder, 1)
    encode = packing.encoded_texts

    def watched(part, coder):
        seen.append(sum(len(x) for x in part.to_pylist()))
        return encode(part, coder)

    monkeypatch.setattr(packing, "encoded_texts", watched)
    monkeypatch.setattr(packing, "CODED_BYTES", 30)
    assert packing.ended_ids(batch, coder, 1) == whole
    assert len(whole) == len(texts) and len(seen) > 3 and all(n <= 30 or n == 50 for n in seen)
