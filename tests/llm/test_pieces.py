"""Sentencepiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from docweave.llm import pieces, queries

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnoprstuvw     \n\t▁éü日本語的ﬁ0123456789.,<>/sS​🙂\x00́"
    words = [p.replace("▁", " ") for p in pieces.piece_model(PATH).names]
    out = ["", " ", "  ", "▁", "▁ ", " ▁x", "x▁ y", "a", " a", "a ", "a\nb", "<s> </s> <unk> <0x41>", "ab" * 3000, "x" * 20_000, " " * 1000, "the" * 2000, "日" * 500, "\r\n" * 50, "word " * 20_000]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(700)]
    return out + ["".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(700)]


def test_ids_and_texts_are_the_library_s(spark, library):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "no id", "x", 1), (7, None, "x", 1), (7, " again", "x", 1), (7, " again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(5)
    got = pieces.encode_decode(docs, PATH, keep_ids=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], key=str) == sorted(want, key=str)
    assert all(len(r.ids) == r.n_tokens for r in got)
    back = pieces.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((r.doc_id, library.decode(r.ids)) for r in got if r.doc_id is not None)
    assert pieces.encode_decode(docs.filter("false"), PATH).count() == 0


def test_any_ids_decode_as_in_the_library(spark, library):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randrange(32_000), rng.randrange(300)]) for _ in range(rng.randrange(12))] for _ in range(1500)]
    rows = [(i, x, "clash") for i, x in enumerate(lists)] + [(None, [], "x"), (-1, None, "x")]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, text string"), PATH).collect()
    assert {r.doc_id: r.text for r in got} == {i: library.decode(x or []) for i, x, _ in rows}


def test_compatible_pairs_are_those_that_stay_apart(library):
    model, rng = pieces.piece_model(PATH), random.Random(3)
    for _ in range(4000):
        a, b = rng.randrange(len(model.names)), rng.randrange(len(model.names))
        if rng.random() < 0.5:
            whole = model.names[a]
            cut = rng.randrange(1, len(whole)) if len(whole) > 1 else 0
            a, b = model.matches.get(whole[:cut], a) if cut else a, model.matches.get(whole[cut:], b)
        parts, _ = pieces.merged(model.names[a] + model.names[b], model.scores)
        assert model.compatible(a, b) == (parts == [model.names[a], model.names[b]])


def test_units_come_together_to_the_text(monkeypatch):
    some = [*texts(), "trailing  ", "\n  \n"]
    codes, bounds, units = pieces.spaced_units(pa.array(some, pa.large_string()))
    for i, t in enumerate(some):
        assert "".join(units[c] for c in codes[bounds[i]:bounds[i + 1]]) == ("▁" + t.replace(" ", "▁") if t else "")
    empty = pieces.spaced_units(pa.array([], pa.large_string()))
    assert len(empty[0]) == 0 and empty[1].tolist() == [0]
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 3)
    model = pieces.PieceModel(PATH)
    assert [model.unit_ids(u) for u in units] == [pieces.piece_model(PATH).unit_ids(u) for u in units]


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.PieceModel(str(tmp_path / "none.model"))


def test_query_reads_the_whole_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_tokens for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()} == {1: 4, 2: 2}
