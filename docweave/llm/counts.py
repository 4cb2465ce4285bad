"""Token counts of whole texts without their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from docweave.llm.tokens import library_tokenizer, pre_tokens, slices, spread, text_of, units

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, pattern: str = PATTERN, lower: bool = False,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Each block of a scan (up to 32 MB of text) makes three tables: per-document
    frequencies (document, unit, n), the pre-tokens of each distinct unit, and the pieces
    of each distinct pre-token, counted once; they are joined on their codes and summed.
    The join stays inside the block, because the frequencies of all documents in a shuffle
    would be larger than the texts; nothing is shuffled and no document's ids are built.

    A null text is empty (0 bytes, 0 tokens); a null key stays null; repeated rows and keys
    give a row each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_tokenizer(tokenizer, pattern, lower)
        for batch in slices(batches):
            texts = text_of(batch)
            cut = units(texts)
            parts = pre_tokens(cut.words, coder.split, coder.whole)
            pieces = np.array([len(x) // 4 for x in coder.encoded(parts.words)], np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(cut.bounds))
            frequencies = pa.table({"doc": doc, "unit": cut.codes}).group_by(["doc", "unit"], use_threads=False).aggregate([([], "count_all")])
            row, member = spread(parts.bounds, frequencies["unit"].to_numpy())
            n = np.bincount(frequencies["doc"].to_numpy()[row], weights=(frequencies["count_all"].to_numpy()[row] * pieces[parts.codes[member]]).astype(np.float64),
                            minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, SCHEMA)
