"""A folder of files as documents, chunks and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.functions import rules
from docweave.operators.chunking import chunk_documents, strategy_of
from docweave.sources.files import Parser, extension_of, read_folder


def ingest(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None, size: int = 512,
           overlap: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, errors). Documents carry rule-made type, domain, topics and grade.

    Nothing is written: publish by writing to a new place and switching once.
    """
    texts, errors = read_folder(spark, path, parsers)
    docs = texts.withColumn("doc_id", F.concat_ws("#", "path", "part"))
    quality = rules.quality_of(F.col("text"))
    labelled = docs.withColumn("c", rules.classify_document(F.col("text"))).select(
        "doc_id", "path", "part", "text", "c.document_type", "c.domain", "c.topics",
        quality["overall_score"].alias("quality_score"), quality["overall_grade"].alias("quality_grade"))
    chunks = chunk_documents(docs, "doc_id", strategy=strategy_of(F.col("path")), extension=extension_of(F.col("path")), size=size, overlap=overlap)
    return labelled, chunks, errors
