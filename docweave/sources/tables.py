"""Parquet tables of one data folder, with timestamps in a form streams accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


TEXT_TABLES = {"documents", "pages", "conversations"}


class Tables:
    """``Tables(spark, folder).documents`` reads ``folder/documents.parquet`` lazily.

    ``timestamp_ntz`` columns are cast to ``timestamp`` (session zone UTC) because
    watermarks and retention cut-offs need an instant.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXT_TABLES:
            df = self.spread(df)
        local = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df

    def spread(self, scan: DataFrame) -> DataFrame:
        """A scan of fewer splits than cores is dealt over all cores; larger ones are left alone.

        Splitting and tokenising texts is CPU work, so one small file must not be one task.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
