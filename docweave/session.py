"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Shuffle partitions of a small table that go to one file.
SHARED = 16


def build_session(app: str = "docweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on (UTC clock, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame, small: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    A task writes a file, and for each file on a local disk Hadoop without its native library starts processes that set
    the mode. So a ``small`` table (groups, links: a light last stage and narrow rows) is written by one task
    for ``SHARED`` shuffle partitions, but by no fewer than there are cores.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests)
    is a folder of our own used; on a cluster a missing setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    if small:
        df = df.coalesce(max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARED))
    return df.checkpoint(eager=True)
