"""Folders of the file system that Spark reads, whatever its kind."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, folder: str):
    """(file system, path) of Spark's own Hadoop client."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def folder_there(spark: SparkSession, folder: str) -> bool:
    """True if the folder holds anything but work in progress."""
    return any(not name.startswith((".", "_")) for name in subfolders(spark, folder))


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names in the folder; none if it isn't there."""
    fs, path = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder, in place of ``target`` if that is there."""
    fs, path = _opened(spark, source)
    _, to = _opened(spark, target)
    if fs.exists(to):
        fs.delete(to, True)
    fs.mkdirs(to.getParent())
    if not fs.rename(path, to):
        raise OSError(f"could not rename {source} to {target}")


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _opened(spark, folder)
    fs.delete(path, True)
