"""Folders of a shared file system, listed and dropped through Spark's own file system client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def numbered(spark: SparkSession, path: str, prefix: str, complete: bool = False) -> list[int]:
    """Numbers of the folders ``<path>/<prefix>=N``, ascending; only those whose write ended if wanted."""
    files, at = _at(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    found = [int(n.removeprefix(f"{prefix}=")) for n in names if n.startswith(f"{prefix}=")]
    if complete:
        mark = spark._jvm.org.apache.hadoop.fs.Path
        found = [n for n in found if files.exists(mark(f"{path}/{prefix}={n}/_SUCCESS"))]
    return sorted(found)


def drop(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
