"""Listing and removing paths on whatever file system the cluster uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a pattern, in name order."""
    target, fs = _fs(spark, pattern)
    found = fs.globStatus(target)
    return sorted(str(s.getPath().toString()) for s in found) if found is not None else []


def create(spark: SparkSession, path: str) -> None:
    """An empty file that must not exist yet: one step on file systems and object stores alike."""
    target, fs = _fs(spark, path)
    fs.create(target, False).close()


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _fs(spark, path)
    fs.delete(target, True)
