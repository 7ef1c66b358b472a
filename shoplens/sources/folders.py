"""Folder names and marker files on any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _at(spark, path)
    return fs.exists(jpath)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Full names of files and folders that fit a pattern, in order."""
    fs, jpath = _at(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(jpath) or [])


def make(spark: SparkSession, path: str) -> None:
    fs, jpath = _at(spark, path)
    fs.mkdirs(jpath)


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file; it is an error if there is one."""
    fs, jpath = _at(spark, path)
    fs.create(jpath, False).close()


def drop(spark: SparkSession, path: str) -> None:
    fs, jpath = _at(spark, path)
    fs.delete(jpath, True)
