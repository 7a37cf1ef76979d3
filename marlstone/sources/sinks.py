"""Sinks: JSON lines, appended audit rows, and tables replaced as a whole by versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version-"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_ndjson(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object a line, in as many files as there are partitions."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).text(path)


def stream_rows(rows: DataFrame):
    """Rows one partition at a time, for a caller that can't hold them all."""
    return rows.toLocalIterator(prefetchPartitions=True)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, in order: Spark writes ``_SUCCESS`` when all of a version is there."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    numbers = [int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION)]
    return sorted(n for n in numbers if fs.exists(_fs(spark, f"{path}/{VERSION}{n}/_SUCCESS")[1]))


def write_version(rows: DataFrame, path: str, number: int) -> None:
    """Writes one version; half a version that a crash left under the number is overwritten. Readers
    see the version before until the new one is complete. Two versions are kept, for readers that have begun."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/{VERSION}{number}")
    for old in [n for n in versions(spark, path) if n < number][:-1]:
        fs, p = _fs(spark, f"{path}/{VERSION}{old}")
        fs.delete(p, True)


def read_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (of a number under ``before``), or None."""
    numbers = [n for n in versions(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/{VERSION}{numbers[-1]}") if numbers else None


def replace(rows: DataFrame, path: str) -> None:
    """Makes ``rows`` the newest version of the table at ``path``; they may come from an older one. Read it with ``read_version``."""
    write_version(rows, path, max(versions(rows.sparkSession, path), default=0) + 1)


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key is not there yet: a batch given twice is stored once."""
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    fresh = rows.dropDuplicates([key])
    if fs.exists(target):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.select(*rows.columns).write.mode("append").parquet(path)
