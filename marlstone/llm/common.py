"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go when the session names no shared folder (tests).
FALLBACK_DIR = "/tmp/checkpoints/marlstone"
#: Folders made by this process, for ``release``.
_PATHS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session in one
    process may go without, for a machine's own folder would lose rows on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{FALLBACK_DIR}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def materialise(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    a lost executor costs no more than the task it ran.

    Python workers get ``batch_rows`` rows at a time meanwhile, for texts are long.
    """
    spark = df.sparkSession
    path, key = fresh_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialised tables from which nothing will be read any more: all that was made of them is written."""
    for table_ in tables:
        path = table_.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table_._written)
        path.getFileSystem(table_.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate folders made so far; tables that are still read from them must not be used after."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _PATHS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)


def trimmed(work: Callable) -> Callable:
    """A worker function that gives its memory back when its partition ends: Python
    workers live on, and what they keep counts against the executor."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def fanout_join(left: DataFrame, right: DataFrame, key: str, salt: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join on ``key`` that spreads each key of ``left`` over ``salts`` tasks.

    ``right`` has at most one row a key and is repeated ``salts`` times, so a key
    that holds a third of ``left`` never meets in one task. ``salt`` is any
    well-spread expression over ``left``; it must be deterministic, so that a
    task run again deals its rows alike. The join is a sort-merge join: the
    repeated side is not broadcast, for its size has no bound.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b.hint("merge"), [key, "_salt"], how).drop("_salt")


def crc_held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that must not be learned from; a null id is in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


