"""Bounded training samples from a labels table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import crc_held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents outside the held-out fold, a row each.

    The documents are those with the least hash of their id, whatever the order of
    the input. A document with several labels gets the largest; null labels and
    null ids are left out; of rows that repeat an id the one with the least hash of its text is
    used. The sample's ids are bounded by ``max_rows``, hence broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~crc_held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_y_doc")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("_y_doc", F.lit(5)), "_y_doc").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_y_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_y_doc")
    one = rows.groupBy("_y_doc", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select(F.col("_y_doc").alias("doc_id"), "text", "y")
