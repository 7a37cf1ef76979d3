"""Predicates shared by all retrieval strategies. A null argument means no filter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def true() -> Column:
    return F.lit(True)


def date_between(col: Column, start: datetime | None = None, end: datetime | None = None) -> Column:
    """Both ends belong to the range."""
    out = true()
    if start is not None:
        out = out & (col >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (col <= F.lit(end).cast("timestamp_ntz"))
    return out


def in_vaults(col: Column, vaults: list | None = None) -> Column:
    return col.isin(*vaults) if vaults else true()


def live_facts(fact_type: str | None = None, include_stale: bool = False) -> Column:
    out = true() if include_stale else F.col("status") == "active"
    return out if fact_type is None else out & (F.col("fact_type") == fact_type)


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Half-open validity; a null end is open."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (valid_to > at))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(tags, F.array().cast("array<string>")))) == 0 if wanted else true()


def cites(observations: Column, unit_id: Column) -> Column:
    """Whether any observation of an array of struct<..., evidence array<struct<unit_id, ...>>> has a unit as evidence."""
    return F.coalesce(F.exists(observations, lambda o: F.exists(o["evidence"], lambda e: e["unit_id"] == unit_id)), F.lit(False))


def not_expired(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at > now)


def note_date(by: str = "coalesced") -> Column:
    columns = {"coalesced": F.coalesce("publish_date", "created_at"), "created": F.col("created_at"), "publish": F.col("publish_date")}
    if by not in columns:
        raise ValueError(f"unknown date column {by!r}; one of {', '.join(columns)}")
    return columns[by]


def key_pattern(key: Column, pattern: str) -> Column:
    """A trailing * matches any rest; otherwise keys are equal."""
    return key.startswith(pattern[:-1]) if pattern.endswith("*") else key == pattern


def without_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return rows.join(ids.select(on).distinct(), on, "left_anti")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition before it shuffles."""

    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")


def tasks_for(spark: SparkSession, rows: int, per_task: int = 200_000) -> int:
    """As many tasks as it takes for ``per_task`` rows each, and at least those of the session: so a task does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def seeded_sample(rows: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows with the least hashes of seed and id: a uniform sample that does not depend on the order of the input."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))), id_col).limit(k)


def unseen_in_session(results: DataFrame, session: str, item: str, at: str, minutes: float = 30) -> DataFrame:
    """The first row of each item in each run of a session; a run ends where the session rests for longer than ``minutes``.

    Of rows of one time the smaller item comes first. The streaming form is ``streaming.keyed.unseen``.
    """
    order = W.partitionBy(session).orderBy(at, item)
    rest = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp"))
    rows = results.withColumn("_run", F.sum(F.when(rest > int(minutes * 60_000_000), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy(session, "_run", item).orderBy(at))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_run", "_nth")
