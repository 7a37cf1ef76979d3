"""Weighted reciprocal-rank fusion and what comes after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import scoring
from marlstone.operators.filters import top_per_group
from marlstone.operators.strategies import ASCENDING

K = scoring.RRF_K


def ranked(hits: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank (ties share it) by the strategy's direction."""
    order = F.asc("score") if name in ASCENDING else F.desc("score")
    return hits.withColumn("rank", F.rank().over(W.partitionBy("query_id", *by).orderBy(order))).withColumn("strategy", F.lit(name))


def _pools(pools: dict[str, DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    return reduce(DataFrame.unionByName, [ranked(p, n, by).select("query_id", "id", *by, "score", "rank", "strategy") for n, p in pools.items()])


def _weights(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))])
    return F.coalesce(table[F.col("strategy")], F.lit(1.0))


def fuse(pools: dict[str, DataFrame], limit: int, weights: dict[str, float] | None = None, k: int = K, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *by, id, score): sum of weight / (k + rank); every row of a pool contributes.

    A single pool is passed through by its own score, the best row of each id.
    """
    group = ["query_id", *by]
    if len(pools) == 1:
        (name, hits), = pools.items()
        up = name in ASCENDING
        best = hits.groupBy(*group, "id").agg((F.min if up else F.max)("score").alias("score"))
        return top_per_group(best, group, [F.asc("score") if up else F.desc("score"), F.asc("id")], limit)
    total = _pools(pools, by).groupBy(*group, "id").agg(F.sum(_weights(weights) / (F.col("rank") + k)).alias("score"))
    return top_per_group(total, group, [F.desc("score"), F.asc("id")], limit)


def fuse_debug(pools: dict[str, DataFrame], limit: int, weights: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """Fused rows with each strategy's rank, score and contribution."""
    rows = _pools(pools).withColumn("part", _weights(weights) / (F.col("rank") + k))
    detail = F.sort_array(F.collect_list(F.struct("strategy", "rank", F.round("score", 6).alias("score"), F.round("part", 6).alias("part"))))
    total = rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"), detail.alias("parts"))
    return top_per_group(total, ["query_id"], [F.desc("score"), F.asc("id")], limit)


def fuse_partitioned(pools: dict[str, DataFrame], kinds: list[str], budget: int, limit: int, weights: dict[str, float] | None = None, models: DataFrame | None = None) -> DataFrame:
    """Fusion within each kind, ``budget`` ids each, then kinds take turns in the order of ``kinds``.

    Pools are (query_id, id, kind, score), with a pool for each kind, so that a rare kind
    is not crowded out. ``models``, a pool of mental models by distance, is one more
    bucket, the last. An id that has had a turn is passed over later. (query_id, id, kind, place).
    """
    fused = fuse(pools, budget, weights, by=("kind",)).where(F.col("kind").isin(*kinds))
    turn = fused.withColumn("turn", F.row_number().over(W.partitionBy("query_id", "kind").orderBy(F.desc("score"), F.asc("id")))).select("query_id", "kind", "id", "turn")
    if models is not None:
        own = fuse({"mental_model": models}, budget)
        turn = turn.unionByName(own.select("query_id", F.lit("mental_model").alias("kind"), "id", F.row_number().over(W.partitionBy("query_id").orderBy(F.asc("score"), F.asc("id"))).alias("turn")))
    place = F.create_map(*[x for i, k in enumerate([*kinds, "mental_model"]) for x in (F.lit(k), F.lit(i))])[F.col("kind")]
    # Buckets take turns, as they are made at most ``budget`` long.
    first = top_per_group(turn.withColumn("bucket", place), ["query_id", "id"], [F.asc("turn"), F.asc("bucket")], 1)
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("turn", "bucket")))
    return placed.where(F.col("place") <= limit).select("query_id", "id", "kind", "place")


def fuse_variants(results: DataFrame, limit: int, k: int = K) -> DataFrame:
    """Blends ranked lists (query_id, variant, weight, id, position from 0): sum of weight / (k + position + 1)."""
    total = results.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (F.col("position") + 1 + k)).alias("score"))
    return top_per_group(total, ["query_id"], [F.desc("score"), F.asc("id")], limit)


def boost(rows: DataFrame, raw: Column, age_days: Column, proximity: Column, min_score: float | None = None) -> DataFrame:
    """Adds boosted; rows whose plain sigmoid is below ``min_score`` go first."""
    kept = rows if min_score is None else rows.where(scoring.sigmoid(raw) >= min_score)
    return kept.withColumn("boosted", scoring.boosted(raw, scoring.recency(age_days), proximity))


def budget_prefix(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs stay within the budget (not a knapsack)."""
    running = F.sum(cost).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


def round_robin(rows: DataFrame, group: list[str], bucket: str, order: list[Column], limit: int) -> DataFrame:
    """Buckets take turns; each turn goes in order of the bucket's name. A bucket is cut to ``limit`` rows beforehand."""
    rows = top_per_group(rows, [*group, bucket], order, limit)
    turn = rows.withColumn("turn", F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)))
    placed = turn.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("turn", bucket)))
    return placed.where(F.col("place") <= limit)
