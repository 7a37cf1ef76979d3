"""Ground-truth checks of result lists, as grouped expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_checks(results: DataFrame, checks: DataFrame) -> DataFrame:
    """(check_id, found, status): checks (check_id, query_id, keyword, wanted) over results (query_id, place, text).

    A keyword is matched regardless of case in any text of its query; a query
    without results finds nothing.
    """
    met = checks.join(results.select("query_id", "place", "text"), "query_id", "left")
    hit = F.coalesce(F.contains(F.lower("text"), F.lower("keyword")), F.lit(False))
    g = met.groupBy("check_id", "wanted").agg(F.coalesce(F.max(hit), F.lit(False)).alias("found"), F.min(F.when(hit, F.col("place"))).alias("first"))
    return g.select("check_id", "found", "first", F.when(F.col("found") == F.col("wanted"), "pass").otherwise("fail").alias("status"))


def ordering_checks(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """(check_id, status): pairs (check_id, query_id, before, after) whose first places must be in that order.

    Skipped if either word is in no result.
    """
    met = pairs.join(results.select("query_id", "place", "text"), "query_id", "left")
    place = {c: F.min(F.when(F.contains(F.lower("text"), F.lower(c)), F.col("place"))) for c in ("before", "after")}
    g = met.groupBy("check_id").agg(place["before"].alias("a"), place["after"].alias("b"))
    return g.select("check_id", F.when(F.col("a").isNull() | F.col("b").isNull(), "skip").when(F.col("a") < F.col("b"), "pass").otherwise("fail").alias("status"))


def entity_checks(checks: DataFrame, entities: DataFrame, cooccurrences: DataFrame) -> DataFrame:
    """checks (entity_id, wanted_type, other_id, least) with found, typed, together and mentioned:
    the entity is there, has the type, occurs with the other and is mentioned ``least`` times."""
    known = entities.select("entity_id", "entity_type", "mention_count")
    pairs = cooccurrences.select("e1", "e2", "n")
    keyed = checks.withColumns({"e1": F.least("entity_id", "other_id"), "e2": F.greatest("entity_id", "other_id")})
    met = keyed.join(known, "entity_id", "left").join(pairs, ["e1", "e2"], "left")
    return met.select(
        "entity_id", F.col("entity_type").isNotNull().alias("found"), F.coalesce(F.col("entity_type") == F.col("wanted_type"), F.lit(False)).alias("typed"),
        (F.coalesce("n", F.lit(0)) > 0).alias("together"), (F.coalesce("mention_count", F.lit(0)) >= F.col("least")).alias("mentioned"),
    )
