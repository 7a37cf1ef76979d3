"""Entity graph, relations between notes and typed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import scoring
from marlstone.operators.filters import top_per_group
from marlstone.operators.strategies import directed

MENTION_CAP, RARE_PER_NOTE, RELATED = 50, 100, 5


def count_pairs(unit_entities: DataFrame, date_col: str = "event_date", tasks: int | None = None) -> DataFrame:
    """(e1, e2, n, valid_from, last) of entities in one unit, e1 < e2. With ``tasks`` the pairs are counted in so many
    (see ``filters.tasks_for``), each pair in one."""
    a = unit_entities.select("unit_id", F.col("entity_id").alias("e1"), date_col).distinct()
    b = unit_entities.select("unit_id", F.col("entity_id").alias("e2")).distinct()
    pairs = a.join(b, "unit_id").where("e1 < e2")
    pairs = pairs.repartition(tasks, "e1", "e2") if tasks else pairs
    return pairs.groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min(date_col).alias("valid_from"), F.max(date_col).alias("last"))


def merge_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: counts add up, the earliest start and the latest date stay."""
    a = old.select("e1", "e2", F.col("n").alias("n0"), F.col("valid_from").alias("f0"), F.col("last").alias("l0"))
    b = new.select("e1", "e2", F.col("n").alias("n1"), F.col("valid_from").alias("f1"), F.col("last").alias("l1"))
    zero = F.lit(0)
    return a.join(b, ["e1", "e2"], "full").select("e1", "e2", (F.coalesce("n0", zero) + F.coalesce("n1", zero)).alias("n"), F.least("f0", "f1").alias("valid_from"), F.greatest("l0", "l1").alias("last"))


def centrality(cooccurrences: DataFrame) -> DataFrame:
    """Sum of co-occurrence counts at either end."""
    return directed(cooccurrences).groupBy("entity_id").agg(F.sum("n").alias("centrality"))


def ranked_entities(entities: DataFrame, cooccurrences: DataFrame) -> DataFrame:
    c = entities.join(centrality(cooccurrences), "entity_id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0)))
    return c.withColumn("rank_score", scoring.mention_score(F.col("mention_count"), F.col("retrieval_count"), F.col("centrality")))


def neighbours(cooccurrences: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """The k strongest neighbours of each entity, found in ``tasks`` if given."""
    rows = directed(cooccurrences).select("entity_id", "other_id", "n")
    return top_per_group(rows.repartition(tasks, "entity_id") if tasks else rows, ["entity_id"], [F.desc("n"), F.asc("other_id")], k)


def related_notes(note_entities: DataFrame, mentions: DataFrame, cap: int = MENTION_CAP, rare: int = RARE_PER_NOTE, k: int = RELATED) -> DataFrame:
    """(note_id, other_id, shared, score): notes sharing entities of at most ``cap`` mentions,
    of which a note's ``rare`` rarest count. The cap bounds the rows an entity can make."""
    few = mentions.where(F.col("mention_count") <= cap).select("entity_id", "mention_count")
    named = note_entities.select("note_id", "entity_id").distinct().join(few, "entity_id")
    named = top_per_group(named, ["note_id"], [F.asc("mention_count"), F.asc("entity_id")], rare)
    other = named.select("entity_id", F.col("note_id").alias("other_id"))
    pairs = named.join(other, "entity_id").where("note_id <> other_id")
    scored = pairs.groupBy("note_id", "other_id").agg(F.count("*").alias("shared"), F.sum(scoring.rarity(F.col("mention_count"))).alias("raw"))
    from pyspark.sql.window import Window as W

    top = top_per_group(scored, ["note_id"], [F.desc("raw"), F.asc("other_id")], k)
    return top.withColumn("score", F.round(F.col("raw") / F.max("raw").over(W.partitionBy("note_id")), 3))


def links_both_ways(links: DataFrame) -> DataFrame:
    """Each link from the side of both ends; ``outgoing`` tells which."""
    out = links.select(F.col("from_id").alias("unit_id"), F.col("to_id").alias("other_id"), "link_type", "weight", F.lit(True).alias("outgoing"))
    back = links.select(F.col("to_id").alias("unit_id"), F.col("from_id").alias("other_id"), "link_type", "weight", F.lit(False).alias("outgoing"))
    return out.unionByName(back)


def note_links(links: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """The best weight of each (note, other note, kind), no note with itself, k a note."""
    at, to = units.select(F.col("unit_id").alias("from_id"), "note_id"), units.select(F.col("unit_id").alias("to_id"), F.col("note_id").alias("other_id"))
    best = links.join(at, "from_id").join(to, "to_id").where("note_id <> other_id").groupBy("note_id", "other_id", "link_type").agg(F.max("weight").alias("weight"))
    return top_per_group(best, ["note_id"], [F.desc("weight"), F.asc("other_id"), F.asc("link_type")], k)


def lineage(edges: DataFrame, roots: DataFrame, depth: int = 3, limit: int = 10) -> DataFrame:
    """(root, node, parent, level): walks child edges (parent, child) level by level, ``limit`` children a node."""
    kept = top_per_group(edges, ["parent"], [F.asc("child")], limit)
    level = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"))
    out = level
    for n in range(1, depth + 1):
        level = level.select("root", F.col("node").alias("parent")).join(kept, "parent").select("root", F.col("child").alias("node"), "parent", F.lit(n).alias("level")).distinct()
        out = out.unionByName(level)
    return out


def closest_in_time(rows: DataFrame, group: list[str], time_col: str = "event_date", id_col: str = "unit_id", bucket: str = "hour") -> DataFrame:
    """Adds before_id and after_id, the neighbours of each row in its group in the order of time and id; rows without a time come first.

    Windows run over a group's rows of one ``bucket`` of time; the first and last of each bucket find their
    neighbours in a table with a row a bucket, so that a group, however large, is no task of its own.
    """
    from pyspark.sql.window import Window as W

    earliest = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    dated = rows.withColumn("_b", F.coalesce(F.date_trunc(bucket, time_col).cast("timestamp_ntz"), earliest))
    w = W.partitionBy(*group, "_b").orderBy(time_col, id_col)
    near = dated.withColumns({"before_id": F.lag(id_col).over(w), "after_id": F.lead(id_col).over(w)})
    order = F.struct(time_col, id_col)
    ends = dated.groupBy(*group, "_b").agg(F.min_by(id_col, order).alias("_first"), F.max_by(id_col, order).alias("_last"))
    buckets = W.partitionBy(*group).orderBy("_b")
    ends = ends.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_b").alias("_gb"), F.lag("_last").over(buckets).alias("_before"), F.lead("_first").over(buckets).alias("_after"))
    same = F.col("_b") == F.col("_gb")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = near.join(ends, same)
    return out.select(*rows.columns, F.coalesce("before_id", "_before").alias("before_id"), F.coalesce("after_id", "_after").alias("after_id"))
