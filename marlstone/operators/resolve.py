"""Entity resolution: candidates, match score, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import scoring, text
from marlstone.functions.phonetic import phonetic_code
from marlstone.operators import names
from marlstone.operators.filters import top_per_group

ACCEPT, NAME_SHARE, CONTEXT_SHARE, RECENCY_SHARE, PHONETIC_FLOOR, PHONETIC_SCORE, NEIGHBOURS = 0.65, 0.5, 0.3, 0.2, 0.5, 0.45, 50


def group_inputs(mentions: DataFrame) -> DataFrame:
    """(normal, name, entity_type, nearby, mentions, event_date): mentions of one normalised name.

    Name and date are those of the earliest mention, the type is the first there is, and
    nearby has the normalised names mentioned beside any of them (column ``nearby``, optional).
    """
    columns = set(mentions.columns)
    kind = F.col("entity_type") if "entity_type" in columns else F.lit(None).cast("string")
    nearby = F.col("nearby") if "nearby" in columns else F.array().cast("array<string>")
    named = mentions.select(text.normal_name(F.col("name")).alias("normal"), "name", "event_date", kind.alias("entity_type"), nearby.alias("nearby")).where("normal <> ''")
    order = F.struct("event_date", "name")
    beside = F.array_distinct(F.flatten(F.collect_set(F.coalesce("nearby", F.array().cast("array<string>")))))
    g = named.groupBy("normal").agg(F.min_by("name", order).alias("name"), F.min_by("entity_type", F.when(F.col("entity_type").isNotNull(), order)).alias("entity_type"), beside.alias("nearby"), F.count("*").alias("mentions"), F.min("event_date").alias("event_date"))
    others = F.filter(F.array_distinct(F.transform("nearby", text.normal_name)), lambda w: (w != "") & (w != F.col("normal")))
    return g.withColumn("nearby", others)


def with_code(named: DataFrame) -> DataFrame:
    """The rows with the phonetic code of their name in ``code``; codes that are there already stay."""
    return named if "code" in named.columns else named.withColumn("code", phonetic_code(F.col("name")))


def candidates(inputs: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.3, k: int = 5) -> DataFrame:
    """(normal, entity_id, name_score, phonetic): the k best rows of each name.

    Names and aliases whose trigrams are at least ``least`` similar score by that;
    names with an equal phonetic code (double metaphone, kept in a column ``code`` of the entities or made here) score 0.45. An entity may come by several ways.
    Pairs meet by the set-similarity index (``operators.names``) and by code: no name is compared with all
    others, and of each code only the first k entities can be among the best.
    """
    known = entities.select("entity_id", F.col("name").alias("known"))
    both = known.withColumn("alias", F.lit(False)).unionByName(aliases.select("entity_id", F.col("name").alias("known"), F.lit(True).alias("alias")))
    near = names.similar(inputs.select("normal", "name"), both, least, known_name="known")
    by_gram = near.select("asked.normal", "known.entity_id", F.col("similarity").alias("name_score"), F.lit(False).alias("phonetic"))
    asked = inputs.select("normal", phonetic_code(F.col("name")).alias("code"))
    coded = top_per_group(with_code(entities).select("entity_id", "code").where("code IS NOT NULL"), ["code"], [F.asc("entity_id")], k)
    by_code = asked.join(coded, "code").select("normal", "entity_id", F.lit(PHONETIC_SCORE).alias("name_score"), F.lit(True).alias("phonetic"))
    return top_per_group(by_gram.unionByName(by_code), ["normal"], [F.desc("name_score"), F.asc("entity_id"), F.asc("phonetic")], k)


def neighbour_names(entities: DataFrame, cooccurrences: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(entity_id, neighbours): lower-case name -> mentions of the k strongest neighbours of each entity; of two of one name the most mentioned."""
    from marlstone.operators.graph import neighbours

    near = neighbours(cooccurrences, k).join(entities.select(F.col("entity_id").alias("other_id"), F.lower("name").alias("name"), "mention_count"), "other_id")
    once = near.groupBy("entity_id", "name").agg(F.max("mention_count").cast("long").alias("n"))
    return once.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("neighbours"))


def context_score(nearby: Column, neighbours: Column) -> Column:
    """Weights of the nearby names that are known neighbours, rare ones more, over the number of nearby names; at most 1."""
    common = F.array_intersect(nearby, F.map_keys(neighbours))
    # The sum runs over sorted names, so it is the same wherever it is made.
    total = F.aggregate(F.sort_array(common), F.lit(0.0), lambda s, name: s + scoring.neighbour_weight(F.element_at(neighbours, name)))
    return F.coalesce(F.when(F.size(nearby) > 0, F.least(total / F.size(nearby), F.lit(1.0))), F.lit(0.0))


def match_score(name_score: Column, phonetic: Column, context: Column, age_days: Column) -> Column:
    """0.5 name (at least one half where codes agree) + 0.3 context + 0.2 recency (half-life 30 days, 0 for a null date)."""
    name = F.when(phonetic, F.greatest(name_score, F.lit(PHONETIC_FLOOR))).otherwise(name_score)
    recency = F.when(age_days.isNull(), 0.0).otherwise(scoring.half_life(age_days, 30.0))
    return NAME_SHARE * name + CONTEXT_SHARE * context + RECENCY_SHARE * recency


def scored_candidates(inputs: DataFrame, entities: DataFrame, aliases: DataFrame, cooccurrences: DataFrame) -> DataFrame:
    """(normal, entity_id, score) of every candidate row; recency is that of the entity at the mention's date."""
    rows = candidates(inputs, entities, aliases).join(inputs.select("normal", "nearby", "event_date"), "normal")
    rows = rows.join(entities.select("entity_id", "last_seen"), "entity_id").join(neighbour_names(entities, cooccurrences), "entity_id", "left")
    age = scoring.days_between(F.col("event_date"), F.col("last_seen"))
    return rows.select("normal", "entity_id", match_score(F.col("name_score"), F.col("phonetic"), context_score(F.col("nearby"), F.col("neighbours")), age).alias("score"))


def resolve(scored: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The best entity of each name, if its score is high enough."""
    return top_per_group(scored.where(F.col("score") >= accept), ["normal"], [F.desc("score"), F.asc("entity_id")], 1)


def merge_entities(entities: DataFrame, resolved: DataFrame, created: DataFrame, seen: Column) -> DataFrame:
    """Entities after a batch: matched ones get one mention more and are seen at ``seen``, and their
    type if they had none; new ones have as many mentions as they were given. Columns: entity_id, name, entity_type, mention_count, last_seen."""
    hit = resolved.groupBy("entity_id").agg(F.lit(1).alias("more"), F.max("entity_type").alias("given"))
    old = entities.join(hit, "entity_id", "left").select(
        "entity_id", "name", F.coalesce("entity_type", "given").alias("entity_type"), (F.col("mention_count") + F.coalesce("more", F.lit(0))).alias("mention_count"),
        F.when(F.col("more").isNotNull(), seen).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    return old.unionByName(created.select("entity_id", "name", "entity_type", F.col("mentions").alias("mention_count"), F.coalesce("event_date", seen).alias("last_seen")))


def new_aliases(aliases: DataFrame, resolved: DataFrame) -> DataFrame:
    """Spellings of matched names that are not recorded yet: (entity_id, name)."""
    return resolved.select("entity_id", "name").distinct().join(aliases.select("entity_id", "name"), ["entity_id", "name"], "left_anti")


def orphans(entities: DataFrame, unit_entities: DataFrame) -> DataFrame:
    return entities.join(unit_entities.select("entity_id").distinct(), "entity_id", "left_anti")


def recount(entities: DataFrame, unit_entities: DataFrame) -> DataFrame:
    """Entities that have units, with mention_count set to their number."""
    n = unit_entities.groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    return entities.drop("mention_count").join(n, "entity_id")
