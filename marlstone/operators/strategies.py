"""Candidate strategies of hybrid retrieval, for a batch of queries at once.

All take candidates and a query table and give (query_id, id, score). Query
tables are parameters of a request, not data; ``checked_broadcast`` holds them to
a stated size and lets Spark shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import scoring, text, vector
from marlstone.functions.phonetic import phonetic_code
from marlstone.operators import coverage, names
from marlstone.operators.filters import top_per_group, valid_at
from marlstone.operators.nearest import nearest

POOL, MAX_BROADCAST_QUERIES, MAX_PATTERN_WORDS, SEEDS, SEED_WEIGHT, CAUSAL_LEAST = 60, 10_000, 200, 5, 0.7, 0.3


def checked_broadcast(queries: DataFrame) -> DataFrame:
    """Broadcast up to MAX_BROADCAST_QUERIES rows; more are left to the planner."""
    small = queries.limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES
    return F.broadcast(queries) if small else queries


def semantic(units: DataFrame, queries: DataFrame, pool: int = POOL, id_col: str = "unit_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Cosine distance, nearest first; units without a vector are no candidates. ``by``
    names columns of the units, such as the fact type, each value of which has a pool of its own."""
    hits = nearest(units, queries, pool, id_col, by=by)
    return hits.select("query_id", "id", *by, (1.0 - F.col("score")).alias("score"))


def keyword(units: DataFrame, queries: DataFrame, pool: int = POOL, id_col: str = "unit_id", text_col: str = "text", by: tuple[str, ...] = (), every: bool = False, most_places: int | None = coverage.PLACES) -> DataFrame:
    """By cover density: any word of the query will do, or with ``every`` all are wanted (``most_places`` of each in a text, None for all). Postings of words are joined,
    so units without a match are never paired.

    Units that hold none of the batch's words even as a part of a word are left out before they are cut into words.
    """
    asked = queries.select("query_id", F.explode(text.tokens(F.col("query_text"))).alias("word")).distinct()
    rows = units.select(F.col(id_col).alias("id"), *by, F.col(text_col).alias("_text"))
    words = [r["word"] for r in asked.select("word").distinct().limit(MAX_PATTERN_WORDS + 1).collect()]  # of the request, not of the data
    if len(words) <= MAX_PATTERN_WORDS:
        rows = rows.where(F.lower("_text").rlike("|".join(sorted(words)))) if words else rows.limit(0)
    found = coverage.places(rows, ["id", *by], "_text", checked_broadcast(asked))
    scored = coverage.all_words(found, ["id", *by], asked, most_places) if every else coverage.any_word(found, ["id", *by])
    return top_per_group(scored, ["query_id", *by], [F.desc("score"), F.asc("id")], pool)


def temporal(units: DataFrame, queries: DataFrame, pool: int = POOL, id_col: str = "unit_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The newest units, the same for every query; cut to the pool before queries join."""
    score = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', event_date)") / 1e6
    dated = units.select(F.col(id_col).alias("id"), *by, score.alias("score"))
    order = [F.desc("score"), F.asc("id")]
    newest = top_per_group(dated, list(by), order, pool) if by else dated.orderBy(*order).limit(pool)
    return newest.crossJoin(checked_broadcast(queries.select("query_id"))).select("query_id", "id", *by, "score")


def semantic_seeds(units: DataFrame, unit_entities: DataFrame, queries: DataFrame, k: int = SEEDS) -> DataFrame:
    """Entities of each query's nearest active units in its vault."""
    near = units.where("status = 'active' AND embedding IS NOT NULL").select("unit_id", "vault_id", "embedding")
    asked = vector.unit_vectors(queries.select("query_id", "query_vector", F.col("query_vault").alias("vault_id")), "query_vector")
    pairs = vector.unit_vectors(near, "embedding").join(checked_broadcast(asked), "vault_id")
    scored = pairs.select("query_id", "unit_id", (1.0 - vector.dot(F.col("embedding"), F.col("query_vector"))).alias("score"))
    top = top_per_group(scored, ["query_id"], [F.asc_nulls_last("score"), F.asc("unit_id")], k)
    return unit_entities.select("unit_id", "entity_id").join(top, "unit_id").select("query_id", "entity_id").distinct().withColumn("weight", F.lit(SEED_WEIGHT))


def named_seeds(entities: DataFrame, aliases: DataFrame, queries: DataFrame, least: float = 0.3, phonetic: bool = True) -> DataFrame:
    """Entities whose name or alias contains the asked name, is near it in trigrams (strictly above ``least``) or sounds like it.

    Names meet by postings of trigrams and of runs of characters and by phonetic code (``operators.names``); equal names contain each other.
    Where no name was found in a query and ``asked`` is the whole query, take ``phonetic`` off: sentences have no code."""
    known = entities.select("entity_id", "name").unionByName(aliases.select("entity_id", "name"))
    asked = queries.select("query_id", F.col("asked").alias("name"))
    near = names.similar(asked, known, least).where(F.col("similarity") > least)
    hit = near.select("asked.query_id", "known.entity_id").unionByName(names.containing(asked, known).select("asked.query_id", "known.entity_id"))
    if phonetic:
        alike = names.sounding_alike(asked.withColumn("code", phonetic_code(F.col("name"))), known.withColumn("code", phonetic_code(F.col("name"))))
        hit = hit.unionByName(alike.select("asked.query_id", "known.entity_id"))
    return hit.distinct().withColumn("weight", F.lit(1.0))


def merge_seeds(named: DataFrame, semantic_: DataFrame) -> DataFrame:
    return named.unionByName(semantic_).groupBy("query_id", "entity_id").agg(F.max("weight").alias("weight"))


def directed(cooccurrences: DataFrame) -> DataFrame:
    """Both directions of each pair: what turns an either-end join into an equi-join."""
    rest = [c for c in cooccurrences.columns if c not in ("e1", "e2")]
    ends = [F.struct(F.col(a).alias("entity_id"), F.col(b).alias("other_id")) for a, b in (("e1", "e2"), ("e2", "e1"))]
    return cooccurrences.select(F.inline(F.array(*ends)), *rest)


def _dated(hits: DataFrame, units: DataFrame, base: Column, now: Column, tie: str) -> DataFrame:
    age = scoring.days_between(now, F.col("event_date"))
    return hits.join(units.select("unit_id", "event_date", F.col(tie).alias("_tie")), "unit_id").select("query_id", F.col("unit_id").alias("id"), (base + scoring.decay(age)).alias("score"), "_tie")


def _pooled(rows: DataFrame, pool: int) -> DataFrame:
    return top_per_group(rows, ["query_id"], [F.desc("score"), F.asc("_tie"), F.asc("id")], pool).select("query_id", "id", "score")


def cooccurrence_graph(units: DataFrame, unit_entities: DataFrame, entities: DataFrame, cooccurrences: DataFrame, seeds: DataFrame, now: Column, as_of: Column | None = None, pool: int = POOL, tie: str = "unit_id") -> DataFrame:
    """First order: units of the seeds, seed weight plus decay. Second: units of each
    seed's neighbours by the strength of that link. A row a path; rows of one unit are not merged.

    Of equal scores those with the least ``tie``, a column of the units, come first. All units of a
    neighbour score alike on one path, so of each entity the ``pool`` first are enough.
    """
    seeds = seeds.select("query_id", "entity_id", "weight")
    first = unit_entities.select("unit_id", "entity_id").join(seeds, "entity_id")
    first = _dated(first, units, F.col("weight"), now, tie)
    edges = directed(cooccurrences)
    if as_of is not None:
        edges = edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of))
    reached = edges.join(seeds.select("query_id", "entity_id"), "entity_id").join(entities.select(F.col("entity_id").alias("other_id"), "mention_count"), "other_id")
    reached = reached.select("query_id", "other_id", scoring.link_strength(F.col("n"), F.col("mention_count")).alias("score"))
    live = unit_entities.select("unit_id", F.col("entity_id").alias("other_id")).join(units.select("unit_id", F.col(tie).alias("_tie")), "unit_id")
    second = top_per_group(live, ["other_id"], [F.asc("_tie"), F.asc("unit_id")], pool).join(reached, "other_id").select("query_id", F.col("unit_id").alias("id"), "score", "_tie")
    return _pooled(first.unionByName(second), pool)


def causal_graph(units: DataFrame, unit_entities: DataFrame, links: DataFrame, seeds: DataFrame, now: Column, kinds: tuple[str, ...] = ("causes", "caused_by", "enables", "prevents"), pool: int = POOL, tie: str = "unit_id", merge: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """Units of the seeds (1 plus decay) and what causal links of weight 0.3 and more lead to (0.8 weight): the best score of
    each unit, or with ``merge`` off a row a path, one for each seed that a unit has. ``sources`` are the units that links may start from, if not all."""
    paths = unit_entities.select("unit_id", "entity_id").join(seeds.select("query_id", "entity_id"), "entity_id").select("query_id", "unit_id")
    direct = paths.distinct() if merge else paths
    first = _dated(direct, units, F.lit(1.0), now, tie)
    causal = links.where(F.col("link_type").isin(*kinds) & (F.col("weight") >= CAUSAL_LEAST))
    starts = direct if sources is None else direct.join(sources.select("unit_id").distinct(), "unit_id", "left_semi")
    second = causal.join(starts, causal.from_id == starts.unit_id).select("query_id", F.col("to_id").alias("id"), (F.col("weight") * 0.8).alias("score"))
    second = second.join(units.select(F.col("unit_id").alias("id"), F.col(tie).alias("_tie")), "id").select("query_id", "id", "score", "_tie")
    rows = first.unionByName(second)
    return _pooled(rows.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.first("_tie").alias("_tie")) if merge else rows, pool)


def link_expansion(links: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] = ("causes", "caused_by", "enables", "prevents"), pool: int = POOL) -> DataFrame:
    """From seed units (query_id, unit_id): tanh of half the number of distinct entities of
    entity links forth, plus the best semantic link either way, plus every causal link of
    weight 0.3 and more forth. Seeds may be reached, and a seed given twice counts its causal links twice.

    ``links``: from_id, to_id, link_type, weight, entity_id.
    """
    seeds = seeds.select("query_id", "unit_id")
    once = seeds.distinct()
    forth = links.select(F.col("from_id").alias("unit_id"), F.col("to_id").alias("id"), "link_type", "weight", "entity_id")
    by_entity = forth.where("link_type = 'entity' AND entity_id IS NOT NULL").join(once, "unit_id").groupBy("query_id", "id").agg(scoring.entity_overlap(F.countDistinct("entity_id")).alias("score"))
    near = forth.where("link_type = 'semantic'").select("unit_id", "id", "weight")
    both = near.unionByName(near.select(F.col("id").alias("unit_id"), F.col("unit_id").alias("id"), "weight"))
    by_meaning = both.join(once, "unit_id").groupBy("query_id", "id").agg(F.max("weight").alias("score"))
    cause = forth.where(F.col("link_type").isin(*kinds) & (F.col("weight") >= CAUSAL_LEAST))
    by_cause = cause.join(seeds, "unit_id").select("query_id", "id", F.col("weight").alias("score"))
    # Rounded, so that equal sums stay equal in whatever order they are added.
    total = by_entity.unionByName(by_meaning).unionByName(by_cause).groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_per_group(total, ["query_id"], [F.desc("score"), F.asc("id")], pool)


ASCENDING = frozenset({"semantic", "mental_model"})
UNIT_STRATEGIES = ("semantic", "keyword", "graph", "temporal", "mental_model")
GRAPHS = {"cooccurrence": cooccurrence_graph, "causal": causal_graph, "links": link_expansion}


def select_strategies(wanted: list[str] | None) -> list[str]:
    """All for None; a list must name known strategies and at least one."""
    if wanted is None:
        return list(UNIT_STRATEGIES)
    unknown = [w for w in wanted if w not in UNIT_STRATEGIES]
    if not wanted or unknown:
        raise ValueError(f"unknown strategies {unknown}" if unknown else "no strategy given")
    return list(dict.fromkeys(wanted))


def graph_strategy(name: str):
    if name not in GRAPHS:
        raise ValueError(f"unknown graph strategy {name!r}; one of {', '.join(GRAPHS)}")
    return GRAPHS[name]
