"""Queries over facts: strategies, fusion, boosts, graph walks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marlstone.functions import scoring, text, vector
from marlstone.operators import diversity, filters, fusion, strategies
from marlstone.plans import views
from marlstone.plans.registry import query
from marlstone.plans.views import NOW_SQL, now, sql

#: Pieces of SQL that several oracles share. ``toks`` gives a text's distinct stems.
TOKS = "list_distinct(list_filter(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[1:len(w)-1] ELSE w END), lambda w: w NOT IN ('the','a','an','of','and','in','on','at','to','for')))"
#: All words in order; rank of a text in which any word will do, from its words' places.
WORDS = "list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[1:len(w)-1] ELSE w END)"
PLACED = "unnest(WORDS) AS word, least(generate_subscripts(WORDS, 1), 16383) AS place".replace("WORDS", WORDS)
DENSITY = "(SELECT {0}, 0.1::DOUBLE * sum(n) AS score FROM (SELECT {0}, word, least(count(DISTINCT place), 256) AS n FROM {1} GROUP BY ALL) GROUP BY ALL)"
AGE = f"(epoch_us({NOW_SQL}) - epoch_us(event_date)) / 86400e6"
DECAY = f"pow(2.0::DOUBLE, greatest(-({AGE}) / 30.0, -996.0))"
COS = "(1.0::DOUBLE - list_inner_product(embedding, query_vector) / (sqrt(list_inner_product(embedding, embedding)) * sqrt(list_inner_product(query_vector, query_vector))))"
SEMANTIC = f"""sem AS (SELECT * FROM (SELECT query_id, unit_id AS id, {COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COS}, unit_id) AS nth
  FROM facts, search_queries WHERE embedding IS NOT NULL AND status = 'active') WHERE nth <= 60)"""
KEYWORD = f"""post AS (SELECT unit_id AS id, {PLACED.format('text')} FROM facts WHERE status = 'active'),
  asked AS (SELECT query_id, unnest({TOKS.format('query_text')}) AS word FROM search_queries),
  kw0 AS {DENSITY.format('query_id, id', 'post JOIN asked USING (word)')},
  kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM kw0) WHERE nth <= 60)"""
TEMPORAL = """newest AS (SELECT unit_id AS id, epoch_us(event_date) / 1e6 AS score FROM facts WHERE status = 'active' ORDER BY score DESC, id LIMIT 60),
  tmp AS (SELECT query_id, id, score FROM newest, search_queries)"""
SEEDS = f"""near5 AS (SELECT query_id, unit_id FROM (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY {COS}, unit_id) AS nth
  FROM facts JOIN search_queries ON vault_id = query_vault WHERE status = 'active' AND embedding IS NOT NULL) WHERE nth <= 5),
  seeds AS (SELECT DISTINCT query_id, entity_id, 0.7::DOUBLE AS weight FROM near5 JOIN fact_entities USING (unit_id))"""
ACTIVE = "act AS (SELECT unit_id, event_date FROM facts WHERE status = 'active')"
EDGES = "edges AS (SELECT e1 AS entity_id, e2 AS other_id, n, valid_from, valid_to FROM cooccurrences UNION ALL SELECT e2, e1, n, valid_from, valid_to FROM cooccurrences)"
GRAPH = f"""{ACTIVE}, {EDGES}, g1 AS (SELECT query_id, unit_id AS id, weight + {DECAY} AS score FROM fact_entities fe JOIN seeds USING (entity_id) JOIN act a USING (unit_id)),
  reached AS (SELECT query_id, other_id, ln(n + 1.0::DOUBLE) / ln(mention_count + 2.0::DOUBLE) AS strength FROM edges JOIN seeds USING (entity_id) JOIN (SELECT entity_id AS other_id, mention_count FROM entities) USING (other_id) {{asof}}),
  g2 AS (SELECT query_id, unit_id AS id, strength AS score FROM fact_entities fe JOIN reached r ON fe.entity_id = r.other_id WHERE unit_id IN (SELECT unit_id FROM act)),
  graph AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2)) WHERE nth <= 60)"""
# g1 joins fact_entities, which has an event_date too: the date meant is the unit's.
GRAPH = GRAPH.replace(DECAY, DECAY.replace("event_date", "a.event_date"))
FUSED = """parts AS ({parts}), fused AS (SELECT query_id, id, sum(w / (60 + rank)) AS score FROM parts GROUP BY 1, 2),
  best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM fused)"""


def _part(name: str, weight: float, order: str) -> str:
    return f"SELECT query_id, id, {weight}::DOUBLE AS w, rank() OVER (PARTITION BY query_id ORDER BY score {order}) AS rank, '{name}' AS strategy, score FROM {'sem' if name == 'semantic' else 'kw' if name == 'keyword' else 'tmp' if name == 'temporal' else name}"


WEIGHTS = {"semantic": 1.0, "keyword": 0.8, "graph": 0.6, "temporal": 0.5}
PARTS = " UNION ALL ".join(_part(n, w, "ASC" if n == "semantic" else "DESC") for n, w in WEIGHTS.items())
ALL_POOLS = f"{SEMANTIC}, {KEYWORD}, {TEMPORAL}, {SEEDS}, {GRAPH.format(asof='')}"
BASE = ("facts", "search_queries", "fact_entities", "entities", "cooccurrences")


def _active(spark, d):
    return views.facts(spark, d).where(filters.live_facts())


def _pools(spark, d, names=tuple(WEIGHTS)):
    units, asked = _active(spark, d), views.search_queries(spark, d)
    made = {}
    if "semantic" in names:
        made["semantic"] = strategies.semantic(units, asked)
    if "keyword" in names:
        made["keyword"] = strategies.keyword(views.dealt(units.select("unit_id", "text"), spark, d), asked)
    if "graph" in names:
        ue = views.fact_entities(spark, d)
        seeds = strategies.semantic_seeds(views.facts(spark, d), ue, asked)
        dated, held = (views.dealt(x, spark, d, 100_000) for x in (units.select("unit_id", "event_date"), ue.select("unit_id", "entity_id")))
        made["graph"] = strategies.cooccurrence_graph(dated, held, views.entities(spark, d), views.cooccurrences(spark, d), seeds, now())
    if "temporal" in names:
        made["temporal"] = strategies.temporal(units, asked)
    return made


@query(sql(f"WITH {ALL_POOLS}, {FUSED.format(parts=PARTS)} SELECT query_id, id, round(score, 9) AS score FROM best WHERE nth <= 10", *BASE))
def hybrid_search(spark, d):
    """Semantic, keyword, graph and temporal candidates, fused by weighted reciprocal rank; top 10 a query."""
    return fusion.fuse(_pools(spark, d), 10, WEIGHTS).select("query_id", "id", F.round("score", 9).alias("score"))


@query(sql(f"WITH {SEMANTIC} SELECT query_id, id, round(score, 6) + 0.0 AS score FROM sem", "facts", "search_queries"))
def semantic_candidates(spark, d):
    return _pools(spark, d, ("semantic",))["semantic"].select("query_id", "id", (F.round("score", 6) + 0.0).alias("score"))


@query(sql(f"WITH {KEYWORD} SELECT query_id, id, round(score, 6) AS score FROM kw", "facts", "search_queries"))
def keyword_candidates(spark, d):
    return _pools(spark, d, ("keyword",))["keyword"].select("query_id", "id", F.round("score", 6).alias("score"))


ALL_WORDS = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKS.format("array_to_string(" + WORDS.format('text') + "[2:4], ' ')")}) AS word FROM benchmark), wanted AS (SELECT query_id, count(*) AS wanted FROM asked GROUP BY 1),
  hits AS (SELECT query_id, id, word, place FROM (SELECT note_id AS id, {PLACED.format('text')} FROM notes) JOIN asked USING (word)),
  ends AS (SELECT query_id, id, e.place AS last, min(l) AS first FROM (SELECT h.query_id, h.id, h.place, x.word, max(x.place) AS l FROM hits h JOIN hits x ON x.query_id = h.query_id AND x.id = h.id AND x.place <= h.place GROUP BY ALL) e
    JOIN wanted USING (query_id) GROUP BY query_id, id, e.place, wanted HAVING count(*) = wanted),
  tight AS (SELECT query_id, id, first, min(last) AS last FROM ends GROUP BY ALL),
  noisy AS (SELECT query_id, id, first, last, last - first + 1 - (SELECT count(*) FROM hits h WHERE h.query_id = t.query_id AND h.id = t.id AND h.place BETWEEN first AND last) AS noise FROM tight t)"""


@query(sql(f"WITH {ALL_WORDS} SELECT query_id, id, round(sum(0.1::DOUBLE / (1 + noise)), 6) AS score FROM noisy GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(0.1::DOUBLE / (1 + noise)), 9) DESC, id) <= 60", "notes"))
def keyword_all_words(spark, d):
    """Notes that hold three words of a benchmark item close together: the second to the fourth."""
    asked = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(text.words(F.col("text")), 2, 3), " ").alias("query_text"))
    hits = strategies.keyword(views.notes(spark, d), asked, pool=1_000_000, id_col="note_id", every=True, most_places=None).withColumn("score", F.round("score", 9))
    return filters.top_per_group(hits, ["query_id"], [F.desc("score"), F.asc("id")], strategies.POOL).select("query_id", "id", F.round("score", 6).alias("score"))


@query(sql(f"WITH {TEMPORAL} SELECT query_id, id, round(score, 3) AS score FROM tmp", "facts", "search_queries"))
def temporal_candidates(spark, d):
    return _pools(spark, d, ("temporal",))["temporal"].select("query_id", "id", F.round("score", 3).alias("score"))


@query(sql(f"WITH {SEEDS} SELECT query_id, entity_id, weight FROM seeds", "facts", "search_queries", "fact_entities"))
def semantic_entity_seeds(spark, d):
    return strategies.semantic_seeds(views.facts(spark, d), views.fact_entities(spark, d), views.search_queries(spark, d))


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM = "(CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE ELSE 0.0 END)"


def _asked_names(spark, d):
    return views.entities(spark, d).where("entity_id % 9 = 0").select(F.col("entity_id").alias("query_id"), F.concat(F.lit("person no "), F.col("entity_id")).alias("asked"))


def _aliases(spark, d):
    return views.entities(spark, d).where("entity_id % 2 = 0").select("entity_id", F.concat(F.lit("aka "), F.col("entity_id"), F.lit("-"), F.col("entity_type")).alias("name"))


NAMED = f"""asked AS (SELECT entity_id AS query_id, 'person no ' || entity_id AS asked FROM entities WHERE entity_id % 9 = 0),
  names AS (SELECT entity_id, name FROM entities UNION ALL SELECT entity_id, 'aka ' || entity_id || '-' || entity_type FROM entities WHERE entity_id % 2 = 0),
  named AS (SELECT DISTINCT query_id, entity_id, 1.0::DOUBLE AS weight FROM names, asked WHERE name ILIKE '%' || asked || '%' OR lower(name) = lower(asked) OR {SIM.format(GRAMS.format('name'), GRAMS.format('asked'))} > 0.3 OR name ILIKE 'person no%')"""


@query(sql(f"WITH {NAMED} SELECT * FROM named", "entities"))
def named_entity_seeds(spark, d):
    """Names and aliases by equality, containment, trigram similarity strictly above 0.3 or sound. (Asked for are persons, so the SQL takes all persons as sounding alike.)"""
    return strategies.named_seeds(views.entities(spark, d), _aliases(spark, d), _asked_names(spark, d))


@query(sql(f"WITH {SEEDS}, {NAMED} SELECT query_id, entity_id, max(weight) AS weight FROM (SELECT * FROM seeds UNION ALL SELECT * FROM named) GROUP BY 1, 2", "facts", "search_queries", "fact_entities", "entities"))
def merged_seeds(spark, d):
    return strategies.merge_seeds(strategies.named_seeds(views.entities(spark, d), _aliases(spark, d), _asked_names(spark, d)), semantic_entity_seeds(spark, d))


@query(sql(f"WITH {SEEDS}, {GRAPH.format(asof='')} SELECT query_id, id, round(score, 6) AS score FROM graph", *BASE))
def cooccurrence_expansion(spark, d):
    """First and second order over co-occurring entities, a row a path."""
    return _pools(spark, d, ("graph",))["graph"].select("query_id", "id", F.round("score", 6).alias("score"))


AS_OF = "WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')"


@query(sql(f"WITH {SEEDS}, {GRAPH.format(asof=AS_OF)} SELECT query_id, id, round(score, 6) AS score FROM graph", *BASE))
def cooccurrence_expansion_as_of(spark, d):
    ue, asked = views.fact_entities(spark, d), views.search_queries(spark, d)
    seeds = strategies.semantic_seeds(views.facts(spark, d), ue, asked)
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    hits = strategies.cooccurrence_graph(_active(spark, d), ue, views.entities(spark, d), views.cooccurrences(spark, d), seeds, now(), at)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


CAUSAL = f"""{ACTIVE}, direct AS (SELECT DISTINCT query_id, unit_id FROM fact_entities JOIN seeds USING (entity_id)),
  c1 AS (SELECT query_id, unit_id AS id, 1.0 + {DECAY} AS score FROM direct JOIN act USING (unit_id)),
  c2 AS (SELECT query_id, to_id AS id, weight * 0.8 AS score FROM fact_links JOIN direct ON from_id = unit_id WHERE link_type IN ('causes', 'caused_by', 'enables', 'prevents') AND weight >= 0.3 AND to_id IN (SELECT unit_id FROM act)),
  c AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY 1, 2),
  causal AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM c) WHERE nth <= 60)"""


@query(sql(f"WITH {SEEDS}, {CAUSAL} SELECT query_id, id, round(score, 6) AS score FROM causal", "facts", "search_queries", "fact_entities", "fact_links"))
def causal_expansion(spark, d):
    hits = strategies.causal_graph(_active(spark, d), views.fact_entities(spark, d), views.fact_links(spark, d), semantic_entity_seeds(spark, d), now())
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


LINKED = f"""{ACTIVE}, sd AS (SELECT query_id, unit_id FROM fact_entities JOIN seeds USING (entity_id) WHERE unit_id IN (SELECT unit_id FROM act)),
  l1 AS (SELECT query_id, to_id AS id, tanh(0.5 * count(DISTINCT entity_id)) AS score FROM entity_links JOIN sd ON from_id = unit_id WHERE link_type = 'entity' AND entity_id IS NOT NULL GROUP BY 1, 2),
  l2 AS (SELECT query_id, id, max(weight) AS score FROM (SELECT from_id AS unit_id, to_id AS id, weight FROM entity_links WHERE link_type = 'semantic' UNION ALL SELECT to_id, from_id, weight FROM entity_links WHERE link_type = 'semantic') JOIN sd USING (unit_id) GROUP BY 1, 2),
  l3 AS (SELECT query_id, to_id AS id, weight AS score FROM entity_links JOIN sd ON from_id = unit_id WHERE link_type IN ('causes', 'caused_by', 'enables', 'prevents') AND weight >= 0.3),
  l AS (SELECT query_id, id, round(sum(score), 9) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1, 2),
  linked AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM l) WHERE nth <= {{pool}})"""


def _linked(spark, d, pool):
    """Hits of link expansion from the active units of each query's seed entities; a unit of two seeds is given twice."""
    live = _active(spark, d).select("unit_id")
    seeds = views.fact_entities(spark, d).select("unit_id", "entity_id").join(semantic_entity_seeds(spark, d).select("query_id", "entity_id"), "entity_id").join(live, "unit_id", "left_semi")
    return strategies.link_expansion(views.entity_links(spark, d), seeds, pool=pool)


@query(sql(f"WITH {SEEDS}, {LINKED.format(pool=60)} SELECT query_id, id, round(score, 6) AS score FROM linked", "facts", "search_queries", "fact_entities", "entity_links"))
def three_signal_links(spark, d):
    """Entity, semantic and causal links from the units of each query's seed entities."""
    return _linked(spark, d, 60).select("query_id", "id", F.round("score", 6).alias("score"))


TWO = f"{SEMANTIC}, {TEMPORAL}, {FUSED.format(parts=_part('semantic', 1.0, 'ASC') + ' UNION ALL ' + _part('temporal', 1.0, 'DESC'))}"


@query(sql(f"WITH {TWO} SELECT query_id, id, round(score, 9) AS score FROM best WHERE nth <= 20", "facts", "search_queries"))
def rrf_two_strategies(spark, d):
    return fusion.fuse(_pools(spark, d, ("semantic", "temporal")), 20).select("query_id", "id", F.round("score", 9).alias("score"))


@query(sql(f"WITH {SEMANTIC} SELECT query_id, id, round(score, 6) + 0.0 AS score FROM sem WHERE nth <= 10", "facts", "search_queries"))
def single_strategy_path(spark, d):
    return fusion.fuse(_pools(spark, d, ("semantic",)), 10).select("query_id", "id", (F.round("score", 6) + 0.0).alias("score"))


@query(sql(f"WITH {TWO} SELECT query_id, id, strategy, rank, round(w / (60 + rank), 6) AS part FROM best JOIN parts USING (query_id, id) WHERE nth <= 20", "facts", "search_queries"))
def rrf_debug(spark, d):
    """Each strategy's rank and contribution for the fused rows."""
    rows = fusion.fuse_debug(_pools(spark, d, ("semantic", "temporal")), 20).select("query_id", "id", F.explode("parts").alias("p"))
    return rows.select("query_id", "id", "p.strategy", F.col("p.rank").cast("long").alias("rank"), "p.part")


KIND_ORDER = ["world", "event", "observation"]
TYPED = f"""tp AS (SELECT * FROM (SELECT query_id, unit_id AS id, fact_type AS kind, {COS} AS score, row_number() OVER (PARTITION BY query_id, fact_type ORDER BY {COS}, unit_id) AS nth FROM facts, search_queries WHERE embedding IS NOT NULL AND status = 'active') WHERE nth <= 60),
  tn AS (SELECT query_id, id, kind, score FROM (SELECT unit_id AS id, fact_type AS kind, epoch_us(event_date) / 1e6 AS score, row_number() OVER (PARTITION BY fact_type ORDER BY epoch_us(event_date) / 1e6 DESC, unit_id) AS nth FROM facts WHERE status = 'active') n, search_queries WHERE nth <= 60),
  rk AS (SELECT query_id, kind, id, rank() OVER (PARTITION BY query_id, kind ORDER BY score) AS rank FROM tp UNION ALL SELECT query_id, kind, id, rank() OVER (PARTITION BY query_id, kind ORDER BY score DESC) FROM tn),
  fz AS (SELECT query_id, kind, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk GROUP BY 1, 2, 3),
  mm AS (SELECT query_id, 'mental_model' AS kind, unit_id AS id, {COS} AS score FROM mv, search_queries),
  turn AS (SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS turn FROM fz UNION ALL SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) FROM mm),
  cut AS (SELECT *, list_position(['world', 'event', 'observation', 'mental_model'], kind) AS bucket FROM turn WHERE turn <= 20),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY turn, bucket) AS seen FROM cut) WHERE seen = 1),
  placed AS (SELECT query_id, id, kind, row_number() OVER (PARTITION BY query_id ORDER BY turn, bucket) AS place FROM once)"""
#: Mental models: one for each of fifty entities, with ids of their own.
MODEL = "models AS (SELECT DISTINCT (user_id % 50) * 3 AS vec_id, user_id % 50 AS model_id FROM events), mv AS (SELECT -1 - model_id AS unit_id, embedding::DOUBLE[] AS embedding FROM models JOIN embeddings USING (vec_id))"


def _models(spark, d):
    m = views.table(spark, d, "events").select((F.col("user_id") % 50).alias("model_id")).distinct().withColumn("vec_id", F.col("model_id") * 3)
    return m.join(views.table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").select((-1 - F.col("model_id")).alias("unit_id"), "embedding")


@query(sql(f"WITH {MODEL}, {TYPED} SELECT * FROM placed WHERE place <= 40", "facts", "search_queries"))
def partitioned_rrf(spark, d):
    """Each type of fact has its own pools and fusion; types and mental models then take turns."""
    units, asked = _active(spark, d).withColumnRenamed("fact_type", "kind"), views.search_queries(spark, d)
    pools = {"semantic": strategies.semantic(units, asked, by=("kind",)), "temporal": strategies.temporal(units, asked, by=("kind",))}
    models = strategies.semantic(_models(spark, d), asked)
    return fusion.fuse_partitioned(pools, KIND_ORDER, 20, 40, models=models).withColumn("place", F.col("place").cast("long"))


VARIANTS = f"""{SEMANTIC}, {TEMPORAL}, v AS (SELECT query_id, 2.0::DOUBLE AS weight, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1 AS position FROM sem UNION ALL SELECT query_id, 1.0, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 FROM tmp),
  b AS (SELECT query_id, id, sum(weight / (60 + position + 1)) AS score FROM v GROUP BY 1, 2)"""


@query(sql(f"WITH {VARIANTS} SELECT query_id, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM b) WHERE nth <= 15", "facts", "search_queries"))
def multi_query_fusion(spark, d):
    """The original query counts twice, its variant once."""
    from pyspark.sql.window import Window as W

    pools = _pools(spark, d, ("semantic", "temporal"))
    lists = [p.select("query_id", F.lit(n).alias("variant"), F.lit(w).alias("weight"), "id", (F.row_number().over(W.partitionBy("query_id").orderBy(o, "id")) - 1).alias("position")) for (n, p), w, o in zip(pools.items(), (2.0, 1.0), (F.asc("score"), F.desc("score")))]
    return fusion.fuse_variants(lists[0].unionByName(lists[1]), 15).select("query_id", "id", F.round("score", 9).alias("score"))


SIG = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-raw)))"


@query(sql(f"""WITH x AS (SELECT unit_id, value / 100.0 - 2 AS raw, {AGE} AS age, CASE WHEN unit_id % 3 > 0 THEN (unit_id % 10) / 10.0::DOUBLE END AS prox FROM facts)
  SELECT unit_id, round({SIG} * (1 + 0.2 * (coalesce(least(greatest(1.0 - age / 365.0, 0.1), 1.0), 0.5) - 0.5)) * (1 + 0.2 * (coalesce(prox, 0.5) - 0.5)), 6) AS boosted FROM x WHERE {SIG} >= 0.3""", "facts"))
def rerank_boosts(spark, d):
    """Sigmoid of a model's score (here a column) times recency and proximity, above a least score."""
    rows = views.facts(spark, d).withColumns({"raw": F.col("value") / 100.0 - 2, "prox": F.when(F.col("unit_id") % 3 > 0, (F.col("unit_id") % 10) / 10.0)})
    out = fusion.boost(rows, F.col("raw"), scoring.days_between(now(), F.col("event_date")), F.col("prox"), 0.3)
    return out.select("unit_id", F.round("boosted", 6).alias("boosted"))


@query(sql(f"WITH {SEMANTIC}, x AS (SELECT query_id, id, len(text) // 4 AS cost, sum(len(text) // 4) OVER (PARTITION BY query_id ORDER BY score, id) AS used FROM sem JOIN facts ON id = unit_id) SELECT query_id, id, CAST(cost AS BIGINT) AS cost, CAST(used AS BIGINT) AS used FROM x WHERE used <= 150", "facts", "search_queries"))
def token_budget(spark, d):
    """The longest prefix of each query's candidates within 150 rough tokens."""
    rows = _pools(spark, d, ("semantic",))["semantic"].join(views.facts(spark, d).select(F.col("unit_id").alias("id"), text.rough_tokens(F.col("text")).cast("long").alias("cost")), "id")
    return fusion.budget_prefix(rows, ["query_id"], [F.asc("score"), F.asc("id")], F.col("cost"), 150).select("query_id", "id", "cost", "used")


@query(sql(f"WITH {SEMANTIC}, p AS (SELECT * FROM sem WHERE nth <= 15) SELECT a.query_id, a.id AS a, b.id AS b, round(list_inner_product(x.embedding, y.embedding) / (sqrt(list_inner_product(x.embedding, x.embedding)) * sqrt(list_inner_product(y.embedding, y.embedding))), 6) AS cosine FROM p a JOIN p b ON a.query_id = b.query_id AND a.id < b.id JOIN facts x ON x.unit_id = a.id JOIN facts y ON y.unit_id = b.id", "facts", "search_queries"))
def cosine_matrix(spark, d):
    """Upper triangle of similarities of each query's 15 nearest units (a fixed pool)."""
    pool = filters.top_per_group(_pools(spark, d, ("semantic",))["semantic"], ["query_id"], [F.asc("score"), F.asc("id")], 15)
    pool = pool.join(views.facts(spark, d).select(F.col("unit_id").alias("id"), "embedding"), "id")
    return diversity.pairwise(pool).select("query_id", "a", "b", F.round(vector.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


ENT = "ents AS (SELECT unit_id, list(entity_id) AS es FROM fact_entities GROUP BY 1)"


@query(sql(f"WITH {SEMANTIC}, {ENT}, p AS (SELECT query_id, id, es FROM sem JOIN ents ON id = unit_id WHERE nth <= 15) SELECT a.query_id, a.id AS a, b.id AS b, round(len(list_intersect(a.es, b.es)) / len(list_distinct(list_concat(a.es, b.es)))::DOUBLE, 6) AS jaccard FROM p a JOIN p b ON a.query_id = b.query_id AND a.id < b.id", "facts", "search_queries", "fact_entities"))
def entity_jaccard_matrix(spark, d):
    pool = filters.top_per_group(_pools(spark, d, ("semantic",))["semantic"], ["query_id"], [F.asc("score"), F.asc("id")], 15)
    sets = views.fact_entities(spark, d).groupBy(F.col("unit_id").alias("id")).agg(F.collect_set("entity_id").alias("embedding"))
    pairs = diversity.pairwise(pool.join(sets, "id"))
    return pairs.select("query_id", "a", "b", F.round(diversity.jaccard(F.col("va"), F.col("vb")), 6).alias("jaccard"))


#: Greedy choice, a row of picks a round; the least fields that both forms need.
MMR = f"""{SEMANTIC}, {ENT}, pool AS (SELECT query_id, id, score, nth - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n, embedding, event_date, es FROM sem JOIN facts ON unit_id = id JOIN ents USING (unit_id)),
  sims AS (SELECT a.query_id, a.id AS a, b.id AS b, 0.6::DOUBLE * list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))) + 0.4::DOUBLE * len(list_intersect(a.es, b.es)) / len(list_distinct(list_concat(a.es, b.es))) AS sim FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.id <> b.id),
  rec AS (SELECT query_id, [id] AS picked FROM pool WHERE i = 0 UNION ALL
    SELECT query_id, list_append(picked, {{choice}}) FROM (SELECT r.query_id, r.picked, c.id, c.i, c.event_date, {{value}} AS v FROM rec r JOIN pool c ON c.query_id = r.query_id AND NOT list_contains(r.picked, c.id) JOIN sims s ON s.query_id = r.query_id AND s.a = c.id AND list_contains(r.picked, s.b) GROUP BY r.query_id, r.picked, c.id, c.i, c.event_date, c.n, c.score) WHERE len(picked) < 10 GROUP BY query_id, picked)
  SELECT query_id, unnest(picked) AS id, generate_subscripts(picked, 1) AS place FROM rec WHERE len(picked) = 10"""
LEAD = "(list_reduce(list({'v': v, 'd': event_date, 'id': id} ORDER BY i), lambda l, x: CASE WHEN x.v > l.v + 0.01 OR abs(x.v - l.v) <= 0.01 AND x.d > l.d THEN x ELSE l END)).id"


@query(sql("WITH " + MMR.format(choice=LEAD, value="0.9::DOUBLE * (c.n - c.i) / c.n - 0.1::DOUBLE * greatest(0.0, max(s.sim))"), "facts", "search_queries", "fact_entities", recursive=True))
def mmr_units(spark, d):
    """Greedy maximal marginal relevance over each query's 60 candidates."""
    return diversity.mmr_units(_mmr_pool(spark, d), limit=10)


@query(sql("WITH " + MMR.format(choice="(list({'v': round(v, 12), 'i': -i, 'id': id} ORDER BY round(v, 12) DESC, i))[1].id", value="0.8::DOUBLE * (1 - c.score) / (SELECT max(1 - p.score) FROM pool p WHERE p.query_id = c.query_id) - 0.2::DOUBLE * max(s.sim)").replace("c.n, c.score)", "c.n, c.score, c.query_id)"), "facts", "search_queries", "fact_entities", recursive=True))
def mmr_notes(spark, d):
    """Like ``mmr_units``, over scores divided by the best of each query."""
    return diversity.mmr_notes(_mmr_pool(spark, d).withColumn("score", 1.0 - F.col("score")), limit=10)


def _mmr_pool(spark, d):
    units = views.facts(spark, d).select(F.col("unit_id").alias("id"), "embedding", "event_date")
    sets = views.fact_entities(spark, d).groupBy(F.col("unit_id").alias("id")).agg(F.sort_array(F.collect_set("entity_id")).alias("entities"))
    return _pools(spark, d, ("semantic",))["semantic"].join(units, "id").join(sets, "id")


# ---------------------------------------------------------------- filters


@query(sql("SELECT unit_id FROM facts WHERE event_date >= TIMESTAMP '2024-01-05' AND event_date <= TIMESTAMP '2024-01-12' AND vault_id IN (0, 2) AND status = 'active' AND fact_type = 'world' AND context = 'context1'", "facts"))
def filtered_facts(spark, d):
    """Date range (ends included), vault scope, type, status and context."""
    f = views.facts(spark, d)
    keep = filters.date_between(F.col("event_date"), datetime(2024, 1, 5), datetime(2024, 1, 12)) & filters.in_vaults(F.col("vault_id"), [0, 2]) & filters.live_facts("world") & (F.col("context") == "context1")
    return f.where(keep).select("unit_id")


@query(sql("SELECT e1, e2, n FROM cooccurrences WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-10 12:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10 12:00:00')", "cooccurrences"))
def valid_as_of(spark, d):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return views.cooccurrences(spark, d).where(filters.valid_at(F.col("valid_from"), F.col("valid_to"), at)).select("e1", "e2", "n")


@query(sql("SELECT unit_id, round(confidence, 6) AS confidence FROM facts WHERE confidence >= 0.3", "facts"))
def not_superseded(spark, d):
    return views.facts(spark, d).where(F.col("confidence") >= 0.3).select("unit_id", F.round("confidence", 6).alias("confidence"))


@query(sql("SELECT unit_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM facts WHERE json_extract_string(props, '$.k') = '3'", "facts"))
def json_equality(spark, d):
    k = F.get_json_object("props", "$.k")
    return views.facts(spark, d).where(k == "3").select("unit_id", k.cast("long").alias("k"))


@query(sql("SELECT note_id FROM notes WHERE len(list_intersect(tags, ['en', 'src3'])) = 2", "notes"))
def tag_containment(spark, d):
    return views.notes(spark, d).where(filters.has_all_tags(F.col("tags"), ["en", "src3"])).select("note_id")


@query(sql("SELECT entity_id, name FROM entities WHERE name ILIKE '%no. 1%'", "entities"))
def contains_ignoring_case(spark, d):
    return views.entities(spark, d).where(F.col("name").ilike("%no. 1%")).select("entity_id", "name")


@query(sql("SELECT note_id, coalesce(publish_date, created_at) AS at FROM notes WHERE coalesce(publish_date, created_at) >= TIMESTAMP '2024-01-01'", "notes"))
def coalesced_note_date(spark, d):
    n = views.notes(spark, d).withColumn("at", filters.note_date())
    return n.where(filters.date_between(F.col("at"), datetime(2024, 1, 1))).select("note_id", "at")


@query(sql("WITH r AS (SELECT unit_id, entity_id FROM fact_entities WHERE unit_id IN (SELECT unit_id FROM facts WHERE status = 'active')) SELECT DISTINCT entity_id FROM r WHERE unit_id % 50 = 1", "facts", "fact_entities"))
def resonance(spark, d):
    """Entities of returned units."""
    back = _active(spark, d).where("unit_id % 50 = 1").select("unit_id")
    return views.fact_entities(spark, d).join(back, "unit_id", "left_semi").select("entity_id").distinct()


@query(sql(f"WITH {SEMANTIC} SELECT query_id, id, text, note_id, round(confidence, 6) AS confidence, coalesce(nl, 0) AS n_links FROM sem JOIN facts ON id = unit_id LEFT JOIN (SELECT from_id, count(*) AS nl FROM fact_links GROUP BY 1) ON from_id = id WHERE nth <= 10", "facts", "search_queries", "fact_links"))
def hydrate(spark, d):
    """Result ids joined with their rows and number of links."""
    top = filters.top_per_group(_pools(spark, d, ("semantic",))["semantic"], ["query_id"], [F.asc("score"), F.asc("id")], 10).select("query_id", "id")
    rows = views.facts(spark, d).select(F.col("unit_id").alias("id"), "text", "note_id", F.round("confidence", 6).alias("confidence"))
    n = views.fact_links(spark, d).groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"))
    return top.join(rows, "id").join(n, "id", "left").select("query_id", "id", "text", "note_id", "confidence", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
