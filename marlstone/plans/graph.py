"""Queries over entities, co-occurrences, links and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import filters, graph, names, strategies
from marlstone.plans import views
from marlstone.plans.registry import query
from marlstone.plans.retrieval import EDGES, GRAMS, SIM
from marlstone.plans.views import sql, table

OP = "op AS (SELECT DISTINCT o_orderkey AS unit_id, l_partkey AS entity_id, o_orderdate AS event_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _tasks(spark, d):
    """By the lines of all orders; these make about two pairs each."""
    return filters.tasks_for(spark, table(spark, d, "lineitem").count())


def order_parts(spark, d):
    """Orders as units of parts: the large bipartite graph, dealt out by orders."""
    n = _tasks(spark, d)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("entity_id")).repartition(n, "o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey")
    return orders.hint("merge").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("unit_id"), "entity_id", F.col("o_orderdate").alias("event_date")).distinct()


PAIRS = f"{OP}, pairs AS (SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS n, min(a.event_date) AS valid_from, max(a.event_date) AS last FROM op a JOIN op b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"


@query(f"WITH {PAIRS} SELECT e1, e2, n, valid_from FROM pairs")
def cooccurrence_counts(spark, d):
    return graph.count_pairs(order_parts(spark, d), tasks=_tasks(spark, d)).select("e1", "e2", "n", "valid_from")


@query(f"""WITH {OP}, h AS (SELECT *, event_date < TIMESTAMP '1998-01-01' AS old FROM op), p AS (SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS n, min(a.event_date) AS valid_from FROM h a JOIN h b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id GROUP BY 1, 2)
  SELECT e1, e2, n, valid_from FROM p""")
def cooccurrence_upsert(spark, d):
    """Old counts merged with a batch's: the same as counting all at once."""
    op = order_parts(spark, d)
    old, new = (graph.count_pairs(op.where(c), tasks=_tasks(spark, d)) for c in ("event_date < TIMESTAMP_NTZ'1998-01-01 00:00:00'", "event_date >= TIMESTAMP_NTZ'1998-01-01 00:00:00'"))
    return graph.merge_pairs(old, new).select("e1", "e2", "n", "valid_from")


@query(f"WITH {PAIRS}, x AS (SELECT e1 AS a, e2 AS b, n FROM pairs UNION ALL SELECT e2, e1, n FROM pairs) SELECT a AS entity_id, CAST(sum(n) AS BIGINT) AS centrality FROM x GROUP BY 1")
def entity_centrality(spark, d):
    return graph.centrality(graph.count_pairs(order_parts(spark, d), tasks=_tasks(spark, d)))


@query(sql(f"WITH {EDGES}, c AS (SELECT entity_id, sum(n) AS centrality FROM edges GROUP BY 1) SELECT entity_id, round(0.4 * mention_count + 0.4 * retrieval_count + 0.2 * coalesce(centrality, 0), 6) AS rank_score FROM entities LEFT JOIN c USING (entity_id)", "entities", "cooccurrences"))
def entity_rank(spark, d):
    return graph.ranked_entities(views.entities(spark, d), views.cooccurrences(spark, d)).select("entity_id", F.round("rank_score", 6).alias("rank_score"))


@query(f"WITH {PAIRS}, x AS (SELECT e1 AS entity_id, e2 AS other_id, n FROM pairs UNION ALL SELECT e2, e1, n FROM pairs) SELECT entity_id, other_id, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, other_id) AS nth FROM x) WHERE nth <= 5")
def strongest_neighbours(spark, d):
    return graph.neighbours(graph.count_pairs(order_parts(spark, d), tasks=_tasks(spark, d)), 5, _tasks(spark, d))


@query(sql(f"WITH {EDGES} SELECT entity_id, other_id, n FROM edges WHERE entity_id = 7", "cooccurrences"))
def cooccurrences_of_one(spark, d):
    return strategies.directed(views.cooccurrences(spark, d)).where("entity_id = 7").select("entity_id", "other_id", "n")


@query(sql("SELECT e1, e2, n FROM cooccurrences WHERE e1 IN (1, 2, 3, 101, 102) AND e2 IN (1, 2, 3, 101, 102)", "cooccurrences"))
def cooccurrences_within_set(spark, d):
    some = [1, 2, 3, 101, 102]
    return views.cooccurrences(spark, d).where(F.col("e1").isin(some) & F.col("e2").isin(some)).select("e1", "e2", "n")


@query(sql("SELECT entity_id, unit_id, note_id, f.event_date FROM fact_entities fe JOIN facts f USING (unit_id) WHERE entity_id = 3", "facts", "fact_entities"))
def entity_mentions(spark, d):
    m = views.fact_entities(spark, d).where("entity_id = 3").select("entity_id", "unit_id")
    return m.join(views.facts(spark, d).select("unit_id", "note_id", "event_date"), "unit_id").select("entity_id", "unit_id", "note_id", "event_date")


@query(sql("SELECT entity_id, name, mention_count FROM entities ORDER BY mention_count DESC, entity_id LIMIT 10", "entities"))
def top_entities(spark, d):
    return views.entities(spark, d).orderBy(F.desc("mention_count"), F.asc("entity_id")).limit(10).select("entity_id", "name", "mention_count")


@query(sql("SELECT entity_id, name FROM entities WHERE name ILIKE '%concept%' ORDER BY mention_count DESC, entity_id LIMIT 5 OFFSET 5", "entities"))
def search_entities(spark, d):
    hits = views.entities(spark, d).where(F.col("name").ilike("%concept%"))
    return filters.page(hits, [F.desc("mention_count"), F.asc("entity_id")], 5, 5).select("entity_id", "name")


MODELS = "models AS (SELECT user_id % 50 AS entity_id, user_id % 3 AS vault_id, count(*) AS version FROM events WHERE event_type = 'error' GROUP BY 1, 2)"


def models(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy((F.col("user_id") % 50).alias("entity_id"), (F.col("user_id") % 3).alias("vault_id")).agg(F.count("*").alias("version"))


@query(sql(f"WITH {MODELS} SELECT e.entity_id, name, version FROM entities e LEFT JOIN models m ON m.entity_id = e.entity_id AND m.vault_id = 1", "entities"))
def entities_with_model(spark, d):
    """Left join on entity and vault."""
    m = models(spark, d).where("vault_id = 1").select("entity_id", "version")
    return views.entities(spark, d).join(m, "entity_id", "left").select("entity_id", "name", "version")


NOTE_ENT = "ne AS (SELECT DISTINCT doc_id // 10 AS note_id, hash_id AS entity_id FROM (SELECT doc_id, (doc_id * 31) % 97 AS hash_id FROM documents UNION ALL SELECT doc_id, (doc_id * 17) % 53 + 100 FROM documents)), nm AS (SELECT entity_id, count(*) AS mention_count FROM ne GROUP BY 1)"


def note_entities(spark, d):
    doc = table(spark, d, "documents")
    pairs = doc.select(F.floor(F.col("doc_id") / 10).cast("long").alias("note_id"), F.explode(F.array((F.col("doc_id") * 31) % 97, (F.col("doc_id") * 17) % 53 + 100)).alias("entity_id"))
    return pairs.distinct()


@query(f"""WITH {NOTE_ENT}, few AS (SELECT note_id, entity_id, mention_count FROM (SELECT ne.*, mention_count, row_number() OVER (PARTITION BY note_id ORDER BY mention_count, entity_id) AS nth FROM ne JOIN nm USING (entity_id) WHERE mention_count <= 20) WHERE nth <= 8),
  p AS (SELECT a.note_id, b.note_id AS other_id, count(*) AS shared, sum(1.0::DOUBLE / (1.0 + ln(1.0 + a.mention_count))) AS raw FROM few a JOIN few b ON a.entity_id = b.entity_id AND a.note_id <> b.note_id GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY round(raw, 9) DESC, other_id) AS nth FROM p)
  SELECT note_id, other_id, shared, round(raw / max(raw) OVER (PARTITION BY note_id), 3) AS score FROM t WHERE nth <= 5""")
def related_notes(spark, d):
    """Notes related by rare entities (a lower cap than the default, so that it bites)."""
    ne = note_entities(spark, d)
    rows = graph.related_notes(ne, ne.groupBy("entity_id").agg(F.count("*").alias("mention_count")), cap=20, rare=8)
    return rows.select("note_id", "other_id", "shared", "score")


@query(sql("SELECT unit_id, other_id, link_type, outgoing, weight FROM (SELECT from_id AS unit_id, to_id AS other_id, link_type, weight, true AS outgoing FROM fact_links UNION ALL SELECT to_id, from_id, link_type, weight, false FROM fact_links)", "fact_links"))
def unit_links(spark, d):
    return graph.links_both_ways(views.fact_links(spark, d)).select("unit_id", "other_id", "link_type", "outgoing", "weight")


@query(sql("""WITH b AS (SELECT a.note_id, b.note_id AS other_id, link_type, max(weight) AS weight FROM fact_links JOIN facts a ON a.unit_id = from_id JOIN facts b ON b.unit_id = to_id WHERE a.note_id <> b.note_id GROUP BY 1, 2, 3)
  SELECT note_id, other_id, link_type, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY weight DESC, other_id, link_type) AS nth FROM b) WHERE nth <= 5""", "facts", "fact_links"))
def note_links(spark, d):
    rows = graph.note_links(views.fact_links(spark, d), views.facts(spark, d).select("unit_id", "note_id"), 5)
    return rows.select("note_id", "other_id", "link_type", F.round("weight", 6).alias("weight"))


@query(sql("SELECT from_id, to_id, a.title AS from_title, b.title AS to_title FROM fact_links LEFT JOIN notes a ON a.note_id = from_id LEFT JOIN notes b ON b.note_id = to_id WHERE link_type = 'causes'", "fact_links", "notes"))
def link_titles(spark, d):
    """Both ends of a link with the titles there are."""
    t = views.notes(spark, d).select("note_id", "title")
    links = views.fact_links(spark, d).where("link_type = 'causes'")
    one = links.join(t.select(F.col("note_id").alias("from_id"), F.col("title").alias("from_title")), "from_id", "left")
    return one.join(t.select(F.col("note_id").alias("to_id"), F.col("title").alias("to_title")), "to_id", "left").select("from_id", "to_id", "from_title", "to_title")


@query(sql("SELECT unit_id, lag(unit_id) OVER w AS before_id, lead(unit_id) OVER w AS after_id FROM facts WINDOW w AS (PARTITION BY vault_id, fact_type ORDER BY event_date, unit_id)", "facts"))
def neighbours_in_time(spark, d):
    """The closest earlier and later fact of the same vault and type."""
    rows = graph.closest_in_time(views.facts(spark, d).select("unit_id", "vault_id", "fact_type", "event_date"), ["vault_id", "fact_type"])
    return rows.select("unit_id", "before_id", "after_id")


CHAIN = """edges AS (SELECT 'm' || entity_id AS parent, 'o' || entity_id || '-' || k AS child FROM (SELECT DISTINCT user_id % 50 AS entity_id, event_id % 4 AS k FROM events WHERE event_type = 'error')
  UNION SELECT 'o' || (user_id % 50) || '-' || (event_id % 4), 'u' || event_id FROM events WHERE event_type = 'error' UNION SELECT 'u' || event_id, 'n' || (event_id // 20) FROM events WHERE event_type = 'error')"""
KEPT = "kept AS (SELECT parent, child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS nth FROM edges) WHERE nth <= 10)"


def lineage_edges(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    m, k = F.col("user_id") % 50, F.col("event_id") % 4
    obs = F.concat(F.lit("o"), m, F.lit("-"), k)
    parts = [(F.concat(F.lit("m"), m), obs), (obs, F.concat(F.lit("u"), F.col("event_id"))), (F.concat(F.lit("u"), F.col("event_id")), F.concat(F.lit("n"), F.floor(F.col("event_id") / 20)))]
    return e.select(F.inline(F.array(*[F.struct(a.alias("parent"), b.alias("child")) for a, b in parts]))).distinct()


@query(f"WITH RECURSIVE {CHAIN}, {KEPT}, walk AS (SELECT DISTINCT parent AS root, parent AS node, NULL::VARCHAR AS parent, 0 AS level FROM edges WHERE parent LIKE 'm%' UNION SELECT w.root, k.child, k.parent, w.level + 1 FROM walk w JOIN kept k ON k.parent = w.node WHERE w.level < 3) SELECT root, node, parent, CAST(level AS BIGINT) AS level FROM walk")
def lineage_down(spark, d):
    """Model, observation, unit, note: three levels, ten children each."""
    edges = lineage_edges(spark, d)
    roots = edges.where("parent LIKE 'm%'").select(F.col("parent").alias("root")).distinct()
    return graph.lineage(edges, roots).withColumn("level", F.col("level").cast("long"))


@query(f"WITH RECURSIVE {CHAIN}, up AS (SELECT child AS parent, parent AS child FROM edges), kept AS (SELECT parent, child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS nth FROM up) WHERE nth <= 10), walk AS (SELECT DISTINCT parent AS root, parent AS node, NULL::VARCHAR AS parent, 0 AS level FROM up WHERE parent IN ('n1', 'n2', 'n3') UNION SELECT w.root, k.child, k.parent, w.level + 1 FROM walk w JOIN kept k ON k.parent = w.node WHERE w.level < 3) SELECT root, node, parent, CAST(level AS BIGINT) AS level FROM walk")
def lineage_up(spark, d):
    up = lineage_edges(spark, d).select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    roots = up.where(F.col("parent").isin("n1", "n2", "n3")).select(F.col("parent").alias("root")).distinct()
    return graph.lineage(up, roots).withColumn("level", F.col("level").cast("long"))


@query(sql(f"SELECT note_id, title, round({SIM.format(GRAMS.format('title'), GRAMS.format(chr(39) + 'the and attion to thanedble' + chr(39)))}, 6) AS score FROM notes WHERE {SIM.format(GRAMS.format('title'), GRAMS.format(chr(39) + 'the and attion to thanedble' + chr(39)))} >= 0.3", "notes"))
def fuzzy_title_search(spark, d):
    """Titles near a name in trigrams, by the set-similarity index."""
    asked = spark.createDataFrame([("the and attion to thanedble",)], "name string")
    hits = names.similar(asked, views.notes(spark, d).select("note_id", "title"), 0.3, known_name="title")
    return hits.select("known.note_id", "known.title", F.round("similarity", 6).alias("score"))


BENCH_NAMES = f"""bi AS (SELECT item_id, text[1:40] AS asked, {GRAMS.format('text[1:40]')} AS ag FROM benchmark), tn AS (SELECT note_id, title, {GRAMS.format('title')} AS tg FROM notes),
  pairs AS (SELECT item_id, note_id, {SIM.format('ag', 'tg')} AS score FROM bi, tn)"""


@query(sql(f"WITH {BENCH_NAMES} SELECT item_id, note_id, round(score, 6) AS score FROM pairs WHERE score >= 0.3", "notes"))
def similar_titles(spark, d):
    """All titles near the opening of each benchmark item."""
    asked = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("name"))
    hits = names.similar(asked, views.notes(spark, d).select("note_id", "title"), 0.3, known_name="title")
    return hits.select("asked.item_id", "known.note_id", F.round("similarity", 6).alias("score"))
