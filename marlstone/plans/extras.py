"""Queries over formats, names, checks and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import formats, scoring, text
from marlstone.operators import dedup, evaluate, filters, fusion, notes
from marlstone.plans import views
from marlstone.plans.documents import MARKED, marked_documents
from marlstone.plans.ingest import COSINE
from marlstone.plans.registry import query
from marlstone.plans.retrieval import SEMANTIC, _pools
from marlstone.plans.views import NOW_SQL, now, sql, table
from marlstone.sources import readers


@query(sql("SELECT unit_id, concat_ws(' ', text, '(' || fact_type || ')', '[' || context || ']') AS line FROM facts", "facts"))
def embedding_texts(spark, d):
    return views.facts(spark, d).select("unit_id", formats.for_embedding(F.col("text"), F.col("fact_type"), F.col("context")).alias("line"))


@query(sql("SELECT unit_id, concat_ws(' ', '[' || strftime(event_date, '%Y-%m-%d') || ']', '[' || fact_type || ']', text) AS line FROM facts", "facts"))
def reranking_texts(spark, d):
    return views.facts(spark, d).select("unit_id", formats.for_reranking(F.col("text"), F.col("event_date"), F.col("fact_type")).alias("line"))


@query("SELECT doc_id, list_sort(list_distinct([lower(lang), lower(source), lower('New'), lower(lang)]))::VARCHAR AS tags FROM documents")
def merged_tags(spark, d):
    tags = formats.merged_tags(F.array("lang", "source"), F.array(F.lit("New"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(F.array_sort(tags), ", "), F.lit("]")).alias("tags"))


@query("SELECT doc_id, CASE WHEN contains(text, source) THEN text ELSE text || '; ' || source END[1:200] AS description FROM documents WHERE text <> ''")
def merged_descriptions(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", formats.merged_description(F.col("text"), F.col("source")).alias("description"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text FROM documents")
def truncated_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("text"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})', 1))) AS names FROM documents WHERE lang = 'en'")
def capitalised_names(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    return docs.select("doc_id", F.size(formats.capitalised_names(F.col("text"))).cast("long").alias("names"))


@query(f"WITH {MARKED}, h AS (SELECT doc_id, min(seq) AS seq FROM marked WHERE lvl = 1 GROUP BY 1) SELECT doc_id, 'Part ' || seq AS title FROM (SELECT DISTINCT doc_id FROM marked) LEFT JOIN h USING (doc_id)")
def h1_titles(spark, d):
    """The first top-level header of each marked document."""
    return marked_documents(spark, d).select("doc_id", formats.h1_title(F.col("text")).alias("title"))


@query(sql("SELECT entity_id, name FROM entities WHERE name ILIKE '%person%' ORDER BY mention_count DESC, entity_id LIMIT 1", "entities"))
def entity_by_text(spark, d):
    """The most mentioned entity whose name contains a text."""
    return views.entities(spark, d).where(F.col("name").ilike("%person%")).orderBy(F.desc("mention_count"), F.asc("entity_id")).limit(1).select("entity_id", "name")


@query(sql("SELECT entity_id, unit_id FROM (SELECT entity_id, unit_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, unit_id) AS nth FROM fact_entities WHERE entity_id IN (3, 104)) WHERE nth <= 100", "fact_entities"))
def units_of_entities(spark, d):
    ue = views.fact_entities(spark, d).where("entity_id IN (3, 104)")
    return filters.top_per_group(ue, ["entity_id"], [F.desc("event_date"), F.asc("unit_id")], 100).select("entity_id", "unit_id")


#: Days are scans, users are files: each is listed on the days on which it has events.
LISTINGS = "l AS (SELECT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS scan, max(event_id % 50) AS modified FROM events WHERE event_id % 3 > 0 GROUP BY ALL)"


@query(f"""WITH {LISTINGS}, s AS (SELECT a.user_id, a.scan FROM l a ANTI JOIN l b ON b.user_id = a.user_id AND b.scan = a.scan - 1),
  r AS (SELECT l.*, (SELECT max(s.scan) FROM s WHERE s.user_id = l.user_id AND s.scan <= l.scan) AS since FROM l),
  t AS (SELECT r.*, (SELECT max(o.modified) FROM l o WHERE o.user_id = r.user_id AND o.scan >= r.since AND o.scan < r.scan) AS told, (SELECT min(o.scan) FROM l o WHERE o.user_id = r.user_id) AS first FROM r)
  SELECT CAST(user_id AS VARCHAR) AS path, CAST(scan AS BIGINT) AS scan, CASE WHEN scan = first THEN 'new' WHEN scan = since THEN 'returning' ELSE 'changed' END AS change FROM t WHERE scan = since OR modified > told
  UNION ALL SELECT CAST(a.user_id AS VARCHAR), CAST(a.scan + 1 AS BIGINT), 'deleted' FROM l a ANTI JOIN l b ON b.user_id = a.user_id AND b.scan = a.scan + 1 WHERE a.scan < (SELECT max(scan) FROM l)""")
def folder_change_log(spark, d):
    """What each scan of a folder shows as new, changed, returning or deleted, for all scans at once."""
    e = table(spark, d, "events").where("event_id % 3 > 0")
    listed = e.select(F.col("user_id").cast("string").alias("path"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("scan"), (F.col("event_id") % 50).alias("modified"))
    return readers.change_log(listed)


@query("""WITH a AS (SELECT DISTINCT * FROM (SELECT p_name AS identifier FROM part UNION ALL SELECT CAST(p_partkey * 2 AS VARCHAR) FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT p_name || ' ' || p_partkey // 2 FROM part)),
  v AS (SELECT p_partkey AS vault_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_partkey // 2 END AS name FROM part)
  SELECT identifier, CASE WHEN i.vault_id IS NOT NULL OR n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state, coalesce(i.vault_id, CASE WHEN n = 1 THEN least_id END) AS vault_id
  FROM a LEFT JOIN v i ON CAST(i.vault_id AS VARCHAR) = identifier LEFT JOIN (SELECT name, count(*) AS n, min(vault_id) AS least_id FROM v GROUP BY 1) g ON g.name = identifier""")
def vault_resolve(spark, d):
    """Identifiers to vaults, by id or else by name; names of several vaults are ambiguous. Parts stand for vaults."""
    p = table(spark, d, "part")
    numbered = F.concat("p_name", F.lit(" "), F.floor(F.col("p_partkey") / 2).cast("string"))
    vaults = p.select(F.col("p_partkey").alias("vault_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(numbered).alias("name"))
    asked = p.select(F.explode(F.array("p_name", (F.col("p_partkey") * 2).cast("string"), numbered)).alias("identifier"))
    return notes.resolve_vaults(asked.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("identifier"))), vaults)


@query(sql(f"""WITH n AS (SELECT note_id % 300 AS vault_id, status, created_at, publish_date, template FROM notes), s AS (SELECT DISTINCT vault_id, template FROM n),
  r AS (SELECT vault_id, count(*) FILTER (WHERE created_at >= {NOW_SQL} - INTERVAL 7 DAY) AS d7, count(*) FILTER (WHERE created_at >= {NOW_SQL} - INTERVAL 30 DAY) AS d30, max(created_at) AS last, max(publish_date) AS latest FROM n WHERE status = 'active' GROUP BY 1),
  f AS (SELECT s.*, coalesce(d7, 0) AS last_7_days, coalesce(d30, 0) AS last_30_days, latest AS latest_date, CASE WHEN last IS NOT NULL THEN CAST(greatest(floor((epoch_us({NOW_SQL}) - epoch_us(last)) / 86400e6), 0) AS BIGINT) END AS days FROM s LEFT JOIN r USING (vault_id))
  SELECT vault_id, template AS theme, CASE WHEN days > 10 THEN 'dormant' ELSE 'growing' END AS trend, last_7_days, last_30_days, latest_date, days AS days_since_last_note FROM f""", "notes"))
def summary_freshness(spark, d):
    """Summaries as they read now: recent counts and days since the last active note; themes of vaults at rest for over ten days are dormant."""
    n = views.notes(spark, d).withColumn("vault_id", F.col("note_id") % 300)
    themes = n.groupBy("vault_id").agg(F.array_sort(F.collect_set(F.struct(F.col("template").alias("theme"), F.lit("growing").alias("trend")))).alias("themes"))  # of four templates
    fresh = notes.fresh_summaries(themes, n, now(), dormant_days=10)
    return fresh.select("vault_id", F.inline("themes"), "last_7_days", "last_30_days", "latest_date", "days_since_last_note")


@query("SELECT n_nationkey AS vault_id FROM nation WHERE n_name = (SELECT max(n_name) FROM nation) OR n_nationkey = 4")
def vault_lookup(spark, d):
    """Vaults by id or by name."""
    n = table(spark, d, "nation")
    name = n.agg(F.max("n_name").alias("wanted"))  # one row
    return n.crossJoin(F.broadcast(name)).where((F.col("n_name") == F.col("wanted")) | (F.col("n_nationkey") == 4)).select(F.col("n_nationkey").alias("vault_id"))


@query(sql(f"""WITH v AS (SELECT unit_id AS id, embedding FROM facts WHERE embedding IS NOT NULL AND status = 'active'), p AS (SELECT a.id, b.id AS other_id, {COSINE} AS similarity FROM v a, v b WHERE a.id % 100 = 1 AND a.id <> b.id)
  SELECT id, other_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other_id) AS nth FROM p WHERE similarity >= 0.1) WHERE nth <= 10""", "facts"))
def evidence_hunt(spark, d):
    """Ten active facts for the vector of each of a batch of observations (a hundredth of the ids), from a least similarity on."""
    v = views.facts(spark, d).where("status = 'active'").select(F.col("unit_id").alias("id"), "embedding")
    rows = dedup.similar_facts(v.where("id % 100 = 1"), v, least=0.1, k=10)
    return rows.select("id", "other_id", F.round("similarity", 6).alias("similarity"))


RESULTS = f"{SEMANTIC}, res AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS place, text FROM sem JOIN facts ON id = unit_id)"


def _results(spark, d):
    from pyspark.sql.window import Window as W

    hits = _pools(spark, d, ("semantic",))["semantic"].join(views.facts(spark, d).select(F.col("unit_id").alias("id"), "text"), "id")
    return hits.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("score", "id")).cast("long").alias("place"), "text")


def _words(spark, d):
    return views.search_queries(spark, d).select("query_id", F.explode(F.array(*map(F.lit, ("purchase", "signup", "page 7", "nothing like this")))).alias("keyword"))


@query(sql(f"WITH {RESULTS}, c AS (SELECT query_id, unnest(['purchase', 'signup', 'page 7', 'nothing like this']) AS keyword FROM search_queries) SELECT c.query_id || '/' || keyword AS check_id, coalesce(bool_or(contains(lower(text), lower(keyword))), false) AS found, min(place) FILTER (WHERE contains(lower(text), lower(keyword))) AS first, CASE WHEN coalesce(bool_or(contains(lower(text), lower(keyword))), false) = (keyword <> 'nothing like this') THEN 'pass' ELSE 'fail' END AS status FROM c LEFT JOIN res USING (query_id) GROUP BY c.query_id, keyword", "facts", "search_queries"))
def keyword_checks(spark, d):
    """Words that results must, or must not, hold."""
    checks = _words(spark, d).select(F.concat_ws("/", "query_id", "keyword").alias("check_id"), "query_id", "keyword", (F.col("keyword") != "nothing like this").alias("wanted"))
    return evaluate.keyword_checks(_results(spark, d), checks)


@query(sql(f"WITH {RESULTS}, p AS (SELECT query_id, min(place) FILTER (WHERE contains(lower(text), 'click')) AS a, min(place) FILTER (WHERE contains(lower(text), 'error')) AS b FROM res GROUP BY 1) SELECT query_id AS check_id, CASE WHEN a IS NULL OR b IS NULL THEN 'skip' WHEN a < b THEN 'pass' ELSE 'fail' END AS status FROM p", "facts", "search_queries"))
def ordering_checks(spark, d):
    pairs = views.search_queries(spark, d).select(F.col("query_id").alias("check_id"), "query_id", F.lit("click").alias("before"), F.lit("error").alias("after"))
    return evaluate.ordering_checks(_results(spark, d), pairs)


@query(sql("""WITH c AS (SELECT entity_id, 'person' AS wanted_type, entity_id % 40 + 100 AS other_id, entity_id % 5 * 400 AS least FROM entities UNION ALL SELECT 999, 'person', 100, 0),
  k AS (SELECT c.*, e.entity_type, e.mention_count, o.n FROM c LEFT JOIN entities e USING (entity_id) LEFT JOIN cooccurrences o ON o.e1 = least(c.entity_id, c.other_id) AND o.e2 = greatest(c.entity_id, c.other_id))
  SELECT entity_id, entity_type IS NOT NULL AS found, coalesce(entity_type = wanted_type, false) AS typed, coalesce(n, 0) > 0 AS together, coalesce(mention_count, 0) >= least AS mentioned FROM k""", "entities", "cooccurrences"))
def entity_checks(spark, d):
    """Whether entities are there, of the type wanted, seen with another, and mentioned often enough."""
    e = views.entities(spark, d)
    checks = e.select("entity_id", F.lit("person").alias("wanted_type"), (F.col("entity_id") % 40 + 100).alias("other_id"), (F.col("entity_id") % 5 * 400).alias("least"))
    missing = spark.range(999, 1000).select(F.col("id").alias("entity_id"), F.lit("person").alias("wanted_type"), F.lit(100).cast("long").alias("other_id"), F.lit(0).cast("long").alias("least"))
    return evaluate.entity_checks(checks.unionByName(missing), e, views.cooccurrences(spark, d))


@query("SELECT event_id, round(CASE WHEN (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) <= 0 THEN 1.0 ELSE pow(2.0::DOUBLE, greatest(-(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400e6 / 7.0, -996.0)) END, 6) AS decay FROM events")
def half_life_decay(spark, d):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.round(scoring.half_life(scoring.days_between(at, F.col("ts")), 7.0), 6).alias("decay"))


@query("WITH t AS (SELECT conv_id, turn, len(text) // 4 AS cost, sum(len(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS used FROM conversations) SELECT conv_id, count(*) AS turns, CAST(max(used) AS BIGINT) AS used FROM t WHERE used <= 200 GROUP BY 1")
def conversation_budget(spark, d):
    """The latest turns of each conversation within a budget."""
    t = table(spark, d, "conversations").withColumn("cost", F.floor(F.length("text") / 4))
    kept = fusion.budget_prefix(t, ["conv_id"], [F.desc("turn"), F.asc("text")], F.col("cost"), 200)
    return kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("used").cast("long").alias("used"))
