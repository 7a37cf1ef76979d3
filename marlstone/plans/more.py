"""Queries over chunk-level search, note changes, models, lookups and trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import formats, text, vector
from marlstone.operators import chunking, filters, links, maintenance, notes, strategies
from marlstone.plans import views
from marlstone.plans.registry import query
from marlstone.plans.retrieval import BASE, COS, DECAY, EDGES, LINKED, MODEL, SEEDS, SEMANTIC, _active, _linked, _models, _pools
from marlstone.plans.retrieval import semantic_entity_seeds as _seeds
from marlstone.plans.views import now, sql, table

CHUNKED = "SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM (SELECT query_id, chunk_id AS id, score FROM {hits} h JOIN facts ON unit_id = h.id JOIN chunks USING (note_id))) WHERE nth <= 60"
PATHS = "fact_entities fe JOIN {0} JOIN facts f USING (unit_id) JOIN chunks c USING (note_id)"
CHUNK_DECAY = DECAY.replace("event_date", "f.event_date")
#: Entity graphs over chunks: any unit counts, but only active chunks; nothing is merged.
CHUNK_GRAPH = f"""{EDGES}, reached AS (SELECT query_id, other_id, ln(n + 1.0::DOUBLE) / ln(mention_count + 2.0::DOUBLE) AS strength FROM edges JOIN seeds USING (entity_id) JOIN (SELECT entity_id AS other_id, mention_count FROM entities) USING (other_id)),
  cg AS (SELECT query_id, chunk_id AS id, weight + {CHUNK_DECAY} AS score FROM {PATHS.format('seeds USING (entity_id)')} WHERE c.status = 'active'
    UNION ALL SELECT query_id, chunk_id, strength FROM {PATHS.format('reached r ON fe.entity_id = r.other_id')} WHERE c.status = 'active'),
  gc AS (SELECT query_id, id, score FROM cg QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 60)"""
CHUNK_CAUSES = f"""mu AS (SELECT query_id, unit_id FROM fact_entities JOIN seeds USING (entity_id) JOIN facts USING (unit_id)),
  cc AS (SELECT query_id, chunk_id AS id, 1.0 + {CHUNK_DECAY} AS score FROM {PATHS.format('seeds USING (entity_id)')} WHERE c.status = 'active'
    UNION ALL SELECT query_id, chunk_id, weight * 0.8 FROM fact_links JOIN mu ON from_id = mu.unit_id JOIN facts t ON t.unit_id = to_id JOIN chunks c ON c.note_id = t.note_id
      WHERE link_type IN ('causes', 'caused_by', 'enables', 'prevents') AND weight >= 0.3 AND c.status = 'active')"""


def chunk_graph(spark, d):
    """Pool of chunks by the entity graph: units of any status, notes, active chunks; a row a path, cut once."""
    live, f = views.chunks(spark, d).where("status = 'active'").select("note_id", "chunk_id"), views.facts(spark, d)
    units = notes.with_first_chunk(f.select("unit_id", "note_id", "event_date"), live)
    hits = strategies.cooccurrence_graph(units, views.fact_entities(spark, d), views.entities(spark, d), views.cooccurrences(spark, d), _seeds(spark, d), now(), tie="first_chunk")
    return notes.to_chunks(hits, f, live)


@query(sql(f"WITH {SEEDS}, {CHUNK_GRAPH} SELECT query_id, id, round(score, 6) AS score FROM gc", *BASE, "chunks"))
def chunk_cooccurrence_graph(spark, d):
    return chunk_graph(spark, d).select("query_id", "id", F.round("score", 6).alias("score"))


@query(sql(f"WITH {SEEDS}, {CHUNK_CAUSES} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM cc) WHERE nth <= 60", "facts", "search_queries", "fact_entities", "fact_links", "chunks"))
def chunk_causal_graph(spark, d):
    """As chunk_cooccurrence_graph, by causal links; a row a path."""
    live, f = views.chunks(spark, d).where("status = 'active'").select("note_id", "chunk_id"), views.facts(spark, d)
    units = notes.with_first_chunk(f.select("unit_id", "note_id", "event_date"), live)
    hits = strategies.causal_graph(units, views.fact_entities(spark, d), views.fact_links(spark, d), _seeds(spark, d), now(), tie="first_chunk", merge=False, sources=f)
    return notes.to_chunks(hits, f, live).select("query_id", "id", F.round("score", 6).alias("score"))


@query(sql(f"WITH {SEEDS}, {LINKED.format(pool=120)} " + CHUNKED.format(hits="linked").replace("USING (note_id)", "USING (note_id) WHERE chunks.status = 'active'"), "facts", "search_queries", "fact_entities", "entity_links", "chunks"))
def chunk_link_expansion(spark, d):
    """Link expansion at twice the pool, carried from units through notes to active chunks; rows are not merged."""
    rows = notes.to_chunks(_linked(spark, d, 120), views.facts(spark, d).select("unit_id", "note_id"), views.chunks(spark, d).where("status = 'active'"))
    return rows.select("query_id", "id", F.round("score", 6).alias("score"))


@query(sql(f"WITH {MODEL}, s AS (SELECT query_id, unit_id AS id, {COS} AS score FROM mv, search_queries) SELECT query_id, id, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS nth FROM s) WHERE nth <= 20", "search_queries"))
def mental_model_candidates(spark, d):
    hits = strategies.semantic(_models(spark, d), views.search_queries(spark, d), pool=20)
    return hits.select("query_id", "id", (F.round("score", 6) + 0.0).alias("score"))


@query("SELECT entity_id, 1.0::DOUBLE AS score FROM (SELECT DISTINCT user_id % 50 AS entity_id FROM events) WHERE 'model of ' || entity_id ILIKE '%OF 1%'")
def mental_model_by_name(spark, d):
    """Without a vector, models are found by name with score 1."""
    m = table(spark, d, "events").select((F.col("user_id") % 50).alias("entity_id")).distinct()
    return m.where(F.concat(F.lit("model of "), F.col("entity_id")).ilike("%OF 1%")).select("entity_id", F.lit(1.0).alias("score"))


@query(sql(f"WITH {SEMANTIC}, p AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY -score DESC, id) AS place FROM sem), s AS (SELECT *, CASE WHEN place <= 30 THEN 1.0 / (1.0 + exp(-((id % 11) - 5) / 2.0)) END AS sg FROM p) SELECT query_id, id, place, round(coalesce(sg, min(sg) OVER (PARTITION BY query_id) - (place - 30) * 0.000001), 6) AS reranked FROM s", "facts", "search_queries"))
def note_rerank(spark, d):
    """The first 30 by a model's score (a column here), the others just below them."""
    rows = _pools(spark, d, ("semantic",))["semantic"].withColumn("score", -F.col("score"))
    return notes.rerank(rows, ((F.col("id") % 11) - 5) / 2.0).select("query_id", "id", F.col("place").cast("long").alias("place"), F.round("reranked", 6).alias("reranked"))


CHANGES = "ch AS (SELECT note_id, CASE note_id % 4 WHEN 0 THEN 'superseded' WHEN 1 THEN 'archived' WHEN 2 THEN 'active' ELSE 'appended' END AS new_status, note_id + 7 AS linked_id FROM notes WHERE note_id % 3 = 0)"


def _changes(spark, d):
    i = F.col("note_id") % 4
    return views.notes(spark, d).where("note_id % 3 = 0").select("note_id", F.when(i == 0, "superseded").when(i == 1, "archived").when(i == 2, "active").otherwise("appended").alias("new_status"), (F.col("note_id") + 7).alias("linked_id"))


@query(sql(f"""WITH {CHANGES} SELECT note_id, coalesce(new_status, status) AS status, CASE WHEN new_status = 'superseded' THEN linked_id WHEN new_status = 'active' THEN NULL WHEN status = 'superseded' THEN note_id + 1 END AS superseded_by,
  CASE WHEN new_status = 'appended' THEN linked_id WHEN new_status = 'active' THEN NULL WHEN note_id % 2 = 0 THEN note_id + 2 END AS appended_to, CASE WHEN new_status = 'active' THEN NULL ELSE summary_version END AS summary_version FROM notes LEFT JOIN ch USING (note_id)""", "notes"))
def note_status_changes(spark, d):
    """Status and the pointers that go with it."""
    i = F.col("note_id")
    n = views.notes(spark, d).select(i, "status", "summary_version", F.when(F.col("status") == "superseded", i + 1).alias("superseded_by"), F.when(i % 2 == 0, i + 2).alias("appended_to"))
    return notes.set_status(n, _changes(spark, d)).select("note_id", "status", "superseded_by", "appended_to", "summary_version")


@query(sql(f"WITH {CHANGES} SELECT unit_id, CASE WHEN new_status IN ('superseded', 'archived') THEN 'stale' WHEN new_status = 'active' THEN 'active' ELSE status END AS status FROM facts LEFT JOIN ch USING (note_id)", "facts", "notes"))
def note_status_cascade(spark, d):
    return notes.cascade_status(views.facts(spark, d).select("unit_id", "note_id", "status"), _changes(spark, d).select("note_id", "new_status")).select("unit_id", "status")


@query(sql("SELECT unit_id, event_date + CASE WHEN publish_date IS NOT NULL THEN created_at - publish_date ELSE to_days(0) END AS event_date FROM facts LEFT JOIN notes USING (note_id)", "facts", "notes"))
def publish_date_shift(spark, d):
    """Units move with their note's date."""
    moved = views.notes(spark, d).where("publish_date IS NOT NULL").select("note_id", F.col("publish_date").alias("old_date"), F.col("created_at").alias("new_date"))
    return notes.shift_dates(views.facts(spark, d).select("unit_id", "note_id", "event_date"), moved, ["event_date"]).select("unit_id", "event_date")


@query(sql("SELECT unit_id, CASE WHEN note_id % 5 = 0 THEN 9 ELSE vault_id END AS vault_id FROM facts", "facts"))
def vault_migration(spark, d):
    f, n = views.facts(spark, d).select("unit_id", "note_id", "vault_id"), views.notes(spark, d).select("note_id", "vault_id")
    ids = f.where("note_id % 5 = 0").select("note_id").distinct()
    return notes.migrate({"units": f, "notes": n}, ids, 9)["units"].select("unit_id", F.col("vault_id").cast("long").alias("vault_id"))


MOVED = """ue AS (SELECT unit_id, entity_id, vault_id FROM fact_entities UNION ALL SELECT unit_id, 1000 + note_id, vault_id FROM facts), co AS (SELECT a.entity_id AS e1, b.entity_id AS e2, a.vault_id, count(*) AS n FROM ue a JOIN ue b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id GROUP BY 1, 2, 3),
  gone AS (SELECT unit_id FROM facts WHERE note_id % 5 = 0 AND vault_id <> 2), touched AS (SELECT DISTINCT entity_id, vault_id FROM ue JOIN gone USING (unit_id)), remains AS (SELECT DISTINCT entity_id, vault_id FROM ue WHERE unit_id NOT IN (SELECT unit_id FROM gone)),
  co2 AS (SELECT * FROM co WHERE (e1, vault_id) NOT IN (SELECT (entity_id, vault_id) FROM touched) AND (e2, vault_id) NOT IN (SELECT (entity_id, vault_id) FROM touched)),
  ev AS (SELECT ue.entity_id, ue.vault_id, ue.unit_id FROM ue WHERE (entity_id, vault_id) NOT IN (SELECT (entity_id, vault_id) FROM touched) OR ((entity_id, vault_id) IN (SELECT (entity_id, vault_id) FROM remains) AND unit_id NOT IN (SELECT unit_id FROM gone)))"""


@query(sql(f"WITH {MOVED} SELECT v.vault_id, (SELECT count(*) FROM co2 WHERE co2.vault_id = v.vault_id) AS pairs, (SELECT count(DISTINCT entity_id) FROM ev WHERE ev.vault_id = v.vault_id) AS models, (SELECT count(*) FROM ev WHERE ev.vault_id = v.vault_id) AS evidence FROM (SELECT DISTINCT vault_id FROM ue) v", "facts", "fact_entities"))
def vault_migration_cleanup(spark, d):
    """What is left in each vault when a fifth of the notes have moved to vault 2: co-occurrences, models and their evidence."""
    f = views.facts(spark, d).select("unit_id", "note_id", "vault_id")
    ue = views.fact_entities(spark, d).select("unit_id", "entity_id", "vault_id").unionByName(f.select("unit_id", (F.col("note_id") + 1000).alias("entity_id"), "vault_id"))
    pairs = ue.select("unit_id", F.col("entity_id").alias("e1"), "vault_id").join(ue.select("unit_id", F.col("entity_id").alias("e2")), "unit_id").where("e1 < e2").groupBy("e1", "e2", "vault_id").agg(F.count("*").alias("n"))
    obs = ue.groupBy("entity_id", "vault_id").agg(F.collect_list(F.struct("unit_id")).alias("evidence"))
    models = obs.select(F.concat_ws("/", "entity_id", "vault_id").alias("model_id"), "entity_id", "vault_id", F.array(F.struct(F.lit("all").alias("title"), "evidence")).alias("observations"))
    out = notes.leave_vaults(f.where("note_id % 5 = 0").select("note_id"), 2, f, ue, pairs, models)
    n_pairs = out["cooccurrences"].groupBy("vault_id").agg(F.count("*").alias("pairs"))
    size = F.aggregate("observations", F.lit(0), lambda n, o: n + F.size(o["evidence"]))
    n_models = out["models"].withColumn("e", size).groupBy("vault_id").agg(F.count("*").alias("models"), F.sum("e").cast("long").alias("evidence"))
    zero = F.lit(0).cast("long")
    vaults = ue.select("vault_id").distinct().join(n_pairs, "vault_id", "left").join(n_models, "vault_id", "left")
    return vaults.select("vault_id", *[F.coalesce(c, zero).alias(c) for c in ("pairs", "models", "evidence")])


@query(sql("SELECT unit_id, event_date + to_seconds(10 * (row_number() OVER (PARTITION BY note_id ORDER BY unit_id) - 1)) AS event_date FROM facts", "facts"))
def fact_time_offsets(spark, d):
    """Facts of one note ten seconds apart, in their order."""
    return notes.spread_times(views.facts(spark, d).select("unit_id", "note_id", "event_date"), ["note_id"], "unit_id", ["event_date"]).select("unit_id", "event_date")


@query(sql("""WITH s AS (SELECT unnest([0, 1, 2]) AS vault_id, unnest([1, 0, 4]) AS version, unnest([false, true, false]) AS marked), v AS (SELECT unnest([0, 1, 2, 3]) AS vault_id), n AS (SELECT vault_id, CASE WHEN note_id % 9 > 0 THEN summary_version END AS sv FROM notes WHERE status = 'active' AND vault_id < 2 UNION ALL SELECT 2, 4)
  SELECT v.vault_id, coalesce(marked, false) OR EXISTS (SELECT 1 FROM n WHERE n.vault_id = v.vault_id AND (version IS NULL OR sv IS NULL OR sv < version)) AS stale FROM v LEFT JOIN s USING (vault_id)""", "notes"))
def stale_vault_summaries(spark, d):
    """Vaults whose summary has to be made again."""
    summaries = spark.createDataFrame([(0, 1, False), (1, 0, True), (2, 4, False)], "vault_id long, version long, needs_regeneration boolean")
    n = views.notes(spark, d).where("vault_id < 2").select("vault_id", "status", F.when(F.col("note_id") % 9 > 0, F.col("summary_version")).alias("summary_version"))
    done = spark.createDataFrame([(2, "active", 4)], "vault_id long, status string, summary_version long")
    return notes.stale_summaries(spark.range(4).select(F.col("id").alias("vault_id")), n.unionByName(done), summaries)


@query("""WITH o AS (SELECT user_id AS model_id, user_id % 3 AS vault_id, event_type AS title, CASE event_type WHEN 'purchase' THEN 'strengthening' WHEN 'signup' THEN 'new' WHEN 'click' THEN 'stable' WHEN 'view' THEN 'weakening' WHEN 'error' THEN 'stale' END AS trend FROM (SELECT DISTINCT user_id, event_type FROM events)),
  r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY coalesce(list_position(['new', 'strengthening', 'weakening', 'stable', 'stale'], coalesce(trend, 'stable')), 4), title) AS nth FROM o),
  m AS (SELECT vault_id, model_id, sum(CASE coalesce(trend, 'stable') WHEN 'new' THEN 3.0::DOUBLE WHEN 'strengthening' THEN 2.0 WHEN 'weakening' THEN 1.5 WHEN 'stable' THEN 0.5 ELSE 0.0 END) AS importance, string_agg(coalesce(trend, 'stable') || ': ' || title, ' | ' ORDER BY nth) FILTER (WHERE nth <= 2) AS trends FROM r GROUP BY 1, 2)
  SELECT * FROM (SELECT vault_id, row_number() OVER (PARTITION BY vault_id ORDER BY importance DESC, model_id) AS place, model_id, importance, trends FROM m) WHERE place <= 10""")
def briefing_models(spark, d):
    """The ten models that matter most to each vault, each with its two most urgent observations."""
    e = F.col("event_type")
    trend = F.when(e == "purchase", "strengthening").when(e == "signup", "new").when(e == "click", "stable").when(e == "view", "weakening").when(e == "error", "stale")
    o = table(spark, d, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(e.alias("title"), trend.alias("trend")))).alias("observations"))
    rows = notes.briefing_models(o.select(F.col("user_id").alias("model_id"), (F.col("user_id") % 3).alias("vault_id"), "observations"))
    return rows.select("vault_id", F.col("place").cast("long").alias("place"), "model_id", "importance", F.array_join("trends", " | ").alias("trends"))


@query("SELECT doc_id, trim(text) <> '' AND NOT contains(text, chr(0)) AND NOT starts_with(ltrim(text), '---' || chr(10)) AND octet_length(encode(text)) <= 200000 AS ok FROM documents")
def append_validation(spark, d):
    return table(spark, d, "documents").select("doc_id", notes.valid_delta(F.col("text")).alias("ok"))


@query("WITH j AS (SELECT o_custkey AS job_id, list(o_orderkey % 500) AS keys FROM orders GROUP BY 1), busy AS (SELECT DISTINCT unnest(keys) AS key FROM j WHERE job_id % 50 = 0) SELECT DISTINCT job_id FROM (SELECT job_id, unnest(keys) AS key FROM j WHERE job_id % 50 > 0) SEMI JOIN busy USING (key)")
def in_flight_overlap(spark, d):
    j = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.collect_list(F.col("o_orderkey") % 500).alias("keys"))
    return notes.overlapping_jobs(j.where("job_id % 50 > 0"), j.where("job_id % 50 = 0"))


@query("SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events")
def interrupted_jobs(spark, d):
    """Jobs found processing at a start have failed."""
    jobs = table(spark, d, "events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 3 == 0, "processing").otherwise("completed").alias("status"))
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "failed").otherwise(F.col("status")))


@query(sql("SELECT note_id, title FROM notes WHERE note_id = 17 OR sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = (SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM notes WHERE note_id = 20)", "notes"))
def lookup_by_id_or_hash(spark, d):
    n = views.notes(spark, d).withColumn("hash", text.content_hash(F.col("text")))
    wanted = n.where("note_id = 20").select(F.col("hash").alias("wanted"))  # one row
    rows = n.crossJoin(F.broadcast(wanted))
    return notes.either(rows, F.col("note_id") == 17, F.col("hash") == F.col("wanted")).select("note_id", "title")


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS number FROM f")
def citation_index(spark, d):
    rows = notes.citation_numbers(table(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return rows.select("user_id", "event_type", F.col("number").cast("long").alias("number"))


@query(sql("WITH h AS (SELECT note_id, seq * 400 AS start, seq * 400 + 20 AS \"end\", 4000 AS length FROM chunks WHERE seq % 3 = 0 AND seq < 10), n AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY note_id ORDER BY start), length) AS nxt FROM h) SELECT note_id, \"end\" AS start, nxt AS \"end\" FROM n WHERE (nxt - \"end\") / 4 >= 300", "chunks"))
def header_gaps(spark, d):
    h = views.chunks(spark, d).where("seq % 3 = 0 AND seq < 10").select("note_id", (F.col("seq") * 400).alias("start"), (F.col("seq") * 400 + 20).alias("end"), F.lit(4000).alias("length"))
    rows = notes.gaps(h, 300)
    return rows.select("note_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT source, CAST(sum(len(text) // 4) AS BIGINT) AS tokens, CASE WHEN sum(len(text) // 4) <= 8000 THEN 'single' WHEN sum(len(text) // 4) <= 80000 THEN 'batched' ELSE 'recursive' END AS tier FROM documents GROUP BY 1")
def summary_tiers(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.sum(text.rough_tokens(F.col("text"))).cast("long").alias("tokens"))
    return g.withColumn("tier", notes.summary_tier(F.col("tokens")))


@query("""SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 2.0::DOUBLE WHEN 'signup' THEN 3.0 WHEN 'click' THEN 0.5 WHEN 'view' THEN 1.5 ELSE CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.5 END END) AS importance FROM events GROUP BY 1 ORDER BY importance DESC, user_id LIMIT 20""")
def session_briefing(spark, d):
    """Models by trend-weighted importance (kinds of events stand for trends, and some have none)."""
    e = F.col("event_type")
    trend = F.when(e == "purchase", "strengthening").when(e == "signup", "new").when(e == "click", "stable").when(e == "view", "weakening").when(F.col("event_id") % 2 == 0, "stale")
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(trend.alias("trend"))).alias("o"))
    return g.select("user_id", notes.briefing_importance(F.col("o.trend")).alias("importance")).orderBy(F.desc("importance"), F.asc("user_id")).limit(20)


TREE = "tree AS (SELECT note_id, seq, CASE WHEN seq > 0 THEN (seq - 1) // 3 END AS parent, len(text) // 4 AS tokens FROM (SELECT note_id, text, row_number() OVER (PARTITION BY note_id ORDER BY seq) - 1 AS seq FROM chunks))"


def _tree(spark, d):
    seq = F.row_number().over(W.partitionBy("note_id").orderBy("seq")) - 1
    t = views.chunks(spark, d).select("note_id", seq.cast("long").alias("seq"), text.rough_tokens(F.col("text")).cast("long").alias("tokens"))
    return t.withColumn("parent", F.when(F.col("seq") > 0, F.floor((F.col("seq") - 1) / 3).cast("long")))


@query(sql(f"WITH {TREE}, up AS (SELECT note_id, seq AS node, seq AS anc, tokens FROM tree UNION ALL SELECT u.note_id, u.node, t.parent, u.tokens FROM up u JOIN tree t ON t.note_id = u.note_id AND t.seq = u.anc WHERE t.parent IS NOT NULL) SELECT note_id, anc AS seq, CAST(sum(tokens) AS BIGINT) AS tokens FROM up GROUP BY 1, 2", "chunks", recursive=True))
def subtree_tokens(spark, d):
    """Tokens of each section with all below it: pre-summed on the way up."""
    return chunking.subtree_totals(_tree(spark, d), ["note_id"]).select("note_id", "seq", F.col("total").alias("tokens"))


@query(sql(f"WITH {TREE} SELECT note_id, seq FROM tree WHERE parent IS NULL OR parent = 0", "chunks"))
def toc_two_levels(spark, d):
    return _tree(spark, d).where("parent IS NULL OR parent = 0").select("note_id", "seq")


@query(sql("SELECT unit_id, md5(lower(trim(text))) AS fingerprint FROM facts WHERE length(text) > 0", "facts"))
def fingerprints(spark, d):
    return views.facts(spark, d).where("length(text) > 0").select("unit_id", F.md5(F.lower(F.trim("text"))).alias("fingerprint"))


@query("""WITH n AS (SELECT DISTINCT user_id || ':' || event_type AS name FROM events), h AS (SELECT name, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS h FROM n)
  SELECT name, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INT & 63) | 128) || h[19:20] || '-' || h[21:32] AS id FROM h""")
def virtual_observations(spark, d):
    """Observations of models as rows of their own, with version-5 UUIDs of model and title."""
    f = views.facts(spark, d).select(F.concat(F.col("user_id"), F.lit(":"), F.col("event_type")).alias("name")).distinct()
    return f.select("name", notes.uuid_of(F.col("name")).alias("id"))


@query(sql("SELECT unit_id, fact_type FROM facts WHERE status = 'active' AND event_date >= TIMESTAMP '2030-01-01' UNION ALL SELECT unit_id, fact_type FROM facts WHERE status = 'active' AND vault_id = 1", "facts"))
def temporal_fallback(spark, d):
    """A date range without hits is dropped and the search done again."""
    live = _active(spark, d).where("vault_id = 1").select("unit_id", "fact_type", "event_date")
    ranged = live.where("event_date >= TIMESTAMP_NTZ'2030-01-01 00:00:00'")
    return (live if ranged.isEmpty() else ranged).select("unit_id", "fact_type")


@query(sql("""WITH fl AS (SELECT unit_id, vault_id, embedding FROM facts WHERE unit_id % 100 = 0), sh AS (SELECT DISTINCT fl.unit_id, o.unit_id AS other_id FROM fl JOIN fact_entities m ON m.unit_id = fl.unit_id JOIN fact_entities o ON o.entity_id = m.entity_id AND o.vault_id = fl.vault_id JOIN facts f ON f.unit_id = o.unit_id AND f.status = 'active'),
  ne AS (SELECT unit_id, other_id FROM (SELECT fl.unit_id, f.unit_id AS other_id, list_inner_product(fl.embedding, f.embedding) / (sqrt(list_inner_product(fl.embedding, fl.embedding)) * sqrt(list_inner_product(f.embedding, f.embedding))) AS c, row_number() OVER (PARTITION BY fl.unit_id ORDER BY c DESC, f.unit_id) AS nth FROM fl JOIN facts f ON f.vault_id = fl.vault_id AND f.status = 'active' AND f.embedding IS NOT NULL AND fl.embedding IS NOT NULL AND f.unit_id <> fl.unit_id WHERE c > 0.3) WHERE nth <= 30),
  ev AS (SELECT * FROM sh UNION SELECT * FROM ne), t AS (SELECT ev.unit_id, other_id, f.note_id, row_number() OVER (PARTITION BY ev.unit_id, f.note_id ORDER BY other_id) AS turn FROM ev JOIN facts f ON f.unit_id = other_id WHERE ev.unit_id <> other_id)
  SELECT unit_id, other_id, place FROM (SELECT unit_id, other_id, row_number() OVER (PARTITION BY unit_id ORDER BY turn, note_id) AS place FROM t) WHERE place <= 15""", "facts", "fact_entities"))
def contradiction_candidates(spark, d):
    """Fifteen facts for each flagged one (ids divisible by 100) that share an entity or are near in meaning; notes take turns."""
    f = views.facts(spark, d).select("unit_id", "vault_id", "note_id", "status", "embedding")
    rows = links.contradiction_candidates(f.where("unit_id % 100 = 0"), f, views.fact_entities(spark, d), threshold=0.3)
    return rows.withColumn("place", F.col("place").cast("long"))


@query(sql("""WITH st AS (SELECT unit_id, note_id, (unit_id % 20 IN (3, 4)) AS hit FROM facts), te AS (SELECT DISTINCT entity_id FROM fact_entities fe JOIN st USING (unit_id) WHERE hit), ob AS (SELECT user_id % 50 AS entity_id, event_type AS title, unit_id FROM facts),
  lost AS (SELECT DISTINCT entity_id FROM ob JOIN st USING (unit_id) JOIN te USING (entity_id) WHERE hit), le AS (SELECT entity_id, count(*) AS n FROM ob JOIN st USING (unit_id) WHERE NOT (hit AND entity_id IN (SELECT entity_id FROM lost)) GROUP BY 1)
  SELECT entity_id, coalesce(n, 0) AS evidence_left, CASE WHEN entity_id IN (SELECT entity_id FROM lost) THEN 'pending' END AS status, CASE WHEN entity_id IN (SELECT entity_id FROM lost) THEN 1.0::DOUBLE END AS priority, (SELECT count(*) FROM st WHERE hit) AS stale_units
  FROM (SELECT DISTINCT entity_id FROM ob) LEFT JOIN le USING (entity_id)""", "facts", "fact_entities"))
def stale_cascade(spark, d):
    """Chunks go stale, and with them their facts, the evidence of these in models, and the models' place in the queue."""
    f = views.facts(spark, d)
    units = f.select("unit_id", F.lit("active").alias("status"), F.when(F.col("unit_id") % 20 < 3, 0).when(F.col("unit_id") % 20 < 5, 1).otherwise(2).alias("chunk_id"))
    obs = f.groupBy((F.col("user_id") % 50).alias("entity_id"), F.col("event_type").alias("title")).agg(F.collect_list(F.struct("unit_id")).alias("evidence"))
    models = obs.groupBy("entity_id").agg(F.collect_list(F.struct("title", "evidence")).alias("observations"))
    entities = views.entities(spark, d).select(F.col("entity_id").alias("key"), "mention_count", "retrieval_count")
    queue = entities.limit(0).select("key", F.lit(0).alias("evidence"), F.lit("").alias("status"), F.lit(0.0).alias("priority"), F.lit(0).alias("retries"))
    stale = spark.range(1, 2).select(F.col("id").cast("int").alias("chunk_id"))
    out = maintenance.stale_cascade(stale, units, views.fact_entities(spark, d), models, queue, entities, F.lit(1))
    n = out["models"].select("entity_id", F.inline_outer("observations")).groupBy("entity_id").agg(F.sum(F.coalesce(F.size("evidence"), F.lit(0))).cast("long").alias("evidence_left"))
    n = models.select("entity_id").join(n, "entity_id", "left").withColumn("evidence_left", F.coalesce("evidence_left", F.lit(0)))
    gone = out["units"].where("status = 'stale'").agg(F.count("*").alias("stale_units"))  # one row
    return n.join(out["queue"].select(F.col("key").alias("entity_id"), "status", "priority"), "entity_id", "left").crossJoin(F.broadcast(gone)).select("entity_id", "evidence_left", "status", "priority", "stale_units")


@query(sql("SELECT user_id AS model_id, count(*) AS observations FROM (SELECT user_id, event_type, list(unit_id) AS ids FROM facts GROUP BY 1, 2) GROUP BY 1 HAVING bool_or(list_contains(ids, 300) OR list_contains(ids, 77))", "facts"))
def models_citing_units(spark, d):
    """Models with an observation that has one of two units as evidence: a test of existence in nested arrays."""
    obs = views.facts(spark, d).groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("title")).agg(F.collect_list(F.struct("unit_id")).alias("evidence"))
    models = obs.groupBy("model_id").agg(F.collect_list(F.struct("title", "evidence")).alias("observations"))
    hit = filters.cites(F.col("observations"), F.lit(300)) | filters.cites(F.col("observations"), F.lit(77))
    return models.where(hit).select("model_id", F.size("observations").cast("long").alias("observations"))


@query("SELECT event_id, '{\"k\":' || CASE WHEN event_id % 3 = 0 THEN '1' ELSE '2' END || ',\"tags\":[\"' || event_type || '\",\"u' || (user_id % 3) || '\"]}' AS props FROM events")
def json_tags_set(spark, d):
    """The tags of a JSON object replaced; its other fields stay."""
    e = table(spark, d, "events")
    old = F.concat(F.lit('{"tags":["old"],"k":'), F.when(F.col("event_id") % 3 == 0, "1").otherwise("2"), F.lit("}"))
    return e.select("event_id", formats.with_json_tags(old, F.array(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id") % 3))).alias("props"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('day', ts) END AS at FROM events")
def parsed_times(spark, d):
    """ISO texts with Z, with an offset, as a bare day, and some that are none."""
    e, i = table(spark, d, "events"), F.col("event_id") % 4
    base = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    text_of = F.when(i == 0, F.concat(base, F.lit("Z"))).when(i == 1, F.concat(base, F.lit("+02:00"))).when(i == 2, F.date_format(F.col("ts"), "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return e.select("event_id", formats.parsed_time(text_of).alias("at"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), c AS (SELECT label, count(*) AS n, round(avg(list_inner_product(e, e)), 6) AS energy FROM v GROUP BY 1) SELECT * FROM c")
def vectors_by_label(spark, d):
    v = table(spark, d, "embeddings")
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vector.dot(F.col("embedding"), F.col("embedding"))), 6).alias("energy"))


@query("SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS last_week, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events")
def activity(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count_if(F.col("ts") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).alias("last_week"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def orders_by_nation(spark, d):
    """A star join: the dimension is small enough for the planner to broadcast by its own check."""
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(sql("SELECT unit_id, status = 'active' AND confidence BETWEEN 0 AND 1 AND fact_type IN ('world', 'event', 'observation') AND event_date IS NOT NULL AS ok FROM facts", "facts"))
def invariants(spark, d):
    """Checks that the stored rows keep their rules."""
    ok = (F.col("status") == "active") & F.col("confidence").between(0, 1) & F.col("fact_type").isin("world", "event", "observation") & F.col("event_date").isNotNull()
    return views.facts(spark, d).select("unit_id", ok.alias("ok"))


@query(sql("SELECT unit_id FROM facts ORDER BY md5('42:' || unit_id), unit_id LIMIT 20", "facts"))
def random_sample(spark, d):
    """A seeded sample of 20 facts: the least hashes, the same whatever the order of the input."""
    return filters.seeded_sample(views.facts(spark, d).select("unit_id"), "unit_id", 20, 42)


@query("WITH q AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'dead_letter' ELSE 'completed' END AS status, c_custkey % 4 AS retry_count FROM customer) SELECT key, CASE WHEN status = 'dead_letter' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead_letter' THEN 0 ELSE retry_count END AS retry_count FROM q")
def dead_letter_retry(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "dead_letter").otherwise("completed").alias("status"), (F.col("c_custkey") % 4).alias("retry_count"))
    return maintenance.retry(q).select("key", "status", "retry_count")
