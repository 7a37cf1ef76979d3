"""Queries over notes, catalogs, queues and stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, scoring, text
from marlstone.operators import filters, fusion, maintenance, strategies
from marlstone.operators.nearest import nearest
from marlstone.plans import views
from marlstone.plans.more import CHUNK_GRAPH, chunk_graph
from marlstone.plans.registry import query
from marlstone.plans.retrieval import BASE, COS, DENSITY, PLACED, SEEDS, TOKS
from marlstone.plans.views import NOW_SQL, now, sql, table

LATER = "TIMESTAMP '2024-01-28'"


def _later():
    return F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")


@query(sql("SELECT vault_id, count(*) AS notes, min(coalesce(publish_date, created_at)) AS first, max(coalesce(publish_date, created_at)) AS last, count(*) FILTER (WHERE age >= 0 AND age <= 7) AS last_7, count(*) FILTER (WHERE age >= 0 AND age <= 30) AS last_30, CAST(floor(min(age)) AS BIGINT) AS idle_days FROM (SELECT *, (epoch_us(" + NOW_SQL + ") - epoch_us(coalesce(publish_date, created_at))) / 86400e6 AS age FROM notes) WHERE status = 'active' GROUP BY 1", "notes"))
def vault_inventory(spark, d):
    return maintenance.inventory(views.notes(spark, d), filters.note_date(), now())


@query(sql("SELECT tag AS value, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY 1 ORDER BY n DESC, value LIMIT 15", "notes"))
def tag_counter(spark, d):
    return maintenance.top_values(views.notes(spark, d).select(F.explode("tags").alias("tag")), F.col("tag"), 15)


@query(sql("SELECT template AS value, count(*) AS n FROM notes GROUP BY 1 ORDER BY n DESC, value LIMIT 10", "notes"))
def template_counter(spark, d):
    return maintenance.top_values(views.notes(spark, d), F.col("template"), 10)


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def host_counter(spark, d):
    return maintenance.top_values(table(spark, d, "pages"), text.host(F.col("url")), 10)


@query(sql("SELECT vault_id, entity_id, n FROM (SELECT vault_id, entity_id, count(*) AS n, row_number() OVER (PARTITION BY vault_id ORDER BY count(*) DESC, entity_id) AS nth FROM fact_entities GROUP BY 1, 2) WHERE nth <= 10", "fact_entities"))
def vault_top_entities(spark, d):
    n = views.fact_entities(spark, d).groupBy("vault_id", "entity_id").agg(F.count("*").alias("n"))
    return filters.top_per_group(n, ["vault_id"], [F.desc("n"), F.asc("entity_id")], 10)


@query(sql("SELECT v.vault_id, count(n.note_id) AS notes, max(n.created_at) AS last FROM (SELECT unnest([0, 1, 2, 3]) AS vault_id) v LEFT JOIN notes n ON v.vault_id = n.vault_id GROUP BY 1", "notes"))
def vault_counts(spark, d):
    """Every vault, with or without notes."""
    vaults = spark.range(4).select(F.col("id").alias("vault_id"))
    g = vaults.join(views.notes(spark, d).select("vault_id", "note_id", "created_at"), "vault_id", "left").groupBy("vault_id").agg(F.count("note_id").alias("notes"), F.max("created_at").alias("last"))
    return g.orderBy(F.desc_nulls_last("last"), F.desc("notes"))


@query(sql("SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM facts) AS units, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM fact_links) AS links", "notes", "facts", "entities", "fact_links"))
def totals(spark, d):
    parts = {"notes": views.notes, "units": views.facts, "entities": views.entities, "links": views.fact_links}
    rows = None
    for name, view in parts.items():
        one = view(spark, d).agg(F.count("*").alias(name))
        rows = one if rows is None else rows.crossJoin(one)  # one row each
    return rows


@query(sql("SELECT DISTINCT note_id FROM facts WHERE unit_id % 17 = 0", "facts"))
def source_notes(spark, d):
    return views.facts(spark, d).where("unit_id % 17 = 0 AND note_id IS NOT NULL").select("note_id").distinct()


@query(sql("SELECT note_id, avg(CASE WHEN confidence < 0.3 THEN 1.0 ELSE 0.0 END) AS low, CASE WHEN avg(CASE WHEN confidence < 0.3 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'superseded' WHEN avg(CASE WHEN confidence < 0.3 THEN 1.0 ELSE 0.0 END) > 0 THEN 'partially_superseded' ELSE 'active' END AS state FROM facts GROUP BY 1", "facts"))
def note_status_by_confidence(spark, d):
    low = views.facts(spark, d).groupBy("note_id").agg((F.sum((F.col("confidence") < 0.3).cast("double")) / F.count("*")).alias("low"))
    return low.withColumn("state", maintenance.note_status(F.col("low")))


@query(sql(f"""WITH hit AS (SELECT from_id AS unit_id FROM fact_links WHERE link_type IN ('contradicts', 'weakens') UNION SELECT to_id FROM fact_links WHERE link_type IN ('contradicts', 'weakens'))
  SELECT unit_id, CASE WHEN unit_id % 23 = 0 OR unit_id IN (SELECT unit_id FROM hit) THEN 'contested' WHEN confidence < 0.5 THEN 'stale' WHEN day IS NULL THEN 'aging' WHEN day > 30 THEN 'stale' WHEN day >= 7 THEN 'aging' WHEN confidence >= 0.7 THEN 'fresh' ELSE 'aging' END AS flag
  FROM (SELECT unit_id, confidence, CASE WHEN unit_id % 29 > 0 THEN floor((epoch_us({LATER}) - epoch_us(event_date)) / 86400e6) END AS day FROM facts)""", "facts", "fact_links"))
def freshness_flags(spark, d):
    """Contested at either end of a link or superseded, else by confidence and age in whole days; some dates are missing here."""
    hit = maintenance.contested_units(views.fact_links(spark, d)).withColumn("hit", F.lit(True))
    f = views.facts(spark, d).join(hit, "unit_id", "left")
    date = F.when(F.col("unit_id") % 29 > 0, F.col("event_date"))
    flag = maintenance.freshness(F.col("unit_id") % 23 == 0, F.coalesce("hit", F.lit(False)), F.col("confidence"), scoring.days_between(_later(), date))
    return f.select("unit_id", flag.alias("flag"))


TREND_NOW = "TIMESTAMP '2024-02-14'"


@query(f"""WITH a AS (SELECT user_id, CASE WHEN event_id % 31 > 0 THEN (epoch_us({TREND_NOW}) - epoch_us(ts)) / 86400e6 ELSE 0 END AS age FROM events), c AS (SELECT user_id, count(*) FILTER (WHERE age < 30) AS recent, count(*) FILTER (WHERE age >= 30 AND age <= 90) AS middle, count(*) FILTER (WHERE age > 90) AS old FROM a GROUP BY 1)
  SELECT user_id, CASE WHEN recent = 0 THEN 'stale' WHEN old + middle = 0 THEN 'new' WHEN (recent / 30.0::DOUBLE) / ((old + middle) / 60.0::DOUBLE) > 1.5 THEN 'strengthening' WHEN (recent / 30.0::DOUBLE) / ((old + middle) / 60.0::DOUBLE) < 0.5 THEN 'weakening' ELSE 'stable' END AS trend FROM c""")
def evidence_trends(spark, d):
    """Evidence a day of the last 30 days against that of all older evidence over 60; a missing time counts as now."""
    at = F.when(F.col("event_id") % 31 > 0, F.col("ts"))
    # collect_list drops nulls, so the times are held in structs.
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(at.alias("at"))).alias("evidence"))
    return e.select("user_id", maintenance.trend(F.col("evidence.at"), F.lit("2024-02-14 00:00:00").cast("timestamp_ntz")).alias("trend"))


@query(sql("SELECT entity_id, round(0.5 * (mention_count % 7) + 0.2 * log10(greatest(mention_count, 1)) + 0.3 * log10(greatest(retrieval_count, 1)), 4) AS priority FROM entities", "entities"))
def reflection_priority(spark, d):
    return views.entities(spark, d).select("entity_id", scoring.priority(F.col("mention_count") % 7, F.col("mention_count"), F.col("retrieval_count")).alias("priority"))


DATED = "dated AS (SELECT unit_id, confidence, CASE WHEN unit_id % 13 > 0 THEN event_date END AS at FROM facts)"
VERDICTS = f"""{DATED}, v0 AS (SELECT to_id AS new_id, from_id AS existing_id, from_id AS place, CASE from_id % 3 WHEN 0 THEN 'reinforce' WHEN 1 THEN 'weaken' ELSE 'contradict' END AS relation, CASE from_id % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'new' WHEN 2 THEN 'neither' END AS hint FROM fact_links WHERE link_type IN ('semantic', 'causes')),
  v AS (SELECT v0.*, CASE WHEN hint IN ('new', 'existing') THEN hint WHEN n.at IS NOT NULL AND e.at IS NOT NULL AND n.at < e.at THEN 'existing' ELSE 'new' END AS winner FROM v0 JOIN dated n ON n.unit_id = new_id JOIN dated e ON e.unit_id = existing_id)"""


def _verdicts(spark, d):
    """(new_id, existing_id, place, relation, winner) for semantic and causal links, with the dates of the two units decided on."""
    f = views.facts(spark, d).select("unit_id", F.when(F.col("unit_id") % 13 > 0, F.col("event_date")).alias("at"))
    i = F.col("from_id")
    relation = F.when(i % 3 == 0, "reinforce").when(i % 3 == 1, "weaken").otherwise("contradict")
    hint = F.when(i % 4 == 0, "existing").when(i % 4 == 1, "new").when(i % 4 == 2, "neither")
    v = views.fact_links(spark, d).where("link_type IN ('semantic', 'causes')").select(F.col("to_id").alias("new_id"), i.alias("existing_id"), i.alias("place"), relation.alias("relation"), hint.alias("hint"))
    v = v.join(f.toDF("new_id", "new_at"), "new_id").join(f.toDF("existing_id", "existing_at"), "existing_id")
    return v.withColumn("winner", maintenance.authority(F.col("new_at"), F.col("existing_at"), F.col("hint")))


@query(sql(f"""WITH {VERDICTS}, moved AS (SELECT unnest([new_id, existing_id]) AS unit_id, 0.1::DOUBLE AS step, place, new_id, existing_id FROM v WHERE relation = 'reinforce'
    UNION ALL SELECT CASE WHEN winner = 'new' THEN existing_id ELSE new_id END, CASE relation WHEN 'weaken' THEN -0.1::DOUBLE ELSE -0.2::DOUBLE END, place, new_id, existing_id FROM v WHERE relation <> 'reinforce'),
  last AS (SELECT unit_id, step FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY place DESC, new_id DESC, existing_id DESC) AS nth FROM moved) WHERE nth = 1)
  SELECT unit_id, round(CASE WHEN step > 0 THEN least(confidence + step, 1.0) WHEN step < 0 THEN greatest(confidence + step, 0.0) ELSE confidence END, 6) + 0.0 AS confidence FROM dated LEFT JOIN last USING (unit_id)""", "facts", "fact_links"))
def confidence_updates(spark, d):
    """Verdicts on pairs of units: the loser is lowered, a reinforced pair is lifted, each from its stored value."""
    f = views.facts(spark, d).select("unit_id", "confidence")
    return maintenance.update_confidence(f, _verdicts(spark, d)).select("unit_id", (F.round("confidence", 6) + 0.0).alias("confidence"))


@query(sql(f"WITH {VERDICTS} SELECT new_id, existing_id, relation, winner FROM v", "facts", "fact_links"))
def contradiction_authority(spark, d):
    """Which unit of a pair stands: by the hint, or by date, of which either may be missing."""
    return _verdicts(spark, d).select("new_id", "existing_id", "relation", "winner")


@query(sql(f"""WITH o AS (SELECT user_id AS model_id, event_type AS title, list(unit_id ORDER BY unit_id) AS ids FROM facts GROUP BY 1, 2)
  SELECT model_id, title, len(list_filter(ids, lambda x: x % 10 <> 0)) AS left_over FROM o WHERE len(list_filter(ids, lambda x: x % 10 <> 0)) > 0""", "facts"))
def evidence_pruning(spark, d):
    """Evidence of stale units leaves the models, then the observations it empties."""
    f = views.facts(spark, d)
    obs = f.groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("title")).agg(F.collect_list(F.struct("unit_id")).alias("evidence"))
    models = obs.groupBy("model_id").agg(F.collect_list(F.struct("title", "evidence")).alias("observations"))
    rows = maintenance.prune_evidence(models, f.where("status = 'stale'").select("unit_id")).select("model_id", F.inline("observations"))
    return rows.select("model_id", "title", F.size("evidence").cast("long").alias("left_over"))


CITED = "obs AS (SELECT user_id AS model_id, event_type AS title, unit_id FROM facts)"


@query(sql(f"WITH {CITED} SELECT model_id, title, list(unit_id ORDER BY unit_id)::VARCHAR AS cited FROM obs WHERE unit_id % 2 = 0 GROUP BY 1, 2", "facts"))
def citations(spark, d):
    """Evidence of each observation that is in a result set."""
    f = views.facts(spark, d)
    obs = f.groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("title")).agg(F.collect_list("unit_id").alias("ids")).select("model_id", "title", F.explode("ids").alias("unit_id"))
    back = f.where("unit_id % 2 = 0").select("unit_id")
    g = obs.join(back, "unit_id", "left_semi").groupBy("model_id", "title").agg(F.sort_array(F.collect_list("unit_id")).alias("ids"))
    return g.select("model_id", "title", F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]")).alias("cited"))


@query(sql("SELECT user_id % 50 AS entity_id, unit_id, event_date FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_date DESC, unit_id) AS nth FROM facts) WHERE nth <= 20", "facts"))
def recent_facts_per_entity(spark, d):
    f = views.facts(spark, d).select((F.col("user_id") % 50).alias("entity_id"), "unit_id", "event_date")
    return filters.top_per_group(f, ["entity_id"], [F.desc("event_date"), F.asc("unit_id")], 20)


@query(sql("WITH t AS (SELECT vault_id, fact_type, unit_id, row_number() OVER (PARTITION BY vault_id, fact_type ORDER BY event_date DESC, unit_id) AS turn FROM facts), p AS (SELECT vault_id, unit_id, row_number() OVER (PARTITION BY vault_id ORDER BY turn, fact_type) AS place FROM t) SELECT * FROM p WHERE place <= 15", "facts"))
def diverse_round_robin(spark, d):
    """Types of facts take turns in each vault."""
    rows = views.facts(spark, d).select("vault_id", "fact_type", "unit_id", "event_date")
    return fusion.round_robin(rows, ["vault_id"], "fact_type", [F.desc("event_date"), F.asc("unit_id")], 15).select("vault_id", "unit_id", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- note search

CHUNK_TERMS = f"terms AS (SELECT unnest({TOKS.format(chr(39) + 'the thanea retion ondible licensed' + chr(39)) }) AS word), post AS (SELECT chunk_id, note_id, {PLACED.format('text')} FROM chunks), kw AS {DENSITY.format('chunk_id, note_id', 'post JOIN terms USING (word)')}"
NOTE_HITS = f"{CHUNK_TERMS}, k60 AS (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT * FROM kw ORDER BY score DESC, chunk_id LIMIT 60)), t60 AS (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT chunk_id, c.note_id, epoch_us(c.created_at) / 1e6 AS score FROM chunks c ORDER BY score DESC, chunk_id LIMIT 60)), f AS (SELECT chunk_id, note_id, sum(w / (60 + rank)) AS score FROM (SELECT chunk_id, note_id, 1.0::DOUBLE AS w, rank FROM k60 UNION ALL SELECT chunk_id, note_id, 0.5, rank FROM t60) GROUP BY 1, 2)"


def _note_pools(spark, d):
    """Pools of chunks by words and by date; the cut to a pool comes before anything is joined."""
    c = views.chunks(spark, d)
    asked = spark.range(1).select(F.lit(1).cast("long").alias("query_id"), F.lit("the thanea retion ondible licensed").alias("query_text"))
    return {"keyword": strategies.keyword(c, asked, id_col="chunk_id"), "temporal": strategies.temporal(c.withColumnRenamed("created_at", "event_date"), asked, id_col="chunk_id")}


@query(sql(f"WITH {NOTE_HITS} SELECT chunk_id, round(score, 9) AS score FROM f", "chunks", "notes"))
def chunk_fusion(spark, d):
    """Keyword and date branches over chunks, weights 1 and 0.5."""
    return fusion.fuse(_note_pools(spark, d), 1000, {"keyword": 1.0, "temporal": 0.5}).select(F.col("id").alias("chunk_id"), F.round("score", 9).alias("score"))


@query(sql(f"WITH {NOTE_HITS}, g AS (SELECT note_id, max(score) AS score, count(*) AS chunks FROM f GROUP BY 1) SELECT note_id, round(score, 9) AS score, chunks FROM g JOIN notes USING (note_id) WHERE coalesce(publish_date, created_at) >= TIMESTAMP '2023-12-10' AND list_contains(tags, 'en')", "chunks", "notes"))
def note_search(spark, d):
    """Best chunk of each note; date and tag filters come after fusion. A chunk's id tells its note."""
    hits = fusion.fuse(_note_pools(spark, d), 1000, {"keyword": 1.0, "temporal": 0.5})
    g = hits.groupBy(views.note_of(F.col("id")).alias("note_id")).agg(F.max("score").alias("score"), F.count("*").alias("chunks"))
    n = views.notes(spark, d).where((filters.note_date() >= F.lit("2023-12-10 00:00:00").cast("timestamp_ntz")) & filters.has_all_tags(F.col("tags"), ["en"]))
    return n.select("note_id").join(g, "note_id").select("note_id", F.round("score", 9).alias("score"), "chunks")


#: Chunk vectors: the first chunk of a note has the vector of the note's number.
CHUNK_VECTORS = "cv AS (SELECT chunk_id, note_id, embedding::DOUBLE[] AS embedding FROM chunks JOIN embeddings ON vec_id = note_id WHERE seq = 0)"
BRANCHES = f"""{CHUNK_VECTORS}, cs AS (SELECT * FROM (SELECT query_id, chunk_id AS id, {COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COS}, chunk_id) AS nth FROM cv, search_queries) WHERE nth <= 60),
  words AS (SELECT query_id, unnest({TOKS.format("query_text || ' ondible licensed retion'")}) AS word FROM search_queries), cpost AS (SELECT chunk_id AS id, {PLACED.format('text')} FROM chunks),
  ck0 AS {DENSITY.format('query_id, id', 'cpost JOIN words USING (word)')}, ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM ck0) WHERE nth <= 60),
  npost AS (SELECT node_id, block_id, {PLACED.format('text')} FROM nodes WHERE status = 'active'),
  cn0 AS {DENSITY.format('query_id, node_id, block_id', 'npost JOIN words USING (word)')}, cn AS (SELECT query_id, block_id AS id, score FROM cn0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 60),
  ct AS (SELECT query_id, id, score FROM (SELECT chunk_id AS id, epoch_us(publish_date) / 1e6 AS score FROM chunks WHERE publish_date IS NOT NULL ORDER BY score DESC, id LIMIT 60), search_queries),
  br AS (SELECT query_id, id, 1.0::DOUBLE AS w, rank() OVER (PARTITION BY query_id ORDER BY score) AS rank FROM cs UNION ALL SELECT query_id, id, 1.0, rank() OVER (PARTITION BY query_id ORDER BY score DESC) FROM ck
    UNION ALL SELECT query_id, id, 1.0, rank() OVER (PARTITION BY query_id ORDER BY score DESC) FROM cn
    UNION ALL SELECT query_id, id, 1.0, rank() OVER (PARTITION BY query_id ORDER BY score DESC) FROM gc UNION ALL SELECT query_id, id, 0.5, rank() OVER (PARTITION BY query_id ORDER BY score DESC) FROM ct),
  bf AS (SELECT query_id, id, sum(w / (60 + rank)) AS score FROM br GROUP BY 1, 2)"""


@query(sql(f"""WITH {SEEDS}, {CHUNK_GRAPH}, {BRANCHES}, best AS (SELECT query_id, id // 100000000 AS note_id, max(round(score, 9)) AS score FROM bf GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS place FROM best)
  SELECT query_id, place, note_id, title, score, (SELECT string_agg(text, chr(10) || chr(10) ORDER BY seq) FROM bf JOIN chunks c ON c.chunk_id = bf.id WHERE bf.query_id = top.query_id AND c.note_id = top.note_id) AS text FROM top JOIN notes USING (note_id) WHERE place <= 10""", *BASE, "chunks", "nodes"))
def note_search_branches(spark, d):
    """Semantic, keyword (over chunks and over nodes), graph and date branches, of weights 1, 1, 1 and 0.5; the ten best notes of each query with the text of the chunks found, in order."""
    from pyspark.sql.window import Window as W

    c, asked = views.chunks(spark, d), views.search_queries(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding")
    first = c.where("seq = 0").select("chunk_id", "note_id").join(vectors, "note_id")
    worded = asked.withColumn("query_text", F.concat("query_text", F.lit(" ondible licensed retion")))
    pools = {
        "semantic": strategies.semantic(first, asked, id_col="chunk_id"),
        "keyword": strategies.keyword(c, worded, id_col="chunk_id"),
        "nodes": strategies.keyword(views.nodes(spark, d).where("status = 'active'"), worded, id_col="node_id", by=()).select("query_id", F.split("id", ":")[0].cast("long").alias("id"), "score"),
        "graph": chunk_graph(spark, d),
        "temporal": strategies.temporal(c.where("publish_date IS NOT NULL").withColumnRenamed("publish_date", "event_date"), asked, id_col="chunk_id"),
    }
    hits = fusion.fuse(pools, 5 * strategies.POOL, {"temporal": 0.5}).withColumn("note_id", views.note_of(F.col("id"))).withColumn("score", F.round("score", 9))
    best = hits.groupBy("query_id", "note_id").agg(F.max("score").alias("score"), F.collect_list("id").alias("ids"))
    top = best.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "note_id")).cast("long")).where("place <= 10")
    found = top.select("query_id", "note_id", F.explode("ids").alias("chunk_id")).distinct().join(c.select("chunk_id", "seq", "text"), "chunk_id")
    text_of = found.groupBy("query_id", "note_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    rows = top.drop("ids").join(text_of, ["query_id", "note_id"]).join(views.notes(spark, d).select("note_id", "title"), "note_id")
    return rows.select("query_id", "place", "note_id", "title", "score", F.array_join("parts.text", "\n\n").alias("text"))


@query(sql("SELECT note_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM chunks WHERE status = 'active' GROUP BY 1", "chunks"))
def stitched_text(spark, d):
    c = views.chunks(spark, d).where("status = 'active'").groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return c.select("note_id", F.array_join("parts.text", "\n\n").alias("text"))


@query(sql("SELECT note_id, title FROM notes WHERE status = 'active' AND template = 'template2' ORDER BY created_at DESC, note_id LIMIT 20 OFFSET 20", "notes"))
def note_listing(spark, d):
    n = views.notes(spark, d).where("status = 'active' AND template = 'template2'")
    return filters.page(n, [F.desc("created_at"), F.asc("note_id")], 20, 20).select("note_id", "title")


@query(sql("SELECT note_id, summary_version FROM notes WHERE status = 'active' AND summary_version < 2 AND length(title) > 0", "notes"))
def summary_delta(spark, d):
    """Active notes that a summary has not yet taken in."""
    return views.notes(spark, d).where("status = 'active' AND summary_version < 2 AND length(title) > 0").select("note_id", "summary_version")


@query(sql("SELECT chunk_id, lag(text) OVER w AS before, lead(text) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY note_id ORDER BY seq)", "chunks"))
def neighbour_context(spark, d):
    """Text of the block before and after each block."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("note_id").orderBy("seq")
    return views.chunks(spark, d).select("chunk_id", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query(sql("""WITH ev AS (SELECT user_id AS model_id, event_id AS n, CASE WHEN event_id % 17 = 0 THEN event_id + 100000000 ELSE event_id END AS unit_id, 'user ' || user_id || ' did ' || CASE WHEN event_id % 6 = 0 THEN 'nothing' ELSE event_type END AS quote FROM events)
  SELECT model_id, n, CASE WHEN f.unit_id IS NULL THEN 'missing' WHEN contains(f.text, quote) THEN 'ok' ELSE 'absent' END AS verdict FROM ev LEFT JOIN facts f USING (unit_id)""", "facts"))
def quote_verification(spark, d):
    """Quotes that models give as evidence, looked up in the units they cite."""
    e, i = table(spark, d, "events"), F.col("event_id")
    quote = F.concat(F.lit("user "), F.col("user_id"), F.lit(" did "), F.when(i % 6 == 0, "nothing").otherwise(F.col("event_type")))
    evidence = e.select(F.col("user_id").alias("model_id"), i.alias("n"), F.when(i % 17 == 0, i + 100_000_000).otherwise(i).alias("unit_id"), quote.alias("quote"))
    return maintenance.verify_quotes(evidence, views.facts(spark, d)).select("model_id", "n", "verdict")


# ---------------------------------------------------------------- key-value store, queue, changes

KV = "kv AS (SELECT CASE event_id % 4 WHEN 0 THEN 'global:' WHEN 1 THEN 'user:' || user_id || ':' WHEN 2 THEN 'project:' || (user_id % 7) || ':' ELSE 'app:' END || event_id AS key, event_type AS value, CASE WHEN event_id % 3 > 0 THEN ts + to_days((event_id % 20)::INT) END AS expires_at, event_id FROM events)"


def _kv(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    space = F.when(i % 4 == 0, "global:").when(i % 4 == 1, F.concat(F.lit("user:"), F.col("user_id"), F.lit(":"))).when(i % 4 == 2, F.concat(F.lit("project:"), F.col("user_id") % 7, F.lit(":"))).otherwise("app:")
    return e.select(F.concat(space, i).alias("key"), F.col("event_type").alias("value"), F.when(i % 3 > 0, F.expr("timestampadd(DAY, CAST(event_id % 20 AS INT), ts)")).alias("expires_at"), i)


@query(f"WITH {KV} SELECT key, value FROM kv WHERE starts_with(key, 'project:3') AND NOT starts_with(key, 'project:3:9') AND (expires_at IS NULL OR expires_at > {LATER})")
def kv_by_prefix(spark, d):
    keep = filters.key_pattern(F.col("key"), "project:3*") & ~filters.key_pattern(F.col("key"), "project:3:9*") & filters.not_expired(F.col("expires_at"), _later())
    return _kv(spark, d).where(keep).select("key", "value")


@query(f"WITH {KV} SELECT count(*) AS purged FROM kv WHERE expires_at <= {LATER}")
def kv_purge(spark, d):
    return _kv(spark, d).where(~filters.not_expired(F.col("expires_at"), _later())).agg(F.count("*").alias("purged"))


@query(f"WITH {KV}, n AS (SELECT key, CASE WHEN event_id % 2 = 0 THEN 'changed' ELSE value END AS value, event_id FROM kv WHERE event_id % 3 = 0) SELECT key, coalesce(n.value, kv.value) AS value FROM kv LEFT JOIN n USING (key)")
def kv_upsert(spark, d):
    kv = _kv(spark, d).select("key", "value", F.lit(1).alias("version"), "event_id")
    new = kv.where("event_id % 3 = 0").withColumns({"value": F.when(F.col("event_id") % 2 == 0, "changed").otherwise(F.col("value")), "version": F.lit(2)})
    return maintenance.upsert(kv, new, ["key"], "version").select("key", "value")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 3) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - q[i]) * (e[i] - q[i])))), 6) AS distance FROM v, q ORDER BY sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - q[i]) * (e[i] - q[i])))), vec_id LIMIT 10")
def kv_semantic_search(spark, d):
    """Nearest by L2 distance."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id = 3").select(F.lit(1).alias("query_id"), F.col("embedding").alias("query_vector"))
    return nearest(v, asked, 10, "vec_id", l2=True).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("distance"))


@query("""WITH e AS (SELECT user_id AS session_id, event_id % 40 AS item, ts AS seen_at, event_id FROM events),
  r AS (SELECT *, sum(CASE WHEN epoch_us(seen_at) - epoch_us(before) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seen_at, item, event_id ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, lag(seen_at) OVER (PARTITION BY session_id ORDER BY seen_at, item, event_id) AS before FROM e))
  SELECT session_id, item, min(seen_at) AS seen_at FROM r GROUP BY session_id, run, item""")
def session_dedup_expiring(spark, d):
    """Pages that users see, each once until they rest for six hours."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 40).alias("item"), F.col("ts").alias("seen_at"))
    return filters.unseen_in_session(e, "session_id", "item", "seen_at", 360)


@query(f"""WITH q AS (SELECT event_id, event_type, event_id % 30 + 1 AS n, CAST(ts AS DATE) AS day, CAST({NOW_SQL} AS DATE) AS today FROM events),
  r AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN today - 1 WHEN 'signup' THEN today - n::INT WHEN 'click' THEN date_trunc('month', day)::DATE WHEN 'view' THEN day ELSE today - 7 END AS lo,
    CASE event_type WHEN 'purchase' THEN today - 1 WHEN 'signup' THEN today - n::INT WHEN 'click' THEN last_day(day) WHEN 'view' THEN day ELSE today END AS hi FROM q)
  SELECT event_id, lo::TIMESTAMP AS lo, hi::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS hi FROM r""")
def question_dates(spark, d):
    """The range that a question about each event means: in words, by days ago, by month, by date."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    when = F.when(kind == "purchase", "yesterday").when(kind == "signup", F.concat(F.col("event_id") % 30 + 1, F.lit(" days ago"))).when(kind == "click", F.concat(F.lit("in "), F.date_format("ts", "MMMM yyyy"))).when(kind == "view", F.date_format("ts", "yyyy-MM-dd")).otherwise("last week")
    asked = F.concat(F.lit("What did user "), F.col("user_id"), F.lit(" do "), when, F.lit("?"))
    return e.select("event_id", dates.constraint(asked, now()).alias("r")).select("event_id", "r.lo", "r.hi")


EVENTS_SQL = """ev AS (SELECT user_id AS key, event_id AS nth, CASE WHEN event_type IN ('purchase', 'signup') THEN 'extraction' WHEN event_type = 'error' THEN 'deletion' ELSE 'retrieval' END AS kind FROM events WHERE user_id % 5 > 0),
  ent AS (SELECT DISTINCT user_id AS key, user_id % 90 + 1 AS mention_count, user_id % 7 AS retrieval_count FROM events), q0 AS (SELECT DISTINCT user_id AS key, user_id % 6 AS evidence, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'dead_letter' END AS status, 0.25::DOUBLE AS priority, user_id % 4 AS retries FROM events WHERE user_id % 3 = 0)"""


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT key, count(*) FILTER (WHERE kind = 'extraction') AS ex, count(*) FILTER (WHERE kind = 'retrieval') AS re, count(*) FILTER (WHERE kind = 'deletion') AS del, arg_max(kind, nth) AS last_kind FROM ev GROUP BY 1),
  b AS (SELECT key, coalesce(q0.evidence, 0) + coalesce(ex, 0) AS evidence, status, priority, retries, coalesce(ex, 0) + coalesce(del, 0) > 0 AS queued, coalesce(del, 0) AS del, last_kind, mention_count, retrieval_count + coalesce(re, 0) AS seen FROM q0 FULL JOIN n USING (key) LEFT JOIN ent USING (key))
  SELECT key, evidence, CASE WHEN queued THEN 'pending' ELSE status END AS status, CASE WHEN last_kind IS NULL THEN priority WHEN last_kind = 'deletion' THEN 1.0 ELSE round(0.5 * evidence + 0.2 * log10(greatest(mention_count, 1)) + 0.3 * log10(greatest(seen, 1)), 4) END AS priority, CASE WHEN del > 0 THEN 0 ELSE coalesce(retries, 0) END AS retries
  FROM b WHERE status IS NOT NULL OR queued""")
def queue_events(spark, d):
    """A queue after a batch of extractions, deletions and retrievals; retrievals alone make no item."""
    e, u = table(spark, d, "events"), F.col("user_id")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "extraction").when(F.col("event_type") == "error", "deletion").otherwise("retrieval")
    users = e.select("user_id").distinct()
    entities = users.select(u.alias("key"), (u % 90 + 1).alias("mention_count"), (u % 7).alias("retrieval_count"))
    queue = users.where("user_id % 3 = 0").select(u.alias("key"), (u % 6).alias("evidence"), F.when(u % 2 == 0, "completed").otherwise("dead_letter").alias("status"), F.lit(0.25).alias("priority"), (u % 4).alias("retries"))
    events = e.where("user_id % 5 > 0").select(u.alias("key"), kind.alias("kind"), F.col("event_id").alias("at"))
    return maintenance.apply_events(queue, events, entities)[0]


@query("WITH q AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'completed' END AS status, c_acctbal AS priority FROM customer) SELECT key, 'processing' AS status FROM q WHERE status = 'pending' ORDER BY priority DESC, key LIMIT 25")
def queue_claim(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("completed").alias("status"), F.col("c_acctbal").alias("priority"))
    return maintenance.claim(q, 25).select("key", "status")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'processing' WHEN c_custkey % 5 IN (1, 2) THEN 'completed' WHEN c_custkey % 4 + 1 >= 3 THEN 'dead_letter' ELSE 'pending' END AS status, CASE WHEN c_custkey % 5 IN (3, 4) THEN c_custkey % 4 + 1 ELSE c_custkey % 4 END AS retry_count FROM customer")
def queue_finish(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("processing").alias("status"), (F.col("c_custkey") % 4).alias("retry_count"))
    results = q.where("key % 5 > 0").select("key", (F.col("key") % 5 < 3).alias("ok"))
    return maintenance.finish(q, results).select("key", "status", "retry_count")


@query(f"SELECT event_id AS key, CASE WHEN event_id % 2 = 0 AND (epoch_us({LATER}) - epoch_us(ts)) / 3600e6 > 48 THEN 'pending' WHEN event_id % 2 = 0 THEN 'processing' ELSE 'completed' END AS status FROM events")
def queue_recover(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 2 == 0, "processing").otherwise("completed").alias("status"), F.col("ts").alias("updated_at"))
    return maintenance.recover_stale(q, _later(), 48).select("key", "status")


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> 3")
def cascade_customers(spark, d):
    return _cascade(spark, d)["customer"].select("c_custkey")


@query("SELECT count(*) AS n_lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3")
def cascade_lines(spark, d):
    """Lines left after customers of a nation are deleted with their orders."""
    return _cascade(spark, d)["lineitem"].agg(F.count("*").alias("n_lines"))


def _cascade(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    dead = t["customer"].where("c_nationkey = 3").select("c_custkey")
    return maintenance.delete_cascade(t, "customer", dead, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def bulk_remap(spark, d):
    m = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    m = m.unionByName(table(spark, d, "orders").where("o_custkey % 10 = 0").select(F.col("o_custkey").alias("old"), (F.col("o_custkey") + 1).alias("new"))).distinct()
    return maintenance.remap(table(spark, d, "orders"), m, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT source AS grp, count(*) FILTER (WHERE s = 0) AS n_pass, count(*) FILTER (WHERE s = 1) AS n_fail, count(*) FILTER (WHERE s = 2) AS n_skip, count(*) FILTER (WHERE s = 3) AS n_error, round(count(*) FILTER (WHERE s = 0) / (count(*) FILTER (WHERE s <> 2))::DOUBLE, 6) AS rate FROM (SELECT source, (doc_id * 7) % 4 AS s FROM documents) GROUP BY 1")
def check_pass_rates(spark, d):
    s = (F.col("doc_id") * 7) % 4
    status = F.when(s == 0, "pass").when(s == 1, "fail").when(s == 2, "skip").otherwise("error")
    rows = maintenance.pass_rates(table(spark, d, "documents").select(F.col("source").alias("group"), status.alias("status")))
    return rows.withColumnRenamed("group", "grp").withColumn("rate", F.round("rate", 6))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IN (3, 5) AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")
def audit_page(spark, d):
    e = table(spark, d, "events").where("user_id IN (3, 5) AND event_type = 'click' AND ts >= TIMESTAMP_NTZ'2024-01-03 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    return filters.page(e, [F.desc("ts"), F.asc("event_id")], 20, 5).select("event_id", "user_id", "event_type")


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def conversation_roles(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


@query(sql("SELECT unit_id FROM facts ANTI JOIN (SELECT event_id AS unit_id FROM events WHERE user_id % 2 = 0) USING (unit_id)", "facts"))
def session_dedup(spark, d):
    """Results that the session has not seen."""
    seen = table(spark, d, "events").where("user_id % 2 = 0").select(F.col("event_id").alias("unit_id"))
    return filters.without_ids(views.facts(spark, d).select("unit_id"), seen, "unit_id")


@query(sql("WITH u AS (SELECT DISTINCT unit_id, note_id, len(text) // 4 AS cost, event_date FROM facts WHERE unit_id % 4 = 0 OR unit_id % 6 = 0), b AS (SELECT *, sum(cost) OVER (ORDER BY event_date DESC, unit_id) AS used FROM u) SELECT note_id, count(*) AS facts FROM b WHERE used <= 2000 GROUP BY 1", "facts"))
def survey(spark, d):
    """Two sub-queries' facts, once each, within a budget, by note."""
    f = views.facts(spark, d).select("unit_id", "note_id", text.rough_tokens(F.col("text")).alias("cost"), "event_date")
    once = f.where("unit_id % 4 = 0").unionByName(f.where("unit_id % 6 = 0")).dropDuplicates(["unit_id"])
    newest = once.orderBy(F.desc("event_date"), F.asc("unit_id")).limit(2001)  # each fact costs at least 1
    kept = fusion.budget_prefix(newest.withColumn("all", F.lit(1)), ["all"], [F.desc("event_date"), F.asc("unit_id")], F.col("cost"), 2000)
    return kept.groupBy("note_id").agg(F.count("*").alias("facts"))


@query(sql("SELECT note_id, title, CASE WHEN title IS NULL THEN false ELSE NOT (regexp_matches(lower(trim(title)), '^(tmp|temp)[^a-z]|^(tmp|temp)$') OR regexp_matches(lower(trim(title)), '^(untitled|document|file|note|readme|index|download|image|scan)[^a-z]*$')) AND length(trim(title)) > 0 END AS meaningful FROM notes", "notes"))
def meaningful_titles(spark, d):
    return views.notes(spark, d).select("note_id", "title", text.meaningful_name(F.col("title")).alias("meaningful"))
