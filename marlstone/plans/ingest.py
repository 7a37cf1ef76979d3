"""Queries over ingest: hashes, diffs, duplicates, links, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import text, vector
from marlstone.operators import dedup, links, resolve
from marlstone.operators.nearest import nearest
from marlstone.sources import commits
from marlstone.plans import views
from marlstone.plans.registry import query
from marlstone.plans.retrieval import GRAMS, SIM
from marlstone.plans.views import NOW_SQL, now, sql, table

HASH = "sha256(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
OLD_NEW = f"old AS (SELECT note_id, {HASH.format('text')} AS hash, seq FROM chunks WHERE seq % 7 <> 3), new AS (SELECT note_id, {HASH.format('text')} AS hash, seq FROM chunks WHERE seq % 5 <> 2)"


def _versions(spark, d):
    c = views.chunks(spark, d).select("note_id", "seq", text.content_hash(F.col("text")).alias("hash"))
    return c.where("seq % 7 <> 3"), c.where("seq % 5 <> 2")


@query(sql(f"SELECT note_id, {HASH.format('text')} AS hash FROM notes", "notes"))
def content_hashes(spark, d):
    return views.notes(spark, d).select("note_id", text.content_hash(F.col("text")).alias("hash"))


@query(sql(f"SELECT {HASH.format('text')} AS hash, min(note_id) AS note_id, count(*) AS copies FROM notes GROUP BY 1 HAVING count(*) > 1", "notes"))
def exact_copies(spark, d):
    g = views.notes(spark, d).groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.min("note_id").alias("note_id"), F.count("*").alias("copies"))
    return g.where("copies > 1")


@query(sql(f"""WITH {OLD_NEW} SELECT DISTINCT note_id, hash, 'retained' AS change FROM new SEMI JOIN old USING (note_id, hash) UNION ALL SELECT DISTINCT note_id, hash, 'added' FROM new ANTI JOIN old USING (note_id, hash)
  UNION ALL SELECT DISTINCT note_id, hash, 'removed' FROM old ANTI JOIN new USING (note_id, hash)""", "chunks"))
def block_diff(spark, d):
    """Two versions of every note: blocks kept, added and removed."""
    return dedup.block_diff(*_versions(spark, d), ["note_id"])


@query(sql(f"""WITH {OLD_NEW}, added AS (SELECT DISTINCT note_id, hash FROM new ANTI JOIN old USING (note_id, hash)), nodes AS (SELECT DISTINCT note_id, hash, seq % 4 AS node_hash FROM new), known AS (SELECT DISTINCT note_id, seq % 4 AS node_hash, true AS known FROM old WHERE seq % 4 < 3)
  SELECT note_id, hash, CASE WHEN bool_and(coalesce(known, false)) THEN 'boundary_shift' ELSE 'content_changed' END AS kind FROM added JOIN nodes USING (note_id, hash) LEFT JOIN known USING (note_id, node_hash) GROUP BY 1, 2""", "chunks"))
def boundary_shifts(spark, d):
    old, new = _versions(spark, d)
    added = dedup.block_diff(old, new, ["note_id"]).where("change = 'added'").select("note_id", "hash")
    nodes = new.select("note_id", "hash", (F.col("seq") % 4).alias("node_hash")).distinct()
    return dedup.classify_blocks(added, nodes, old.select("note_id", (F.col("seq") % 4).alias("node_hash")).where("node_hash < 3"))


@query(sql("""WITH a AS (SELECT note_id, seq // 3 AS old_hash, seq AS node_hash FROM chunks), b AS (SELECT note_id, seq // 4 AS new_hash, seq AS node_hash FROM chunks), n AS (SELECT note_id, old_hash, new_hash, count(*) AS shared FROM a JOIN b USING (note_id, node_hash) GROUP BY 1, 2, 3)
  SELECT note_id, old_hash, new_hash, shared FROM (SELECT *, row_number() OVER (PARTITION BY note_id, old_hash ORDER BY shared DESC, new_hash) AS nth FROM n) WHERE nth = 1""", "chunks"))
def block_migration(spark, d):
    c = views.chunks(spark, d)
    old, new = (c.select("note_id", F.floor(F.col("seq") / k).cast("long").alias("hash"), F.col("seq").alias("node_hash")) for k in (3, 4))
    return dedup.migrate_blocks(old, new).select("note_id", "old_hash", "new_hash", "shared")


@query(sql("""WITH h AS (SELECT *, (floor(epoch_us(event_date) / 3600e6 / 12) * 12)::BIGINT AS start, epoch_us(event_date) / 3600e6 AS hour FROM facts),
  m AS (SELECT a.unit_id, a.text = b.text AS exact FROM h a JOIN h b ON b.unit_id <> a.unit_id AND a.vault_id = b.vault_id AND abs(b.hour - a.start) <= 12 WHERE a.unit_id % 100 = 0 AND (a.text = b.text OR coalesce(1 - list_inner_product(a.embedding, b.embedding) / sqrt(list_inner_product(a.embedding, a.embedding) * list_inner_product(b.embedding, b.embedding)) < 0.05, false)))
  SELECT unit_id, CASE WHEN bool_or(exact) THEN 'exact' ELSE 'near' END AS kind FROM m GROUP BY 1""", "facts"))
def duplicate_facts(spark, d):
    """A batch (ids divisible by 100) searched for repeats of any other fact of its vault within 12 hours around its half-day's start."""
    f = views.facts(spark, d).select("unit_id", "vault_id", "text", "embedding", "event_date")
    return dedup.duplicate_facts(f.where("unit_id % 100 = 0"), f)


COSINE = "list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding)))"


@query(sql(f"""WITH v AS (SELECT unit_id AS id, embedding FROM facts WHERE embedding IS NOT NULL), p AS (SELECT a.id, b.id AS other_id, {COSINE} AS similarity FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id)
  SELECT id, other_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other_id) AS nth FROM p WHERE similarity >= 0.2) WHERE nth <= 5""", "facts"))
def similar_facts(spark, d):
    """The five most similar facts for each of a batch (ids divisible by 100), among all."""
    v = views.facts(spark, d).select(F.col("unit_id").alias("id"), "embedding")
    rows = dedup.similar_facts(v.where("id % 100 = 0"), v, least=0.2)
    return rows.select("id", "other_id", F.round("similarity", 6).alias("similarity"))


@query(sql(f"""WITH v AS (SELECT unit_id AS id, embedding FROM facts WHERE embedding IS NOT NULL), p AS (SELECT a.id, b.id AS other_id, {COSINE} AS similarity FROM v a, v b WHERE a.id <> b.id)
  SELECT id, other_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other_id) AS nth FROM p) WHERE nth <= 3""", "facts"))
def nearest_of_all_facts(spark, d):
    """The three most similar other facts of every fact, by the join in blocks."""
    v = views.facts(spark, d).select(F.col("unit_id").alias("id"), "embedding")
    hits = nearest(v, v.withColumnsRenamed({"id": "query_id", "embedding": "query_vector"}), 3, other=True, blocked=True)
    return hits.select(F.col("query_id").alias("id"), F.col("id").alias("other_id"), F.round("score", 6).alias("similarity"))


@query(sql(f"""WITH v AS (SELECT note_id, unit_id, embedding FROM facts WHERE embedding IS NOT NULL), s AS (SELECT a.note_id, b.note_id AS other_id, avg({COSINE}) AS similarity, count(*) AS n FROM v a, v b WHERE a.note_id % 100 = 0 AND b.note_id <> a.note_id GROUP BY 1, 2)
  SELECT note_id, other_id, round(similarity, 6) + 0.0 AS similarity, n FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY similarity DESC, other_id) AS nth FROM s WHERE similarity >= -0.5) WHERE nth <= 5""", "facts"))
def overlapping_notes(spark, d):
    """The five notes nearest on average to each of a batch (ids divisible by 100), among all."""
    f = views.facts(spark, d).select("note_id", "embedding")
    rows = dedup.overlapping_notes(f.where("note_id % 100 = 0"), f, least=-0.5)
    return rows.select("note_id", "other_id", (F.round("similarity", 6) + 0.0).alias("similarity"), "n")


@query(sql("""WITH i AS (SELECT note_id AS note_key, md5(text) AS fingerprint FROM notes), s AS (SELECT note_id AS note_key, CASE WHEN note_id % 4 = 0 THEN 'old' ELSE md5(text) END AS old FROM notes WHERE note_id % 3 > 0)
  SELECT note_key, CASE WHEN old IS NULL THEN 'insert' WHEN old = fingerprint THEN 'skip' ELSE 'update' END AS action FROM i LEFT JOIN s USING (note_key)""", "notes"))
def two_gate_idempotency(spark, d):
    i = views.notes(spark, d).select(F.col("note_id").alias("note_key"), F.md5("text").alias("fingerprint"))
    s = i.where("note_key % 3 > 0").withColumn("fingerprint", F.when(F.col("note_key") % 4 == 0, "old").otherwise(F.col("fingerprint")))
    return dedup.two_gate(i, s).select("note_key", "action")


# ---------------------------------------------------------------- links


@query(sql("SELECT * FROM (SELECT unit_id AS from_id, lead(unit_id) OVER (PARTITION BY note_id ORDER BY event_date, unit_id) AS to_id, 1.0::DOUBLE AS weight FROM facts) WHERE to_id IS NOT NULL", "facts"))
def temporal_links(spark, d):
    return links.adjacent(views.facts(spark, d).select("unit_id", "note_id", "event_date"))


@query(sql("""WITH t AS (SELECT unit_id, epoch_us(event_date) AS us FROM facts), r AS (SELECT *, row_number() OVER (ORDER BY us, unit_id) AS ahead, row_number() OVER (ORDER BY us, unit_id DESC) AS back FROM t),
  p AS (SELECT a.unit_id AS from_id, b.unit_id AS to_id, abs(a.us - b.us) / 3600e6 AS gap FROM r a JOIN r b ON b.ahead BETWEEN a.ahead - 40 AND a.ahead + 40 AND a.unit_id <> b.unit_id WHERE abs(a.us - b.us) / 3600e6 <= 24
    UNION SELECT a.unit_id, b.unit_id, abs(a.us - b.us) / 3600e6 FROM r a JOIN r b ON b.back BETWEEN a.back - 40 AND a.back + 40 AND a.unit_id <> b.unit_id WHERE abs(a.us - b.us) / 3600e6 <= 24)
  SELECT from_id, to_id, round(greatest(0.3, 1 - gap / 24), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY gap, to_id) AS nth FROM p) WHERE nth <= 10""", "facts"))
def temporal_window_links(spark, d):
    """The ten closest facts within a day of every fact, found by rank in time. (Fewer than 30 of the facts here share a time, which is what the SQL relies on.)"""
    f = views.facts(spark, d).select("unit_id", "event_date")
    return links.within_hours(f, f).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(sql(f"""WITH v AS (SELECT unit_id AS id, embedding FROM facts WHERE embedding IS NOT NULL), p AS (SELECT a.id, b.id AS other_id, {COSINE} AS similarity FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id)
  SELECT id AS from_id, other_id AS to_id, round(similarity, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other_id) AS nth FROM p WHERE similarity >= 0.35) WHERE nth <= 5""", "facts"))
def semantic_links(spark, d):
    """Links to the five most similar facts for each of a batch (ids divisible by 100); vectors here are far apart, so the least similarity is lower than the default 0.75."""
    f = views.facts(spark, d).select("unit_id", "embedding")
    rows = links.by_meaning(f.where("unit_id % 100 = 0"), f, least=0.35)
    return rows.select("from_id", "to_id", F.round("weight", 6).alias("weight"))


@query(sql("""WITH u AS (SELECT unit_id, note_id, row_number() OVER (PARTITION BY note_id ORDER BY unit_id) - 1 AS position FROM facts), r AS (SELECT note_id, position AS source, position - 1 AS target, CASE WHEN unit_id % 2 = 0 THEN 'caused_by' ELSE 'causes' END AS kind, 0.9::DOUBLE AS weight FROM u WHERE position % 3 = 2)
  SELECT CASE WHEN kind = 'caused_by' THEN b.unit_id ELSE a.unit_id END AS from_id, CASE WHEN kind = 'caused_by' THEN a.unit_id ELSE b.unit_id END AS to_id, kind, weight FROM r JOIN u a ON a.note_id = r.note_id AND a.position = source JOIN u b ON b.note_id = r.note_id AND b.position = target""", "facts"))
def causal_links(spark, d):
    u = views.facts(spark, d).select("unit_id", "note_id", (F.row_number().over(W.partitionBy("note_id").orderBy("unit_id")) - 1).alias("position"))
    kind = F.when(F.col("unit_id") % 2 == 0, "caused_by").otherwise("causes")
    r = u.where("position % 3 = 2").select("note_id", F.col("position").alias("source"), (F.col("position") - 1).alias("target"), kind.alias("kind"), F.lit(0.9).alias("strength"))
    return links.causal(r, u)


@query(sql("""WITH n AS (SELECT entity_id, unit_id, event_date FROM fact_entities WHERE unit_id % 100 = 0), k AS (SELECT entity_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, unit_id) AS nth FROM fact_entities WHERE unit_id % 100 > 0) WHERE nth <= 10),
  p AS (SELECT n.entity_id, n.unit_id AS a, o.unit_id AS b FROM n JOIN (SELECT * FROM k UNION ALL SELECT entity_id, unit_id FROM n) o USING (entity_id) WHERE n.unit_id <> o.unit_id) SELECT entity_id, a AS from_id, b AS to_id FROM p UNION SELECT entity_id, b, a FROM p""", "fact_entities"))
def entity_links(spark, d):
    """New facts with each other and with an entity's ten newest known facts."""
    ue = views.fact_entities(spark, d).select("entity_id", "unit_id", "event_date")
    return links.by_entity(ue.where("unit_id % 100 = 0"), ue.where("unit_id % 100 > 0"), last=10)


@query(sql("SELECT from_id, to_id, link_type, weight FROM fact_links WHERE from_id % 2 = 0 UNION ALL SELECT from_id, to_id, link_type, weight FROM fact_links WHERE from_id % 2 = 1", "fact_links"))
def link_insert_if_absent(spark, d):
    """Insert of all links into half of them: what is there stays."""
    every = views.fact_links(spark, d)
    return links.add_links(every.where("from_id % 2 = 0"), every.withColumn("weight", F.when(F.col("from_id") % 2 == 0, -1.0).otherwise(F.col("weight"))))


# ---------------------------------------------------------------- entity resolution

NORMAL = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g')), '^(?:(?:the|a|an|of|and|in|on|at|to|for)(?:\\s+|$))+', ''), '(?:(?:^|\\s+)(?:the|a|an|of|and|in|on|at|to|for))+$', ''))"
MENTIONS = """mentions AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'The ' ELSE '' END || 'Person, no. ' || (user_id % 60) || CASE WHEN event_id % 5 = 0 THEN ' of' ELSE '' END AS name, ts AS event_date,
  CASE WHEN event_id % 7 = 0 THEN 'human' END AS entity_type, CASE WHEN event_id % 50 = 0 THEN 'The Concept No ' || (event_id % 40 + 100) END AS nearby FROM events)"""
GROUPED = f"""named AS (SELECT *, {NORMAL.format('name')} AS normal, {NORMAL.format('nearby')} AS beside FROM mentions),
  grouped AS (SELECT normal, arg_min(name, (event_date, name)) AS name, arg_min(entity_type, (event_date, name)) FILTER (WHERE entity_type IS NOT NULL) AS entity_type, count(*) AS mentions, min(event_date) AS event_date,
    coalesce(list(DISTINCT beside) FILTER (WHERE beside <> '' AND beside <> normal), []) AS nearby FROM named WHERE normal <> '' GROUP BY 1)"""
#: Entities without dots in their names: a name beside a mention is normalised, a known one only put in lower case.
KNOWN = "known AS (SELECT entity_id, replace(name, '.', '') AS name, CASE WHEN entity_id % 2 = 0 THEN entity_type END AS entity_type, mention_count, last_seen - to_days(20) AS last_seen FROM entities), aka AS (SELECT entity_id, 'nr ' || entity_id || ' person' AS name FROM entities WHERE entity_id % 9 = 0)"


def _inputs(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    name = F.concat(F.when(i % 3 == 0, "The ").otherwise(""), F.lit("Person, no. "), F.col("user_id") % 60, F.when(i % 5 == 0, " of").otherwise(""))
    nearby = F.when(i % 50 == 0, F.array(F.concat(F.lit("The Concept No "), i % 40 + 100)))
    return resolve.group_inputs(e.select(name.alias("name"), F.col("ts").alias("event_date"), F.when(i % 7 == 0, "human").alias("entity_type"), nearby.alias("nearby")))


def _known(spark, d):
    e = views.entities(spark, d)
    known = e.select("entity_id", F.replace("name", F.lit("."), F.lit("")).alias("name"), F.when(F.col("entity_id") % 2 == 0, F.col("entity_type")).alias("entity_type"), "mention_count", F.timestamp_add("DAY", F.lit(-20), F.col("last_seen")).alias("last_seen"))
    return known, e.where("entity_id % 9 = 0").select("entity_id", F.concat(F.lit("nr "), "entity_id", F.lit(" person")).alias("name"))


@query(f"WITH {MENTIONS}, {GROUPED} SELECT normal, name, entity_type, mentions, event_date, array_to_string(list_sort(nearby), '|') AS nearby FROM grouped")
def entity_input_groups(spark, d):
    return _inputs(spark, d).withColumn("nearby", F.array_join(F.sort_array("nearby"), "|"))


CODE = "CASE WHEN {0} ILIKE 'person%' OR {0} ILIKE 'the person%' THEN 'PRSNN' WHEN {0} ILIKE 'concept%' THEN 'KNSPTN' END"
CAND = f"""names AS (SELECT entity_id, {GRAMS.format('name')} AS kg FROM known UNION ALL SELECT entity_id, {GRAMS.format('name')} FROM aka), asked AS (SELECT normal, {CODE.format('name')} AS code, {GRAMS.format('name')} AS ag FROM grouped),
  cand0 AS (SELECT normal, entity_id, {SIM.format('ag', 'kg')} AS name_score, false AS phonetic FROM asked, names),
  cand1 AS (SELECT * FROM cand0 WHERE name_score >= 0.3 UNION ALL SELECT normal, entity_id, 0.45::DOUBLE, true FROM asked JOIN (SELECT entity_id, {CODE.format('name')} AS code FROM known) USING (code)),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY name_score DESC, entity_id, phonetic) AS nth FROM cand1) WHERE nth <= 5)"""


@query(sql(f"WITH {MENTIONS}, {GROUPED}, {KNOWN}, {CAND} SELECT normal, entity_id, round(name_score, 6) AS name_score, phonetic FROM cand", "entities"))
def entity_candidates(spark, d):
    """The five best rows of known names and aliases for each mention, met by trigram or by phonetic code in equi-joins. (The SQL has the codes of the names that occur: figures and edge words do not sound.)"""
    return resolve.candidates(_inputs(spark, d), *_known(spark, d)).select("normal", "entity_id", F.round("name_score", 6).alias("name_score"), "phonetic")


MATCHED = """nbr AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS nth FROM (SELECT e1 AS a, e2 AS b, n FROM cooccurrences UNION ALL SELECT e2, e1, n FROM cooccurrences)),
  nb AS (SELECT a AS entity_id, lower(name) AS name, max(mention_count) AS freq FROM nbr JOIN known k ON k.entity_id = b WHERE nth <= 50 GROUP BY 1, 2),
  near AS (SELECT normal, unnest(nearby) AS name FROM grouped),
  ctx AS (SELECT c.normal, c.entity_id, sum(1.0::DOUBLE / log2(2.0::DOUBLE + freq)) AS w FROM (SELECT DISTINCT normal, entity_id FROM cand) c JOIN near USING (normal) JOIN nb ON nb.entity_id = c.entity_id AND nb.name = near.name GROUP BY 1, 2),
  scored AS (SELECT normal, entity_id, 0.5 * CASE WHEN phonetic THEN greatest(name_score, 0.5) ELSE name_score END + 0.3 * least(coalesce(w / nullif(len(nearby), 0), 0.0), 1.0) + 0.2 * CASE WHEN age <= 0 THEN 1.0 ELSE pow(2.0::DOUBLE, greatest(-age / 30.0, -996.0)) END AS score
    FROM (SELECT c.*, w, g.nearby, (epoch_us(g.event_date) - epoch_us(k.last_seen)) / 86400e6 AS age FROM cand c JOIN grouped g USING (normal) JOIN known k USING (entity_id) LEFT JOIN ctx USING (normal, entity_id))),
  m AS (SELECT normal, entity_id, score FROM (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY score DESC, entity_id) AS nth FROM scored WHERE score >= 0.65) WHERE nth = 1)"""
RESOLVED = f"{MENTIONS}, {GROUPED}, {KNOWN}, {CAND}, {MATCHED}"


def _matched(spark, d):
    known, aliases = _known(spark, d)
    return resolve.resolve(resolve.scored_candidates(_inputs(spark, d), known, aliases, views.cooccurrences(spark, d)))


@query(sql(f"WITH {RESOLVED} SELECT normal, entity_id, round(score, 6) AS score FROM m", "entities", "cooccurrences"))
def entity_match(spark, d):
    """0.5 name + 0.3 context of known neighbours + 0.2 recency, accepted from 0.65 on."""
    return _matched(spark, d).select("normal", "entity_id", F.round("score", 6).alias("score"))


@query(sql(f"""WITH {RESOLVED}, hit AS (SELECT entity_id, 1 AS more, max(g.entity_type) AS given FROM m JOIN grouped g USING (normal) GROUP BY 1)
  SELECT entity_id, name, coalesce(entity_type, given) AS entity_type, mention_count + coalesce(more, 0) AS mention_count, CASE WHEN more = 1 THEN {NOW_SQL} ELSE last_seen END AS last_seen FROM known LEFT JOIN hit USING (entity_id)
  UNION ALL SELECT 100000 + row_number() OVER (ORDER BY normal), name, entity_type, mentions, event_date FROM grouped g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.normal = g.normal)""", "entities", "cooccurrences"))
def entity_merge(spark, d):
    """Matched entities gain a mention, are seen now and get a type if they had none; unmatched names become entities."""
    inputs, hit = _inputs(spark, d), _matched(spark, d)
    created = inputs.join(hit, "normal", "left_anti")  # names of a batch: numbered in one task
    created = created.withColumn("entity_id", (F.row_number().over(W.orderBy("normal")) + 100_000).cast("long"))
    return resolve.merge_entities(_known(spark, d)[0], hit.join(inputs.select("normal", "entity_type"), "normal"), created, now())


@query(sql(f"WITH {RESOLVED} SELECT DISTINCT entity_id, g.name FROM m JOIN grouped g USING (normal) EXCEPT SELECT entity_id, name FROM aka", "entities", "cooccurrences"))
def alias_records(spark, d):
    """Spellings of matched names that are not recorded yet."""
    hit = _matched(spark, d).select("normal", "entity_id").join(_inputs(spark, d).select("normal", "name"), "normal")
    return resolve.new_aliases(_known(spark, d)[1], hit)


@query(sql("SELECT entity_id FROM entities ANTI JOIN (SELECT entity_id FROM fact_entities WHERE unit_id % 40 < 3) USING (entity_id)", "entities", "fact_entities"))
def orphan_entities(spark, d):
    return resolve.orphans(views.entities(spark, d), views.fact_entities(spark, d).where("unit_id % 40 < 3")).select("entity_id")


@query(sql("SELECT entity_id, name, count(*) AS mention_count FROM entities JOIN (SELECT entity_id FROM fact_entities WHERE unit_id % 2 = 0) USING (entity_id) GROUP BY 1, 2", "entities", "fact_entities"))
def entity_recount(spark, d):
    rows = resolve.recount(views.entities(spark, d), views.fact_entities(spark, d).where("unit_id % 2 = 0"))
    return rows.select("entity_id", "name", "mention_count")


@query(sql(f"SELECT unit_id, round(1 - {COSINE.replace('a.embedding', 'embedding').replace('b.embedding', 'list_transform(embedding, lambda x: x + 0.01)')}, 6) + 0.0 AS cosine_distance, round(sqrt(list_inner_product(list_transform(embedding, lambda x: 0.01), list_transform(embedding, lambda x: 0.01))), 6) AS l2 FROM facts WHERE embedding IS NOT NULL", "facts"))
def vector_measures(spark, d):
    f = views.facts(spark, d).where("embedding IS NOT NULL").withColumn("moved", F.transform("embedding", lambda x: x.cast("double") + 0.01))
    return f.select("unit_id", (F.round(vector.cosine_distance(F.col("embedding"), F.col("moved")), 6) + 0.0).alias("cosine_distance"), F.round(vector.l2_distance(F.col("embedding"), F.col("moved")), 6).alias("l2"))


@query("""WITH d AS (SELECT source AS job, doc_id // 100 AS chunk, doc_id > min(doc_id) OVER (PARTITION BY text) AS known FROM documents),
  p AS (SELECT job, chunk, count(*) FILTER (WHERE NOT known) AS n, count(*) FILTER (WHERE known) AS k FROM d GROUP BY ALL)
  SELECT job, chunk, CAST(sum(n) OVER w AS BIGINT) AS processed, CAST(sum(k) OVER w AS BIGINT) AS skipped FROM p WINDOW w AS (PARTITION BY job ORDER BY chunk)""")
def ingest_progress(spark, d):
    """Cumulative counts after each chunk of each source's documents; texts that an earlier document has are skipped."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("job"), F.floor(F.col("doc_id") / 100).cast("long").alias("chunk"), F.md5("text").alias("fingerprint"))
    first = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    known = F.col("doc_id") > F.col("first")
    n = docs.join(first, "fingerprint").groupBy("job", "chunk").agg(F.count_if(~known).alias("processed"), F.count_if(known).alias("skipped"))
    progress = n.select("job", "chunk", F.lit(1).alias("attempt"), F.lit("done").alias("status"), "processed", "skipped", F.lit(0).alias("failed"))
    return commits.totals(progress).select("job", "chunk", "processed", "skipped")
