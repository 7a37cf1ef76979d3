"""The knowledge model over the driver's tables: a DataFrame and DuckDB SQL for each view.

Facts come from events (joined with embeddings), orders are units of parts for
the large graph, documents are notes, their lines are chunks. ``NOW`` is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.operators.filters import tasks_for

#: More lines than a text can have in a row of Parquet that fits a task.
MAX_LINES = 100_000_000
NOW_TEXT = "2024-02-01 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def facts(spark: SparkSession, d: str) -> DataFrame:
    e, v = table(spark, d, "events"), table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "event").when(F.col("event_type").isin("click", "view"), "world").otherwise("observation")
    return e.join(v, "event_id", "left").select(
        F.col("event_id").alias("unit_id"), (F.col("user_id") % 3).alias("vault_id"), F.floor(F.col("event_id") / 20).cast("long").alias("note_id"), kind.alias("fact_type"),
        F.when(F.col("event_id") % 10 == 0, "stale").otherwise("active").alias("status"), ((F.col("event_id") % 100) / 99.0).alias("confidence"), F.col("ts").alias("event_date"),
        F.concat(F.lit("user "), F.col("user_id"), F.lit(" did "), F.col("event_type"), F.lit(" on page "), F.col("event_id") % 40).alias("text"),
        F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("context"), F.col("user_id") % 4)).alias("context"), "user_id", "event_type", "value", "props", "embedding",
    )


def fact_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("unit_id"), F.inline(F.array(F.struct((F.col("user_id") % 50).alias("entity_id")), F.struct((F.col("event_id") % 40 + 100).alias("entity_id")))), (F.col("user_id") % 3).alias("vault_id"), "ts")
    return e.select("unit_id", "entity_id", "vault_id", F.col("ts").alias("event_date"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    g = fact_entities(spark, d).groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"))
    kind = F.when(F.col("entity_id") < 100, "person").otherwise("concept")
    return g.withColumns({"entity_type": kind, "name": F.concat(F.initcap(kind), F.lit(" No. "), F.col("entity_id")), "retrieval_count": (F.col("entity_id") * 13) % 37})


def dealt(rows: DataFrame, spark: SparkSession, d: str, per_task: int = 20_000) -> DataFrame:
    """Rows about facts, dealt out by fact: a task for each ``per_task`` facts."""
    return rows.repartition(tasks_for(spark, table(spark, d, "events").count(), per_task), "unit_id")


def cooccurrences(spark: SparkSession, d: str) -> DataFrame:
    ue = dealt(fact_entities(spark, d), spark, d, 100_000)
    a, b = ue.select("unit_id", F.col("entity_id").alias("e1"), "event_date"), ue.select("unit_id", F.col("entity_id").alias("e2"))
    g = a.join(b, "unit_id").where("e1 < e2").groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min("event_date").alias("valid_from"), F.max("event_date").alias("last"))
    return g.select("e1", "e2", "n", "valid_from", F.when(F.col("n") < 3, F.col("last")).alias("valid_to"))


def fact_links(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    nxt = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    temporal = e.withColumn("to_id", nxt).where("to_id IS NOT NULL").select(F.col("event_id").alias("from_id"), "to_id", F.lit("temporal").alias("link_type"), F.lit(1.0).alias("weight"))
    kinds = F.when(F.col("event_id") % 3 == 0, "causes").when(F.col("event_id") % 3 == 1, "enables").otherwise("contradicts")
    n = e.agg(F.max("event_id").alias("top"))
    causal = e.where("event_id % 7 = 0").crossJoin(F.broadcast(n)).where("event_id + 3 <= top")  # one row is broadcast
    causal = causal.select(F.col("event_id").alias("from_id"), (F.col("event_id") + 3).alias("to_id"), kinds.alias("link_type"), ((F.col("event_id") % 10) / 10.0).alias("weight"))
    semantic = e.where("event_id % 5 = 0").crossJoin(F.broadcast(n)).where("event_id + 8 <= top")
    semantic = semantic.select(F.col("event_id").alias("from_id"), (F.col("event_id") + 8).alias("to_id"), F.lit("semantic").alias("link_type"), (0.7 + (F.col("event_id") % 30) / 100.0).alias("weight"))
    return temporal.unionByName(causal).unionByName(semantic)


def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Typed links with their entity: each fact with the next of an entity, both ways, and the other kinds without one."""
    nxt = F.lead("unit_id").over(W.partitionBy("entity_id").orderBy("event_date", "unit_id"))
    near = fact_entities(spark, d).select("entity_id", F.col("unit_id").alias("a"), nxt.alias("b")).where("b IS NOT NULL AND a <> b")
    both = near.select("entity_id", F.inline(F.array(F.struct(F.col("a").alias("from_id"), F.col("b").alias("to_id")), F.struct(F.col("b").alias("from_id"), F.col("a").alias("to_id")))))
    own = both.select("from_id", "to_id", F.lit("entity").alias("link_type"), F.lit(1.0).alias("weight"), "entity_id")
    return own.unionByName(fact_links(spark, d).withColumn("entity_id", F.lit(None).cast("long")))


def notes(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    made = F.expr("timestampadd(HOUR, CAST(doc_id % 1000 AS INT), TIMESTAMP_NTZ'2023-12-20 00:00:00')")
    return doc.select(
        F.col("doc_id").alias("note_id"), (F.col("doc_id") % 3).alias("vault_id"), F.substring("text", 1, 40).alias("title"), "text",
        F.when(F.col("doc_id") % 11 == 0, "archived").when(F.col("doc_id") % 13 == 0, "superseded").otherwise("active").alias("status"),
        F.array("lang", "source").alias("tags"), F.concat(F.lit("template"), F.col("doc_id") % 4).alias("template"), made.alias("created_at"),
        F.when(F.col("doc_id") % 5 > 0, F.expr("timestampadd(DAY, CAST(doc_id % 30 AS INT), TIMESTAMP_NTZ'2023-12-01 00:00:00')")).alias("publish_date"), (F.col("doc_id") % 4).alias("summary_version"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    return n.select("note_id", "vault_id", "status", "created_at", "publish_date", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text")).where("text <> ''").withColumn("chunk_id", F.col("note_id") * MAX_LINES + F.col("seq"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Sections below chunks: the sentences of each, in a block that is the chunk."""
    c = chunks(spark, d).select(F.col("chunk_id").alias("block_id"), "status", F.posexplode(F.split("text", "[.] ", -1)).alias("nth", "text"))
    return c.where("text <> ''").withColumn("node_id", F.concat_ws(":", F.lpad(F.col("block_id").cast("string"), 19, "0"), F.lpad(F.col("nth").cast("string"), 9, "0")))


def note_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / MAX_LINES).cast("long")


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Eight queries; a fixed number, so broadcasting them is safe at any size of the data."""
    v = table(spark, d, "embeddings").where("vec_id % 7 = 0 AND vec_id < 56")
    words = F.concat(F.lit("which pages did user "), F.col("vec_id"), F.lit(" purchase or click on page "), F.col("vec_id") % 40)
    return v.select(F.floor(F.col("vec_id") / 7).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"), words.alias("query_text"), (F.col("vec_id") % 3).alias("query_vault"))


SQL = {
    "facts": """SELECT e.event_id AS unit_id, e.user_id % 3 AS vault_id, e.event_id // 20 AS note_id,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'event' WHEN event_type IN ('click', 'view') THEN 'world' ELSE 'observation' END AS fact_type,
      CASE WHEN e.event_id % 10 = 0 THEN 'stale' ELSE 'active' END AS status, (e.event_id % 100) / 99.0::DOUBLE AS confidence, ts AS event_date,
      'user ' || user_id || ' did ' || event_type || ' on page ' || (e.event_id % 40) AS text, CASE WHEN user_id % 4 > 0 THEN 'context' || (user_id % 4) END AS context,
      user_id, event_type, value, props, embedding::DOUBLE[] AS embedding FROM events e LEFT JOIN embeddings v ON e.event_id = v.vec_id""",
    "fact_entities": """SELECT event_id AS unit_id, user_id % 50 AS entity_id, user_id % 3 AS vault_id, ts AS event_date FROM events
      UNION ALL SELECT event_id, event_id % 40 + 100, user_id % 3, ts FROM events""",
    "entities": """SELECT entity_id, count(*) AS mention_count, min(event_date) AS first_seen, max(event_date) AS last_seen,
      CASE WHEN entity_id < 100 THEN 'person' ELSE 'concept' END AS entity_type, CASE WHEN entity_id < 100 THEN 'Person' ELSE 'Concept' END || ' No. ' || entity_id AS name,
      (entity_id * 13) % 37 AS retrieval_count FROM fact_entities GROUP BY entity_id""",
    "cooccurrences": """SELECT e1, e2, n, valid_from, CASE WHEN n < 3 THEN last END AS valid_to FROM (
      SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS n, min(a.event_date) AS valid_from, max(a.event_date) AS last
      FROM fact_entities a JOIN fact_entities b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id GROUP BY 1, 2)""",
    "fact_links": """SELECT * FROM (SELECT event_id AS from_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id, 'temporal' AS link_type, 1.0::DOUBLE AS weight FROM events) WHERE to_id IS NOT NULL
      UNION ALL SELECT event_id, event_id + 3, CASE event_id % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'enables' ELSE 'contradicts' END, (event_id % 10) / 10.0::DOUBLE FROM events WHERE event_id % 7 = 0 AND event_id + 3 <= (SELECT max(event_id) FROM events)
      UNION ALL SELECT event_id, event_id + 8, 'semantic', 0.7::DOUBLE + (event_id % 30) / 100.0::DOUBLE FROM events WHERE event_id % 5 = 0 AND event_id + 8 <= (SELECT max(event_id) FROM events)""",
    "entity_links": """SELECT from_id, to_id, link_type, weight, CAST(NULL AS BIGINT) AS entity_id FROM fact_links UNION ALL
      SELECT unnest([a, b]), unnest([b, a]), 'entity', 1.0::DOUBLE, entity_id FROM (SELECT entity_id, unit_id AS a, lead(unit_id) OVER (PARTITION BY entity_id ORDER BY event_date, unit_id) AS b FROM fact_entities) WHERE b IS NOT NULL AND a <> b""",
    "notes": """SELECT doc_id AS note_id, doc_id % 3 AS vault_id, text[1:40] AS title, text,
      CASE WHEN doc_id % 11 = 0 THEN 'archived' WHEN doc_id % 13 = 0 THEN 'superseded' ELSE 'active' END AS status, [lang, source] AS tags, 'template' || (doc_id % 4) AS template,
      TIMESTAMP '2023-12-20 00:00:00' + to_hours(doc_id % 1000) AS created_at, CASE WHEN doc_id % 5 > 0 THEN TIMESTAMP '2023-12-01 00:00:00' + to_days((doc_id % 30)::INT) END AS publish_date, doc_id % 4 AS summary_version FROM documents""",
    "chunks": """SELECT note_id, vault_id, status, created_at, publish_date, seq, text, note_id * 100000000 + seq AS chunk_id FROM (
      SELECT note_id, vault_id, status, created_at, publish_date, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM notes) WHERE text <> ''""",
    "nodes": """SELECT block_id, status, text, lpad(block_id::VARCHAR, 19, '0') || ':' || lpad(nth::VARCHAR, 9, '0') AS node_id FROM (
      SELECT chunk_id AS block_id, status, unnest(string_split(text, '. ')) AS text, generate_subscripts(string_split(text, '. '), 1) - 1 AS nth FROM chunks) WHERE text <> ''""",
    "search_queries": """SELECT vec_id // 7 AS query_id, embedding::DOUBLE[] AS query_vector, 'which pages did user ' || vec_id || ' purchase or click on page ' || (vec_id % 40) AS query_text, vec_id % 3 AS query_vault
      FROM embeddings WHERE vec_id % 7 = 0 AND vec_id < 56""",
}
NEEDS = {"entities": ["fact_entities"], "cooccurrences": ["fact_entities"], "chunks": ["notes"], "nodes": ["chunks"], "entity_links": ["fact_links", "fact_entities"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A SELECT over the named views."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    rest = body[5:] if body.upper().startswith("WITH ") else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}" + (f", {rest}" if rest else f" {body}") if views else body
