"""Trends, queue transitions, confidence, pruning, inventory, key-value store, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import scoring

RECENT_DAYS, OLD_DAYS, RISING, FALLING, ALPHA = 30, 90, 1.5, 0.5, 0.1


def trend(stamps: Column, now: Column) -> Column:
    """Of an array of evidence timestamps: new, stale, strengthening, weakening or stable.

    Evidence of less than 30 days is recent, and a null time counts as now. The rate a day
    of recent evidence is compared with that of all older evidence, spread over the 60 days before.
    """
    ages = F.transform(stamps, lambda t: F.coalesce(scoring.days_between(now, t), F.lit(0.0)))
    recent = F.size(F.filter(ages, lambda a: a < RECENT_DAYS))
    older = F.size(ages) - recent
    ratio = (recent / F.lit(float(RECENT_DAYS))) / (older / F.lit(float(OLD_DAYS - RECENT_DAYS)))
    return F.when(F.coalesce(recent, F.lit(0)) <= 0, "stale").when(older == 0, "new").when(ratio > RISING, "strengthening").when(ratio < FALLING, "weakening").otherwise("stable")


def authority(new_date: Column, existing_date: Column, hint: Column) -> Column:
    """Which side wins, new or existing: the hint if it is one of these, else the later date; of equal or missing dates the new one."""
    by_date = F.when(existing_date > new_date, "existing").otherwise("new")
    return F.when(hint.isin("new", "existing"), hint).otherwise(by_date)


def update_confidence(units: DataFrame, verdicts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Applies verdicts (new_id, existing_id, relation, winner, place) to the units' confidence.

    reinforce lifts both units by alpha; weaken lowers the one that lost by alpha, contradict
    by two. All steps start from the stored value, and of several verdicts on one unit the
    last (by ``place``, then ids) counts. The result is held to 0 .. 1; other relations do nothing.
    """
    relation = F.col("relation")
    lost = F.when(F.col("winner") == "new", F.col("existing_id")).otherwise(F.col("new_id"))
    step = F.when(relation == "reinforce", alpha).when(relation == "weaken", -alpha).when(relation == "contradict", -2 * alpha)
    touched = F.when(relation == "reinforce", F.array("new_id", "existing_id")).otherwise(F.array(lost))
    moved = verdicts.where(relation.isin("reinforce", "weaken", "contradict")).select(F.explode(touched).alias("unit_id"), step.alias("by"), F.struct("place", "new_id", "existing_id").alias("at"))
    last = moved.groupBy("unit_id").agg(F.max_by("by", "at").alias("by"))
    value = F.least(F.greatest(F.col("confidence") + F.coalesce("by", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return units.join(last, "unit_id", "left").withColumn("confidence", value).drop("by")


def note_status(low_share: Column) -> Column:
    return F.when(low_share > 0.5, "superseded").when(low_share > 0, "partially_superseded").otherwise("active")


#: Kinds of links that contest a unit at either end.
CONTESTING = ("contradicts", "contradiction", "weakens")


def freshness(superseded: Column, contested: Column, confidence: Column, age_days: Column) -> Column:
    """contested, stale, aging or fresh; ages count in whole days."""
    days = F.floor(age_days)
    return F.when(superseded | contested, "contested").when(confidence < 0.5, "stale").when(days.isNull(), "aging").when(days > 30, "stale").when(days >= 7, "aging").when(confidence >= 0.7, "fresh").otherwise("aging")


def contested_units(links: DataFrame) -> DataFrame:
    """(unit_id) of both ends of contesting links."""
    return links.where(F.lower("link_type").isin(*CONTESTING)).select(F.explode(F.array("from_id", "to_id")).alias("unit_id")).distinct()


def prune_evidence(models: DataFrame, dead: DataFrame, key: str = "model_id") -> DataFrame:
    """Drops evidence whose unit is dead and observations emptied by that; models without observations go.

    ``models`` has observations array<struct<title, evidence array<struct<unit_id, ...>>>>.
    """
    rows = models.select(key, F.posexplode_outer("observations").alias("at", "o"))
    evidence = rows.select(key, "at", F.col("o.title").alias("title"), F.size("o.evidence").alias("had"), F.explode_outer("o.evidence").alias("e"))
    gone = dead.select(F.col("unit_id").alias("dead_id")).distinct()
    marked = evidence.join(gone, F.col("e.unit_id") == F.col("dead_id"), "left")
    left = marked.groupBy(key, "at", "title", "had").agg(F.sort_array(F.collect_list(F.when(F.col("dead_id").isNull(), F.col("e")))).alias("evidence"))
    left = left.where((F.size("evidence") > 0) | (F.col("had") <= 0))
    packed = left.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "title", "evidence"))).alias("o"))
    return packed.select(key, F.transform("o", lambda x: F.struct(x["title"].alias("title"), x["evidence"].alias("evidence"))).alias("observations"))


def verify_quotes(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """``evidence`` (unit_id, quote, ...) with verdict: ok, missing (no such unit) or absent (the unit's text lacks the quote)."""
    texts = units.select("unit_id", F.col("text").alias("_text"), F.lit(True).alias("_known"))
    met = evidence.join(texts, "unit_id", "left")
    verdict = F.when(F.col("_known").isNull(), "missing").when(F.contains("_text", F.col("quote")), "ok").otherwise("absent")
    return met.withColumn("verdict", verdict).drop("_text", "_known")


# ---------------------------------------------------------------- queue


def apply_events(queue: DataFrame, events: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, entities) after a batch of events (key, kind, at) on entities.

    Extraction adds evidence, deletion makes an item urgent (priority 1) and clears its
    retries; both create it where there is none and make it pending. Retrieval counts on
    the entity and renews the priority of an item that is there, without queueing it. The
    priority is that of the last event that found an item, so only a deletion without
    later events leaves 1. ``queue``: key, evidence, status, priority, retries;
    ``entities``: key, mention_count, retrieval_count.
    """
    kind, at = F.col("kind"), F.struct("at", "kind")
    n = events.groupBy("key").agg(
        F.count_if(kind == "extraction").alias("ex"), F.count_if(kind == "retrieval").alias("re"), F.count_if(kind == "deletion").alias("del"), F.max_by("kind", at).alias("last"),
    )
    counted = entities.join(n.select("key", "re"), "key", "left").withColumn("retrieval_count", F.col("retrieval_count") + F.coalesce("re", F.lit(0))).drop("re")
    both = queue.join(n, "key", "full").join(counted.select("key", "mention_count", "retrieval_count"), "key", "left")
    zero = F.lit(0)
    queued = (F.coalesce("ex", zero) + F.coalesce("del", zero)) > 0
    both = both.where(F.col("status").isNotNull() | queued).withColumn("evidence", (F.coalesce("evidence", zero) + F.coalesce("ex", zero)).cast("long"))
    one = F.lit(1)
    scored = scoring.priority(F.col("evidence"), F.coalesce("mention_count", one), F.coalesce("retrieval_count", one))
    priority = F.when(F.col("last").isNull(), F.col("priority")).when(F.col("last") == "deletion", 1.0).otherwise(scored)
    retries = F.when(F.coalesce("del", zero) > 0, 0).otherwise(F.coalesce("retries", zero))
    return both.select("key", "evidence", F.when(queued, "pending").otherwise(F.col("status")).alias("status"), priority.alias("priority"), retries.cast("long").alias("retries")), counted


def stale_cascade(stale_chunks: DataFrame, units: DataFrame, unit_entities: DataFrame, models: DataFrame, queue: DataFrame, entities: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What follows when chunks (chunk_id) go stale: their units are stale, evidence of these leaves the
    models (entity_id, observations) of the entities they mention, and the entities whose model lost some are queued as after a deletion."""
    hit = units.join(stale_chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("unit_id").distinct()
    status = F.when(F.col("_hit"), "stale").otherwise(F.col("status"))
    now_stale = units.join(hit.withColumn("_hit", F.lit(True)), "unit_id", "left").withColumn("status", status).drop("_hit")
    touched = unit_entities.join(hit, "unit_id", "left_semi").select("entity_id").distinct()
    own = models.join(touched, "entity_id", "left_semi")
    cited = own.select("entity_id", F.explode("observations").alias("o")).select("entity_id", F.explode("o.evidence.unit_id").alias("unit_id"))
    lost = cited.join(hit, "unit_id", "left_semi").select("entity_id").distinct()
    pruned = prune_evidence(own.join(lost, "entity_id", "left_semi"), hit, "entity_id")
    kept = models.join(lost, "entity_id", "left_anti").select("entity_id", "observations").unionByName(pruned)
    events = lost.select(F.col("entity_id").alias("key"), F.lit("deletion").alias("kind"), at.alias("at"))
    return {"units": now_stale, "models": kept, "queue": apply_events(queue, events, entities)[0]}


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n pending rows of the highest priority, as processing."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), F.asc("key")).limit(n).withColumn("status", F.lit("processing"))


def finish(queue: DataFrame, results: DataFrame, retries: int = 3) -> DataFrame:
    """Success completes; failure retries, and goes to dead_letter after ``retries``."""
    both = queue.join(results.select("key", "ok"), "key", "left")
    tries = F.col("retry_count") + F.when(~F.col("ok"), 1).otherwise(0)
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(tries >= retries, "dead_letter").otherwise("pending")
    return both.withColumn("status", status).withColumn("retry_count", F.coalesce(tries, F.col("retry_count"))).drop("ok")


def recover_stale(jobs: DataFrame, now: Column, hours: float) -> DataFrame:
    """Processing rows untouched for ``hours`` are pending again."""
    old = (F.col("status") == "processing") & (scoring.days_between(now, F.col("updated_at")) * 24 > hours)
    return jobs.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


# ---------------------------------------------------------------- tables of rows that change


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Latest row of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_nth", nth).where("_nth = 1").drop("_new", "_nth")


def delete_cascade(tables: dict[str, DataFrame], root: str, dead: DataFrame, children: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Deletes ``dead`` (its only column is the key) from ``root`` and follows (parent, key, child, foreign key)."""
    out, gone = dict(tables), {root: dead}
    key = dead.columns[0]
    out[root] = out[root].join(dead, key, "left_anti")
    for parent, parent_key, child, foreign in children:
        if parent not in gone:
            continue
        hit = gone[parent].select(F.col(parent_key).alias(foreign)).distinct()
        gone[child] = out[child].join(hit, foreign, "left_semi")
        out[child] = out[child].join(hit, foreign, "left_anti")
    return out


def remap(rows: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Replaces values of ``col`` by ``mapping`` (old, new); others stay."""
    m = mapping.select(F.col("old").alias(col), F.col("new").alias("_new"))
    return rows.join(m, col, "left").withColumn(col, F.coalesce("_new", col)).drop("_new").select(rows.columns)


# ---------------------------------------------------------------- counts


def top_values(rows: DataFrame, col: Column, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return rows.select(col.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(n)


def inventory(notes: DataFrame, at: Column, now: Column) -> DataFrame:
    """Per vault: active notes, date range, notes of the last 7 and 30 days, days since the last."""
    n = notes.where("status = 'active'").withColumn("_at", at)
    age = scoring.days_between(now, F.col("_at"))
    return n.groupBy("vault_id").agg(
        F.count("*").alias("notes"), F.min("_at").alias("first"), F.max("_at").alias("last"), F.count_if((age >= 0) & (age <= 7)).alias("last_7"), F.count_if((age >= 0) & (age <= 30)).alias("last_30"), F.floor(F.min(age)).alias("idle_days"),
    )


def pass_rates(checks: DataFrame) -> DataFrame:
    """Per group: counts of each outcome and passed / (all but skipped)."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "fail", "skip", "error")}
    asked = n["pass"] + n["fail"] + n["error"]
    return checks.groupBy("group").agg(*[c.alias(f"n_{s}") for s, c in n.items()], F.when(asked > 0, n["pass"] / asked).alias("rate"))


def retry(queue: DataFrame) -> DataFrame:
    """Dead letters are pending again, with a fresh count."""
    dead = F.col("status") == "dead_letter"
    return queue.withColumns({"retry_count": F.when(dead, 0).otherwise(F.col("retry_count")), "status": F.when(dead, "pending").otherwise(F.col("status"))})
