"""Note-level operators: chunk strategies, document rerank, status and date changes, versions, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import scoring
from marlstone.operators.filters import top_per_group

MAX_DELTA_BYTES = 200_000
STATUSES = ("active", "superseded", "appended", "archived")


def with_first_chunk(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units whose note has one of ``chunks``, with the least of these ids: first_chunk.

    Carried to chunks, each of these units makes at least one row, and that with its first chunk first. So the
    best rows of chunks are among those of as many units by score and first_chunk.
    """
    return units.join(chunks.groupBy("note_id").agg(F.min("chunk_id").alias("first_chunk")), "note_id")


def to_chunks(unit_hits: DataFrame, unit_notes: DataFrame, chunks: DataFrame, pool: int = 60) -> DataFrame:
    """Unit scores carried to the chunks of their notes, a row a path; the pool is cut once, at the end."""
    rows = unit_hits.join(unit_notes.select(F.col("unit_id").alias("id"), "note_id"), "id").join(chunks.select("note_id", "chunk_id"), "note_id").select("query_id", F.col("chunk_id").alias("id"), "score")
    return top_per_group(rows, ["query_id"], [F.desc("score"), F.asc("id")], pool)


def rerank(rows: DataFrame, raw: Column, top: int = 30, step: float = 1e-6) -> DataFrame:
    """The first ``top`` of each query get the sigmoid of ``raw``; the others follow below the least of these by small steps."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    rows = rows.withColumn("place", place).withColumn("s", F.when(F.col("place") <= top, scoring.sigmoid(raw)))
    floor = F.min("s").over(W.partitionBy("query_id"))
    return rows.withColumn("reranked", F.coalesce("s", floor - (F.col("place") - top) * step)).drop("s")


def set_status(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (note_id, new_status, linked_id): a superseded note points to what supersedes it, an appended
    one to what it went into; a note made active again loses both and its summary version. Unknown states are passed over."""
    known = changes.where(F.col("new_status").isin(*STATUSES)).select("note_id", "new_status", "linked_id")
    both, new = notes.join(known, "note_id", "left"), F.col("new_status")
    pointer = {c: F.when(new == state, F.col("linked_id")).when(new == "active", None).otherwise(F.col(c)) for c, state in (("superseded_by", "superseded"), ("appended_to", "appended"))}
    version = F.when(new == "active", None).otherwise(F.col("summary_version"))
    return both.withColumns({**pointer, "summary_version": version, "status": F.coalesce(new, "status")}).drop("new_status", "linked_id")


def cascade_status(units: DataFrame, changes: DataFrame) -> DataFrame:
    """Units of superseded and archived notes are stale, of active ones active; an append is a pointer only."""
    both = units.join(changes, "note_id", "left")
    status = F.when(F.col("new_status").isin("superseded", "archived"), "stale").when(F.col("new_status") == "active", "active").otherwise(F.col("status"))
    return both.withColumn("status", status).drop("new_status")


def shift_dates(units: DataFrame, moved: DataFrame, columns: list[str]) -> DataFrame:
    """Moves the dates of a note's units by as much as its publish date moved: (note_id, old_date, new_date)."""
    delta = moved.select("note_id", F.timestamp_diff("MICROSECOND", F.col("old_date"), F.col("new_date")).alias("_us"))
    both = units.join(delta, "note_id", "left")
    return both.withColumns({c: F.timestamp_add("MICROSECOND", F.coalesce("_us", F.lit(0)), F.col(c)) for c in columns}).drop("_us")


def migrate(tables: dict[str, DataFrame], note_ids: DataFrame, vault: int) -> dict[str, DataFrame]:
    """Moves notes, and rows of other tables that carry their note_id, to another vault."""
    hit = note_ids.select("note_id").distinct().withColumn("_move", F.lit(True))
    return {n: t.join(hit, "note_id", "left").withColumn("vault_id", F.when(F.col("_move"), vault).otherwise(F.col("vault_id"))).drop("_move") for n, t in tables.items()}


def leave_vaults(note_ids: DataFrame, vault: int, units: DataFrame, unit_entities: DataFrame, cooccurrences: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """What notes that move to ``vault`` leave behind in the vaults they come from.

    Co-occurrences there of the entities that their units mention are dropped; so are models of
    entities that no unit there mentions any more, and other models of these entities lose the evidence of
    units that left. Units that are in ``vault`` already leave nothing. Tables: units (unit_id, note_id,
    vault_id), unit_entities (unit_id, entity_id, vault_id), cooccurrences (e1, e2, vault_id, ...), models (model_id, entity_id, vault_id, observations).
    """
    from marlstone.operators.maintenance import prune_evidence

    gone = units.join(note_ids.select("note_id").distinct(), "note_id", "left_semi").where(F.col("vault_id") != vault).select("unit_id").distinct()
    held = unit_entities.select("unit_id", "entity_id", "vault_id")
    touched = held.join(gone, "unit_id", "left_semi").select("entity_id", "vault_id").distinct()
    pairs = cooccurrences
    for end in ("e1", "e2"):
        pairs = pairs.join(touched.withColumnRenamed("entity_id", end), [end, "vault_id"], "left_anti")
    left = held.join(gone, "unit_id", "left_anti").select("entity_id", "vault_id").distinct()
    orphaned = touched.join(left, ["entity_id", "vault_id"], "left_anti")
    kept = models.join(orphaned, ["entity_id", "vault_id"], "left_anti")
    mine = kept.join(touched, ["entity_id", "vault_id"], "left_semi")
    pruned = mine.select("model_id", "entity_id", "vault_id").join(prune_evidence(mine, gone, "model_id"), "model_id")
    others = kept.join(touched, ["entity_id", "vault_id"], "left_anti").select(pruned.columns)
    return {"cooccurrences": pairs.select(cooccurrences.columns), "models": others.unionByName(pruned)}


def spread_times(facts: DataFrame, group: list[str], order: str, columns: list[str], seconds: int = 10) -> DataFrame:
    """Facts of one item, each ``seconds`` after the one before, so that their order shows in their times."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1
    moved = facts.withColumn("_place", place)
    return moved.withColumns({c: F.timestamp_add("SECOND", F.col("_place") * seconds, F.col(c)) for c in columns}).drop("_place")


def stale_summaries(vaults: DataFrame, notes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(vault_id, stale): a summary (vault_id, version, needs_regeneration) is stale when marked so, or when an active note is not in it
    yet; a vault without one is stale if it has active notes. Each summary's notes carry the version that took them in (summary_version)."""
    live = notes.where("status = 'active'").join(summaries.select("vault_id", "version"), "vault_id", "left")
    behind = live.groupBy("vault_id").agg(F.max(F.col("version").isNull() | F.col("summary_version").isNull() | (F.col("summary_version") < F.col("version"))).alias("behind"))
    both = vaults.select("vault_id").join(summaries.select("vault_id", "needs_regeneration"), "vault_id", "left").join(behind, "vault_id", "left")
    no = F.lit(False)
    return both.select("vault_id", (F.coalesce("needs_regeneration", no) | F.coalesce("behind", no)).alias("stale"))


def valid_delta(text: Column) -> Column:
    """An append must not be blank, hold NUL, begin as front matter, or be over 200,000 bytes."""
    return F.coalesce((F.trim(text) != "") & ~F.contains(text, F.lit("\0")) & ~F.startswith(F.ltrim(text), F.lit("---\n")) & (F.octet_length(text) <= MAX_DELTA_BYTES), F.lit(False))


def overlapping_jobs(new: DataFrame, running: DataFrame) -> DataFrame:
    """New jobs (job_id, keys) that share a key with a running one."""
    busy = running.select(F.explode("keys").alias("key")).distinct()
    return new.select("job_id", F.explode("keys").alias("key")).join(busy, "key", "left_semi").select("job_id").distinct()


def either(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows matched by one of two lookups, once: a union of two filters instead of an OR."""
    return rows.where(left).unionByName(rows.where(right & ~F.coalesce(left, F.lit(False))))


def citation_numbers(rows: DataFrame, group: list[str], id_col: str, place: str) -> DataFrame:
    """Numbers ids from 1 in the order in which each is first seen in its group."""
    first = rows.groupBy(*group, id_col).agg(F.min(place).alias("first"))
    return first.withColumn("number", F.row_number().over(W.partitionBy(*group).orderBy("first", id_col))).drop("first")


def uuid_of(name: Column, space: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Version-5 UUID of a name (URL name space)."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def gaps(headers: DataFrame, least: int) -> DataFrame:
    """(note_id, start, end): text of at least ``least`` rough tokens between a header's end and the next header."""
    nxt = F.lead("start").over(W.partitionBy("note_id").orderBy("start"))
    rows = headers.withColumn("next", F.coalesce(nxt, F.col("length")))
    return rows.where((F.col("next") - F.col("end")) / 4 >= least).select("note_id", F.col("end").alias("start"), F.col("next").alias("end"))


def summary_tier(tokens: Column, single: int = 8000) -> Column:
    return F.when(tokens <= single, "single").when(tokens <= 10 * single, "batched").otherwise("recursive")


# What a trend weighs in a briefing.
TREND_WEIGHTS = {"new": 3.0, "strengthening": 2.0, "weakening": 1.5, "stable": 0.5, "stale": 0.0}


def briefing_importance(trends: Column) -> Column:
    """Sum of the weights of an array of trends; a missing or unknown one counts as stable."""
    weights = F.create_map(*[x for k, v in TREND_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(trends, F.lit(0.0), lambda s, t: s + F.coalesce(weights[F.coalesce(t, F.lit("stable"))], F.lit(TREND_WEIGHTS["stable"])))


def briefing_models(models: DataFrame, budget: int = 2000, shown: int = 2) -> DataFrame:
    """(vault_id, place, model_id, importance, trends): the ten models (five within a budget under 2,000 tokens) that
    matter most to a vault, with their ``shown`` observations of the most urgent trend; a small budget shows no trends.

    ``models``: model_id, vault_id, observations array<struct<title, trend>>.
    """
    urgency = F.create_map(*[x for i, t in enumerate(TREND_WEIGHTS) for x in (F.lit(t), F.lit(i))])
    rank = F.transform("observations", lambda o, i: F.struct(F.coalesce(urgency[F.coalesce(o["trend"], F.lit("stable"))], F.lit(3)).alias("u"), i.alias("i"), o["title"].alias("title"), F.coalesce(o["trend"], F.lit("stable")).alias("trend")))
    first = F.transform(F.slice(F.array_sort(rank), 1, shown), lambda o: F.concat_ws(": ", o["trend"], o["title"]))
    scored = models.select("vault_id", "model_id", briefing_importance(F.col("observations.trend")).alias("importance"), (first if budget >= 2000 else F.array().cast("array<string>")).alias("trends"))
    place = F.row_number().over(W.partitionBy("vault_id").orderBy(F.desc("importance"), "model_id"))
    return scored.withColumn("place", place).where(F.col("place") <= (10 if budget >= 2000 else 5))


def resolve_vaults(asked: DataFrame, vaults: DataFrame) -> DataFrame:
    """(identifier, state, vault_id) of each distinct identifier, a vault's id as text or a name: found, ambiguous (several vaults of that name; vault_id is null)
    or missing. An id goes before a name that reads the same; a null identifier is missing, blanks and case count."""
    one = asked.select("identifier").distinct()
    by_id = vaults.where("vault_id IS NOT NULL").select(F.col("vault_id").cast("string").alias("_id"), F.col("vault_id").alias("_by_id")).distinct()
    by_name = vaults.where("name IS NOT NULL AND vault_id IS NOT NULL").groupBy(F.col("name").alias("_name")).agg(F.min("vault_id").alias("_least"), F.max("vault_id").alias("_most"))
    both = one.join(by_id, F.col("identifier") == F.col("_id"), "left").join(by_name, F.col("identifier") == F.col("_name"), "left")
    single = F.col("_least") == F.col("_most")
    state = F.when(F.col("_by_id").isNotNull() | single, "found").when(F.col("_least").isNotNull(), "ambiguous").otherwise("missing")
    return both.select("identifier", state.alias("state"), F.coalesce("_by_id", F.when(single, F.col("_least"))).alias("vault_id"))


def fresh_summaries(summaries: DataFrame, notes: DataFrame, now: Column, dormant_days: int = 30) -> DataFrame:
    """Summaries (vault_id, themes array<struct<..., trend>>, ...) as they read at ``now``, from the active notes (vault_id, status, created_at, publish_date).

    Adds last_7_days, last_30_days, last_activity_at, days_since_last_note (whole days, 0 for what is to come) and latest_date, those of a
    vault without active notes 0 and null; if its newest note is more than ``dormant_days`` old, the trend of all its themes is dormant. What is kept does not change.
    """
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), now)
    day = 86_400_000_000
    counts = [F.count_if(age <= n * day).alias(f"last_{n}_days") for n in (7, 30)]
    recent = notes.where("status = 'active'").groupBy("vault_id").agg(*counts, F.max("created_at").alias("last_activity_at"), F.max("publish_date").alias("latest_date"))
    days = F.when(F.col("last_activity_at").isNotNull(), F.greatest(F.floor(F.timestamp_diff("MICROSECOND", F.col("last_activity_at"), now) / day), F.lit(0)))
    both = summaries.join(recent, "vault_id", "left").withColumn("days_since_last_note", days.cast("long"))
    both = both.withColumns({f"last_{n}_days": F.coalesce(f"last_{n}_days", F.lit(0)) for n in (7, 30)})
    dormant = F.transform("themes", lambda t: t.withField("trend", F.lit("dormant")))
    return both.withColumn("themes", F.when(F.col("days_since_last_note") > dormant_days, dormant).otherwise(F.col("themes")))
