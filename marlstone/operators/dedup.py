"""Block hashes and diffs, duplicate facts, similar facts, overlapping notes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vector
from marlstone.operators.filters import top_per_group
from marlstone.operators.nearest import RING_ROWS, VECTOR_BLOCK, by_width, met_by_keys, nearest, pairs_above

WINDOW_HOURS, NEAR_DISTANCE, SIMILAR, OVERLAP = 12, 0.05, 0.8, 0.85


def block_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, hash, change): retained, added or removed blocks of each note."""
    a, b = old.select(*key, "hash").distinct(), new.select(*key, "hash").distinct()
    on = [*key, "hash"]
    parts = [(b.join(a, on, "left_semi"), "retained"), (b.join(a, on, "left_anti"), "added"), (a.join(b, on, "left_anti"), "removed")]
    out = None
    for rows, name in parts:
        rows = rows.withColumn("change", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def classify_blocks(added: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """An added block all of whose section hashes are known only has shifted boundaries; else its content changed."""
    seen = known.select("note_id", "node_hash").distinct().withColumn("known", F.lit(True))
    marked = added.join(nodes, ["note_id", "hash"]).join(seen, ["note_id", "node_hash"], "left")
    every = F.every(F.coalesce("known", F.lit(False)))
    return marked.groupBy("note_id", "hash").agg(F.when(every, "boundary_shift").otherwise("content_changed").alias("kind"))


def migrate_blocks(removed: DataFrame, shifted: DataFrame) -> DataFrame:
    """Each removed block goes to the shifted block that shares most sections with it."""
    a = removed.select("note_id", F.col("hash").alias("old_hash"), "node_hash")
    b = shifted.select("note_id", F.col("hash").alias("new_hash"), "node_hash")
    n = a.join(b, ["note_id", "node_hash"]).groupBy("note_id", "old_hash", "new_hash").agg(F.count("*").alias("shared"))
    return top_per_group(n, ["note_id", "old_hash"], [F.desc("shared"), F.asc("new_hash")], 1)


def duplicate_facts(new: DataFrame, stored: DataFrame, window_hours: int = 2 * WINDOW_HOURS, distance: float = NEAR_DISTANCE, scope: tuple[str, ...] = ("vault_id",), rows: int = RING_ROWS) -> DataFrame:
    """(unit_id, kind) of new facts that a stored fact within half the window around their bucket's start repeats.

    kind: exact for equal text, near for a vector distance under ``distance``. Only facts
    that agree in the ``scope`` columns are compared; with none, all vaults are. The
    range join is an equi-join on buckets: half a window spans three of them, of the last only its first moment.
    Stored texts are one row a bucket, with the least and the greatest id there, so copies are not paired.
    Vectors of a bucket meet in matrix products, ``rows`` of each side at a time.
    """
    half = window_hours // 2
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    hour = F.timestamp_diff("MICROSECOND", origin, F.col("event_date")) / 3600e6
    start = (F.floor(hour / half) * half).cast("long")
    n = new.select("unit_id", *scope, "text", "embedding", start.alias("start")).withColumn("bucket", F.explode(F.array(F.col("start") - half, F.col("start"), F.col("start") + half)))
    s = stored.select(F.col("unit_id").alias("old_id"), *scope, F.col("text").alias("old_text"), F.col("embedding").alias("old_vector"), hour.alias("hour"), start.alias("bucket"))
    first = F.when(F.col("hour") == F.col("bucket"), F.col("old_id"))
    held = s.withColumnRenamed("old_text", "text").groupBy("bucket", "text", *scope).agg(F.min("old_id").alias("lo"), F.max("old_id").alias("hi"), F.min(first).alias("first_lo"), F.max(first).alias("first_hi"))
    later = F.col("bucket") > F.col("start")
    other = [F.when(later, F.col(f"first_{x}")).otherwise(F.col(x)) != F.col("unit_id") for x in ("lo", "hi")]
    exact = n.drop("embedding").join(held, ["bucket", "text", *scope]).where(other[0] | other[1]).select("unit_id", F.lit(True).alias("exact"))
    a = vector.only_unit_vectors(n.where("embedding IS NOT NULL AND unit_id IS NOT NULL").select(F.col("unit_id").alias("id"), *scope, "bucket", "start", F.col("embedding").alias("v")), "v")
    b = vector.only_unit_vectors(s.where("old_vector IS NOT NULL AND old_id IS NOT NULL").select(F.col("old_id").alias("id"), *scope, "bucket", "hour", F.col("old_vector").alias("v")), "v")

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, starts, old, hours = mine.column("id").combine_chunks(), *(x.to_numpy() for x in (mine.column("start"), theirs.column("id"), theirs.column("hour")))
        repeats, widths = np.zeros(len(ids), bool), by_width(mine)
        own = ids.to_numpy(zero_copy_only=False)
        for width, (there, v) in by_width(theirs).items():
            at, q = widths.get(width, (np.zeros(0, int), np.zeros((0, width))))
            for first in range(0, len(there), VECTOR_BLOCK):
                left = np.flatnonzero(~repeats[at])  # what has been found is not looked for again
                part = there[first : first + VECTOR_BLOCK]
                for i, j, cosine in pairs_above(q[left], v[first : first + VECTOR_BLOCK], 1.0 - distance):
                    x, y = at[left[i]], part[j]
                    repeats[x[(1.0 - cosine < distance) & (np.abs(hours[y] - starts[x]) <= half) & (own[x] != old[y])]] = True
        return pa.table({"unit_id": ids.filter(pa.array(repeats)), "exact": pa.array(np.zeros(repeats.sum(), bool))})

    near = met_by_keys(a, b, ["bucket", *scope], meet, f"unit_id {dict(a.dtypes)['id']}, exact boolean", rows)
    return exact.unionByName(near).groupBy("unit_id").agg(F.when(F.max("exact"), "exact").otherwise("near").alias("kind"))


def similar_facts(left: DataFrame, right: DataFrame, least: float = SIMILAR, k: int = 5) -> DataFrame:
    """(id, other_id, similarity) of the k most similar of ``right`` (id, embedding) for each row of ``left``: a
    few go to every task, more are joined in blocks (``operators.nearest``)."""
    asked = left.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = nearest(right, asked, k, least=least, other=True)
    return hits.select(F.col("query_id").alias("id"), F.col("id").alias("other_id"), F.col("score").alias("similarity"))


def mean_directions(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, direction, n): the mean of the unit vectors of each group and their number; sums are combined before the shuffle."""
    units = vector.unit_vectors(rows.where("embedding IS NOT NULL").select(*group, "embedding"), "embedding").where("embedding IS NOT NULL")
    parts = units.select(*group, F.posexplode("embedding").alias("at", "x")).groupBy(*group, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    packed = parts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"), F.max("n").alias("n"))
    return packed.select(*group, F.col("v.x").alias("direction"), "n")


def overlapping_notes(batch: DataFrame, stored: DataFrame, least: float = OVERLAP, k: int = 5) -> DataFrame:
    """(note_id, other_id, similarity, n): for each note of a batch the k other notes whose facts are on average
    at least ``least`` similar to its own, over n pairs of facts. Inputs: note_id, embedding.

    The mean cosine of all pairs of two notes is the product of their mean unit vectors,
    so no pairs of facts are made. The batch's notes are broadcast after a check of their number.
    """
    from marlstone.operators.strategies import checked_broadcast

    a = checked_broadcast(mean_directions(batch, ["note_id"]).withColumnRenamed("n", "mine"))
    b = mean_directions(stored, ["note_id"]).select(F.col("note_id").alias("other_id"), F.col("direction").alias("other"), F.col("n").alias("theirs"))
    pairs = b.crossJoin(a).where("note_id <> other_id").select("note_id", "other_id", vector.dot(F.col("direction"), F.col("other")).alias("similarity"), (F.col("mine") * F.col("theirs")).alias("n"))
    return top_per_group(pairs.where(F.col("similarity") >= least), ["note_id"], [F.desc("similarity"), F.asc("other_id")], k)


def two_gate(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds action: skip if key and fingerprint are known, update if only the key is, else insert."""
    known = stored.select("note_key", F.col("fingerprint").alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("fingerprint"), "skip").otherwise("update")
    return incoming.join(known, "note_key", "left").withColumn("action", action).drop("old")
