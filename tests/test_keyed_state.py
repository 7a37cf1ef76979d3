import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import filters, maintenance
from marlstone.streaming import keyed, streams

START = datetime(2024, 1, 1)


@pytest.fixture
def base(tmp_path, spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_rocksdb(spark)
    yield f"file://{tmp_path}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drain(rows, base, name, mode):
    """Runs what is there from the checkpoint on; gives the rows that this run adds."""
    out = f"{base}/{name}-out"
    if mode == "append":
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/{name}-cp").outputMode(mode).trigger(availableNow=True).start(out)
    else:
        q = rows.writeStream.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", f"{base}/{name}-cp").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return rows.sparkSession.read.parquet(out)


def minutes(n):
    return START + timedelta(minutes=n)


def test_seen_results_over_a_restart_equal_the_batch_form(spark, base):
    rng = random.Random(4)
    schema = "session_id string, item string, at timestamp"
    parts = [[(f"s{rng.randrange(4)}", f"i{rng.randrange(6)}", minutes(b * 100 + rng.randrange(80))) for _ in range(40)] for b in range(3)]
    parts[1] += [(None, "i1", minutes(110)), ("s1", None, minutes(111))]
    source = streams.file_stream(spark, f"{base}/in/*", schema, max_files=1)
    for n, part in enumerate(parts):  # each run goes on from the checkpoint of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{n}")
        got = drain(keyed.unseen(source, 15), base, "seen", "append")
    rows = [r for part in parts for r in part if r[0] and r[1]]
    want = filters.unseen_in_session(spark.createDataFrame(rows, schema), "session_id", "item", "at", 15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("session_id", "item", "at").collect()))
    assert got.count() < len(rows)


def test_state_of_resting_sessions_expires(spark, base):
    schema = "session_id string, item string, at timestamp"
    source = streams.file_stream(spark, f"{base}/in/*", schema, max_files=1)
    for n, part in enumerate([[("a", "x", minutes(0))], [("b", "y", minutes(200))], [("b", "z", minutes(201))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/in/{n}")
        drain(keyed.unseen(source, 30), base, "exp", "append")
    left = spark.read.format("statestore").option("path", f"{base}/exp-cp").option("stateVarName", "last").load()
    assert [r.key[0] for r in left.collect()] == ["b"]  # a's timer has fired


EVENTS = "key long, kind string, at timestamp"


def last_rows(rows):
    return {r.key: (r.evidence, r.status, r.priority, r.retries) for r in rows.orderBy("batch").collect()}


def test_queue_equals_the_batch_form_over_a_restart(spark, base):
    rng = random.Random(6)
    entities = spark.createDataFrame([(k, k * 7, k) for k in range(1, 9)], "key long, mention_count long, retrieval_count long")
    queue = spark.createDataFrame([(2, 3, "completed", 0.2, 2), (30, 1, "pending", 0.1, 0)], "key long, evidence long, status string, priority double, retries long")
    source = streams.file_stream(spark, f"{base}/in/*", EVENTS, max_files=1)
    parts, at = [], 0
    for _ in range(3):
        part = []
        for _ in range(30):
            at += 1
            part.append((rng.choice([1, 2, 3, 4, 30, 77]), rng.choice(["extraction", "extraction", "retrieval", "deletion"]), minutes(at)))
        parts.append(part)
    want, known = queue, entities
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part, EVENTS)
        batch.coalesce(1).write.parquet(f"{base}/in/{n}")
        got = drain(keyed.reflection_queue(source, entities, queue), base, "queue", "update")
        want, known = maintenance.apply_events(want, batch, known)
    expected = {r.key: (r.evidence, r.status, r.priority, r.retries) for r in want.collect()}
    assert last_rows(got) == expected and len(expected) == 6
    counts = {r.key: r.retrieval_count for r in known.collect()}
    seen = {r.key: r.retrieval_count for r in got.orderBy("batch").collect()}
    assert all(counts[k] == n for k, n in seen.items() if k in counts)


def test_claims_end_by_result_or_go_stale(spark, base):
    entities = spark.createDataFrame([(k, 1, 1) for k in range(1, 5)], "key long, mention_count long, retrieval_count long")
    source = streams.file_stream(spark, f"{base}/in/*", EVENTS, max_files=1)
    steps = [
        [(k, "extraction", minutes(0)) for k in (1, 2, 3, 4)] + [(k, "claim", minutes(1)) for k in (1, 2, 3)] + [(4, "complete", minutes(2))],
        [(1, "complete", minutes(30)), *[(2, kind, minutes(31 + i)) for i, kind in enumerate(["fail", "claim", "fail", "claim", "fail", "claim"])]],
        [(4, "retrieval", minutes(600))],  # moves the watermark far beyond the claim of 3
        [(4, "retrieval", minutes(601))],
    ]
    for n, part in enumerate(steps):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{base}/in/{n}")
        got = drain(keyed.reflection_queue(source, entities), base, "claims", "update")
    assert {k: v[1::2] for k, v in last_rows(got).items()} == {1: ("completed", 0), 2: ("dead_letter", 3), 3: ("pending", 0), 4: ("pending", 0)}
    assert [r.status for r in got.where("key = 3").orderBy("batch").collect()] == ["processing", "pending"]
