from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunking, notes, strategies

NOW = datetime(2024, 1, 1)


def tables(spark):
    """Units 1 and 3 are stale: 1 is in a note with an active chunk; 2 is active, but its note has only a stale chunk."""
    facts = spark.createDataFrame([(1, 10, "stale", NOW), (2, 20, "active", NOW), (3, 30, "stale", NOW), (4, 10, "active", NOW)], "unit_id long, note_id long, status string, event_date timestamp_ntz")
    chunks = spark.createDataFrame([(10, 101, "active"), (10, 102, "stale"), (10, 103, "active"), (20, 201, "stale"), (30, 301, "active")], "note_id long, chunk_id long, status string")
    ue = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 9)], "unit_id long, entity_id long")
    seeds = spark.createDataFrame([(1, 7, 1.0), (1, 8, 0.5)], "query_id long, entity_id long, weight double")
    return facts, chunks.where("status = 'active'"), ue, seeds


def carried(spark, hits, facts, live, pool=60):
    return sorted((r.id, round(r.score, 6)) for r in notes.to_chunks(hits, facts, live, pool).collect())


def test_stale_units_count_and_stale_chunks_do_not(spark):
    facts, live, ue, seeds = tables(spark)
    entities = spark.createDataFrame([(7, 3), (8, 1), (9, 1)], "entity_id long, mention_count int")
    pairs = spark.createDataFrame([(7, 9, 1, None, None)], "e1 long, e2 long, n int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    units = notes.with_first_chunk(facts, live)
    hits = strategies.cooccurrence_graph(units, ue, entities, pairs, seeds, F.lit(NOW).cast("timestamp_ntz"), tie="first_chunk")
    # A row a path: unit 1 comes by both of its seeds, its note has two active chunks; unit 3 by its neighbour.
    assert carried(spark, hits, facts, live) == [(101, 1.5), (101, 2.0), (103, 1.5), (103, 2.0), (301, 0.63093)]


def test_causal_paths_are_not_merged_and_start_from_any_unit(spark):
    facts, live, ue, seeds = tables(spark)
    links = spark.createDataFrame([(2, 3, "causes", 0.5), (1, 4, "enables", 1.0), (1, 3, "causes", 0.2), (1, 2, "causes", 0.9), (1, 3, "temporal", 1.0)], "from_id long, to_id long, link_type string, weight double")
    units = notes.with_first_chunk(facts, live)
    hits = strategies.causal_graph(units, ue, links, seeds, F.lit(NOW).cast("timestamp_ntz"), tie="first_chunk", merge=False, sources=facts)
    assert carried(spark, hits, facts, live) == [(101, 0.8), (101, 0.8), (101, 2.0), (101, 2.0), (103, 0.8), (103, 0.8), (103, 2.0), (103, 2.0), (301, 0.4)]


@pytest.mark.parametrize("pool", [1, 3, 7])
def test_the_pool_of_units_is_enough_for_the_pool_of_chunks(spark, pool):
    """Cut first by score and first chunk, or never: the same chunks."""
    chunks = spark.createDataFrame([(n, n * 100 + (i * 7 + n * 3) % 50) for n in range(9) for i in range(n % 4)], "note_id long, chunk_id long")
    facts = spark.createDataFrame([(u, (u * 5) % 9, NOW) for u in range(40)], "unit_id long, note_id long, event_date timestamp_ntz")
    ue = spark.createDataFrame([(u, u % 3) for u in range(40)], "unit_id long, entity_id long")
    seeds = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 2, 0.7)], "query_id long, entity_id long, weight double")
    args = (ue, spark.createDataFrame([], "from_id long, to_id long, link_type string, weight double"), seeds, F.lit(NOW).cast("timestamp_ntz"))
    units = notes.with_first_chunk(facts, chunks)
    cut = strategies.causal_graph(units, *args, pool=pool, tie="first_chunk", merge=False)
    whole = strategies.causal_graph(units, *args, pool=10_000, tie="first_chunk", merge=False)
    rows = lambda hits: sorted(map(tuple, notes.to_chunks(hits, facts, chunks, pool).collect()))
    assert rows(cut) == rows(whole)


def test_rows_of_texts_leave_the_worker_in_small_batches(spark):
    docs = spark.createDataFrame([(i, "# a\n" * 50 if i % 7 else None) for i in range(40)], "doc_id long, text string").coalesce(1)

    def make(t):
        return [(n, str(len(t))) for n in range(50)]

    rows = chunking._map_text(docs, "doc_id", "text", make, "seq long, text string", at_once=3, most=60)
    assert rows.count() == 34 * 50 and rows.where("text = '200'").count() == 34 * 50
    assert chunking._batch([(1, 2, "x")], pa.schema([("id", pa.int64()), ("seq", pa.int64()), ("text", pa.string())])).num_rows == 1


def test_subtree_totals_read_the_tree_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(1, n, (n - 1) // 3 if n else None, 1) for n in range(40)]
    tree = spark.createDataFrame(rows, "id long, seq long, parent long, tokens long").mapInArrow(counted, "id long, seq long, parent long, tokens long")
    got = {r.seq: r.total for r in chunking.subtree_totals(tree, ["id"]).collect()}
    assert got[0] == 40 and got[1] == 13 and got[39] == 1 and made.value == 40
