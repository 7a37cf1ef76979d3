import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import chunking, dedup, diversity, filters, fusion, graph, links, maintenance, notes, resolve, strategies
from marlstone.plans import views

# ---------------------------------------------------------------- fusion


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double")


def test_rrf_shares_ranks_and_counts_repeated_rows(spark):
    a = hits(spark, [(1, 10, 0.9), (1, 11, 0.9), (1, 12, 0.1)])
    b = hits(spark, [(1, 12, 5.0), (1, 12, 5.0)])
    got = {r.id: r.score for r in fusion.fuse({"keyword": a, "graph": b}, 10, {"graph": 0.5}).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 61, 12: 1 / 63 + 2 * 0.5 / 61})


def test_single_pool_keeps_its_direction(spark):
    a = hits(spark, [(1, 10, 0.2), (1, 11, 0.1), (1, 10, 0.3)])
    assert [(r.id, r.score) for r in fusion.fuse({"semantic": a}, 1).collect()] == [(11, 0.1)]
    assert [(r.id, r.score) for r in fusion.fuse({"keyword": a}, 1).collect()] == [(10, 0.3)]


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([3, 4, 5, 1])], "q long, id long, cost long")
    assert [r.id for r in fusion.budget_prefix(rows, ["q"], [F.asc("id")], F.col("cost"), 8).collect()] == [0, 1]


def test_mmr_first_is_kept_and_near_ties_go_to_the_newest():
    similar = np.array([[1, 0.99, 0.0], [0.99, 1, 0.0], [0.0, 0.0, 1]])
    assert diversity.greedy_units(similar, [1, 2, 3], 3, weight=0.5) == [0, 2, 1]
    assert diversity.greedy_units(np.eye(4), [1, 5, 9, 2], 2, weight=0.0) == [0, 2]
    assert diversity.greedy_notes(similar, [1.0, 0.99, 0.5], 2, weight=0.5) == [0, 2]
    assert diversity.greedy_units(np.zeros((0, 0)), [], 3) == []


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 15), st.randoms())
def test_mmr_picks_distinct_rows(n, limit, r):
    m = np.array([[r.random() for _ in range(n)] for _ in range(n)])
    for got in (diversity.greedy_units(m, [r.randint(0, 3) for _ in range(n)], limit), diversity.greedy_notes(m, [r.random() for _ in range(n)], limit)):
        assert len(got) == len(set(got)) == min(n, limit)


# ---------------------------------------------------------------- chunks


def test_sections_and_tokens():
    text = "intro\n# A\naaaa aaaa\n## B\nbbbb\n# C\n```\n# no header\n```\n"
    tree = chunking.sections(text)
    assert [(s["level"], s["title"], s["parent"]) for s in tree] == [(0, "", None), (1, "A", 0), (2, "B", 1), (1, "C", 0)]
    assert tree[1]["end"] == text.index("# C")
    total = chunking.subtree_tokens(tree)
    assert total[1] == (tree[1]["own_end"] - tree[1]["start"]) // 4 + total[2]
    assert [s["title"] for s in chunking.thin(tree, 2)] == ["A", "C"]


def test_packing_spans_and_headers():
    assert chunking.pack_blocks([3, 3, 5, 9, 1], 6) == [0, 0, 1, 2, 3]
    assert chunking.split_batches([1, 1, 1, 5], 5, 2) == [0, 0, 1, 2]
    assert chunking.merge_spans("New York City x", [(0, 3, "L"), (4, 8, "L"), (9, 13, "P")]) == [(0, 8, "L", "New York"), (9, 13, "P", "City")]
    assert chunking.header_quality("# A\n" + "x" * 50 + "\n# B\n" + "y" * 50) and not chunking.header_quality("no headers")


def test_slices_cover_a_text(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, "ab"), (3, ""), (4, None)], "id long, text string")
    spans = {}
    for r in chunking.slice_table(docs, "id", size=400, overlap=200).orderBy("id", "a").collect():
        spans.setdefault(r.id, []).append((r.a, r.b))
    assert spans == {1: [(0, 400), (200, 600), (400, 800), (600, 1000)], 2: [(0, 2)]}


def test_subtree_totals_of_a_deep_tree(spark):
    tree = spark.createDataFrame([(1, i, i - 1 if i else None, 1) for i in range(14)], "g long, seq long, parent long, tokens long")
    assert {r.seq: r.total for r in chunking.subtree_totals(tree, ["g"]).collect()} == {i: 14 - i for i in range(14)}


# ---------------------------------------------------------------- upkeep


def test_pruning_drops_only_newly_empty_observations(spark):
    schema = "model_id long, observations array<struct<title string, evidence array<struct<unit_id long>>>>"
    models = spark.createDataFrame([(1, [("a", [(1,), (2,)]), ("b", [(3,)]), ("empty", [])]), (2, [("c", [(3,)])])], schema)
    got = {r.model_id: [(o.title, [e.unit_id for e in o.evidence]) for o in r.observations] for r in maintenance.prune_evidence(models, spark.createDataFrame([(3,)], "unit_id long")).collect()}
    assert got == {1: [("a", [1, 2]), ("empty", [])]}


def test_queue_events(spark):
    queue = spark.createDataFrame([(1, 2, "completed", 1.3, 2), (4, 0, "completed", 0.2, 3)], "key long, evidence long, status string, priority double, retries long")
    entities = spark.createDataFrame([(k, 100, 9) for k in range(1, 7)], "key long, mention_count long, retrieval_count long")
    events = [(1, "retrieval", 1), (2, "extraction", 1), (2, "extraction", 2), (3, "deletion", 1), (4, "deletion", 1), (4, "retrieval", 2), (5, "retrieval", 1)]
    rows, counted = maintenance.apply_events(queue, spark.createDataFrame(events, "key long, kind string, at long"), entities)
    got = {r.key: (r.evidence, r.status, r.priority, r.retries) for r in rows.collect()}
    # 0.5 evidence + 0.2 * 2 + 0.3 * log10(9 or 10); a retrieval renews it and queues nothing, not even after a deletion.
    assert got == {1: (2, "completed", 1.7, 2), 2: (2, "pending", 1.6863, 0), 3: (0, "pending", 1.0, 0), 4: (0, "pending", 0.7, 0)}
    assert {r.key: r.retrieval_count for r in counted.collect()} == {1: 10, 2: 9, 3: 9, 4: 10, 5: 10, 6: 9}


@pytest.mark.parametrize(("ages", "want"), [([], "stale"), ([100, 50], "stale"), ([1, 2], "new"), ([1, 2, 3, 4, 40], "strengthening"), ([10, 40, 45, 50, 60, 70, 80], "weakening"), ([5, 10, 40, 50, 60, 70], "stable"), ([1, 200], "strengthening"), ([1, 200, 201, 202, 203, 204], "weakening"), ([30], "stale")])
def test_trends(spark, ages, want):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    stamps = F.array(*[F.expr(f"timestampadd(DAY, -{a}, TIMESTAMP_NTZ'2024-06-01 00:00:00')") for a in ages]) if ages else F.array().cast("array<timestamp_ntz>")
    assert spark.range(1).select(maintenance.trend(stamps, now).alias("t")).first().t == want


def test_a_missing_time_of_evidence_counts_as_now(spark):
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(maintenance.trend(F.array(F.lit(None).cast("timestamp_ntz")), at).alias("t")).first().t == "new"


def test_authority_and_confidence(spark):
    units = spark.createDataFrame([(i, 0.5) for i in range(1, 6)], "unit_id long, confidence double")
    schema = "new_id long, existing_id long, relation string, new_at date, existing_at date, hint string, place int"
    rows = [(1, 2, "weaken", date(2024, 1, 1), date(2024, 2, 1), None, 0), (3, 4, "contradict", None, date(2024, 2, 1), "x", 1), (3, 5, "reinforce", None, None, None, 2), (5, 2, "agree", None, None, None, 3)]
    v = spark.createDataFrame(rows, schema).withColumn("winner", maintenance.authority(F.col("new_at"), F.col("existing_at"), F.col("hint")))
    assert [r.winner for r in v.orderBy("place").collect()] == ["existing", "new", "new", "new"]
    got = {r.unit_id: round(r.confidence, 6) for r in maintenance.update_confidence(units, v).collect()}
    assert got == {1: 0.4, 2: 0.5, 3: 0.6, 4: 0.3, 5: 0.6}


def test_freshness_counts_whole_days_and_both_ends(spark):
    rows = [(1, 30.9, 0.9), (2, 31.0, 0.9), (3, 6.9, 0.9), (4, None, 0.9), (5, 1.0, 0.4), (6, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "unit_id long, age double, confidence double")
    links = spark.createDataFrame([(6, 9, "weakens")], "from_id long, to_id long, link_type string")
    df = df.join(maintenance.contested_units(links).withColumn("hit", F.lit(True)), "unit_id", "left")
    flag = maintenance.freshness(F.lit(False), F.coalesce("hit", F.lit(False)), F.col("confidence"), F.col("age"))
    assert {r.unit_id: r.f for r in df.select("unit_id", flag.alias("f")).collect()} == {1: "aging", 2: "stale", 3: "fresh", 4: "aging", 5: "stale", 6: "contested"}


def test_graph_paths_are_neither_damped_nor_merged(spark):
    units = spark.createDataFrame([(1, None), (2, None)], "unit_id long, event_date timestamp_ntz")
    ue = spark.createDataFrame([(1, 10), (2, 20)], "unit_id long, entity_id long")
    entities = spark.createDataFrame([(10, 1), (11, 1), (20, 6)], "entity_id long, mention_count long")
    pairs = spark.createDataFrame([(10, 20, 7), (11, 20, 3)], "e1 long, e2 long, n long")
    seeds = spark.createDataFrame([(0, 10, 1.0), (0, 11, 1.0)], "query_id long, entity_id long, weight double")
    rows = strategies.cooccurrence_graph(units, ue, entities, pairs, seeds, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert sorted(round(r.score, 6) for r in rows.where("id = 2").collect()) == [round(math.log(4) / math.log(8), 6), 1.0]


def test_link_expansion_adds_causes_and_may_reach_seeds(spark):
    links = [(1, 3, "causes", 0.5, None), (2, 3, "enables", 0.4, None), (1, 4, "causes", 0.2, None), (1, 2, "entity", 1.0, 7), (1, 2, "entity", 1.0, 8), (5, 1, "semantic", 0.9, None), (1, 5, "semantic", 0.8, None)]
    df = spark.createDataFrame(links, "from_id long, to_id long, link_type string, weight double, entity_id long")
    seeds = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "query_id long, unit_id long")
    got = {r.id: round(r.score, 6) for r in strategies.link_expansion(df, seeds).collect()}
    assert got == {3: 1.3, 2: round(math.tanh(1.0), 6), 5: 0.9}


def test_partitioned_fusion_gives_rare_kinds_a_pool(spark):
    rows = [(0, i, "world", float(i)) for i in range(30)] + [(0, 100, "event", 99.0)]
    pool = spark.createDataFrame(rows, "query_id long, id long, kind string, score double")
    models = spark.createDataFrame([(0, -1, 0.5)], "query_id long, id long, score double")
    got = fusion.fuse_partitioned({"keyword": pool, "graph": pool}, ["world", "event", "observation"], 3, 10, models=models).orderBy("place").collect()
    assert [(r.id, r.kind) for r in got] == [(29, "world"), (100, "event"), (-1, "mental_model"), (28, "world"), (27, "world")]


def test_statuses_and_pointers(spark):
    notes_ = spark.createDataFrame([(i, "active", 9, 8, 2) for i in range(1, 6)], "note_id long, status string, superseded_by long, appended_to long, summary_version long")
    changes = spark.createDataFrame([(1, "superseded", 5), (2, "appended", 5), (3, "active", None), (4, "lost", 5)], "note_id long, new_status string, linked_id long")
    got = {r.note_id: (r.status, r.superseded_by, r.appended_to, r.summary_version) for r in notes.set_status(notes_, changes).collect()}
    assert got == {1: ("superseded", 5, 8, 2), 2: ("appended", 9, 5, 2), 3: ("active", None, None, None), 4: ("active", 9, 8, 2), 5: ("active", 9, 8, 2)}


def test_closest_in_time_against_brute_force(spark):
    import random

    r = random.Random(2)
    hour = [r.choice([r.randint(0, 60), 7, 7.5]) for _ in range(150)]
    at = [datetime(2024, 1, 1) + timedelta(hours=h) for h in hour]
    df = spark.createDataFrame(list(enumerate(at)), "unit_id long, event_date timestamp_ntz")
    want = set()
    for i, t in enumerate(at):
        if i % 3 == 0:
            near = sorted((abs((t - u).total_seconds()), j) for j, u in enumerate(at) if j != i and abs((t - u).total_seconds()) <= 5 * 3600)
            want |= {(i, j) for _, j in near[:4]}
    got = links.within_hours(df.where("unit_id % 3 = 0"), df, hours=5, k=4, slots=5).collect()
    assert {(x.from_id, x.to_id) for x in got} == want


def test_neighbours_across_buckets_and_without_a_time(spark):
    at = [None, datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 3), None, datetime(2024, 1, 1, 0, 1)]
    df = spark.createDataFrame([(i, t, None if i < 5 else "g") for i, t in enumerate(at)], "unit_id long, event_date timestamp_ntz, g string")
    got = {r.unit_id: (r.before_id, r.after_id) for r in graph.closest_in_time(df, ["g"]).collect()}
    assert got == {0: (None, 4), 4: (0, 1), 1: (4, 2), 2: (1, 3), 3: (2, None), 5: (None, None)}


def test_contradiction_candidates_against_brute_force(spark):
    import random

    r = random.Random(3)
    units = [(i, r.randint(0, 1), r.choice([None, *range(9)]), r.choice(["active", "active", "stale"]), [r.gauss(0, 1) for _ in range(4)] if i % 4 else None) for i in range(120)]
    ue = [(i, r.randint(0, 3), units[i][1]) for i in range(120)] + [(i, 9, units[i][1]) for i in range(0, 120, 2)]
    u = spark.createDataFrame(units, "unit_id long, vault_id int, note_id int, status string, embedding array<double>")
    e = spark.createDataFrame(ue, "unit_id long, entity_id int, vault_id int")
    got = {}
    for x in links.contradiction_candidates(u.where("unit_id % 10 = 1"), u, e, k=5, threshold=0.5, near=7).orderBy("place").collect():
        got.setdefault(x.unit_id, []).append(x.other_id)

    def cos(a, b):
        return sum(p * q for p, q in zip(a, b)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))

    for i in range(1, 120, 10):
        mine = {k for j, k, _ in ue if j == i}
        found = {j for j, k, v in ue if k in mine and v == units[i][1]}
        if units[i][4]:
            near = sorted((-cos(units[i][4], x[4]), x[0]) for x in units if x[0] != i and x[1] == units[i][1] and x[3] == "active" and x[4] and cos(units[i][4], x[4]) > 0.5)
            found |= {j for _, j in near[:7]}
        by_note = {}
        for j in sorted(found - {i}):
            if units[j][3] == "active":
                by_note.setdefault(-1 if units[j][2] is None else units[j][2], []).append(j)
        order = [(t, n, j) for n, js in by_note.items() for t, j in enumerate(js)]
        assert got.get(i, []) == [j for _, _, j in sorted(order)[:5]]


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k long, v string, at long")
    assert {r.k: r.v for r in maintenance.upsert(old, new, ["k"], "at").collect()} == {1: "c", 2: "b", 3: "e"}
    tables = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(10, 1), (20, 2)], "b_id long, id long"), "c": spark.createDataFrame([(100, 10), (200, 20)], "c_id long, b_id long")}
    left = maintenance.delete_cascade(tables, "a", spark.createDataFrame([(1,)], "id long"), [("a", "id", "b", "id"), ("b", "b_id", "c", "b_id")])
    assert [left[n].count() for n in "abc"] == [1, 1, 1] and left["c"].first().c_id == 200


def test_block_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "note_id long, hash string")
    b = spark.createDataFrame([(1, "y"), (1, "z"), (1, "z")], "note_id long, hash string")
    assert {(r.hash, r.change) for r in dedup.block_diff(a, b, ["note_id"]).collect()} == {("x", "removed"), ("y", "retained"), ("z", "added")}


def test_candidates_and_context(spark):
    inputs = spark.createDataFrame([("robert smith", "Robert Smith", ["ann lee", "bob"], datetime(2024, 1, 31))], "normal string, name string, nearby array<string>, event_date timestamp_ntz")
    known = spark.createDataFrame([(1, "Zed", 5, datetime(2024, 1, 1)), (3, "Rhoberd Smyth", 2, datetime(2024, 1, 1)), (4, "Ann Lee", 14, None)], "entity_id long, name string, mention_count long, last_seen timestamp_ntz")
    aliases = spark.createDataFrame([(1, "robert smith jr")], "entity_id long, name string")
    got = {(r.entity_id, r.phonetic): r.name_score for r in resolve.candidates(inputs, known, aliases).collect()}
    assert set(got) == {(1, False), (3, True)} and got[1, False] > 0.7 and got[3, True] == 0.45  # sounds alike
    pairs = spark.createDataFrame([(1, 4, 2)], "e1 long, e2 long, n long")
    score = resolve.scored_candidates(inputs, known, aliases, pairs).where("entity_id = 1").first().score
    # One of two nearby names is a known neighbour, of 14 mentions: 1 / log2(16) / 2 = 1/8; a month has passed.
    assert score == pytest.approx(0.5 * got[1, False] + 0.3 / 8 + 0.2 / 2)


def test_lineage_limits_children(spark):
    edges = spark.createDataFrame([("r", f"c{i}") for i in range(5)] + [("c0", "d")], "parent string, child string")
    rows = graph.lineage(edges, spark.createDataFrame([("r",)], "root string"), depth=2, limit=3).collect()
    assert sorted((r.node, r.level) for r in rows) == [("c0", 1), ("c1", 1), ("c2", 1), ("d", 2), ("r", 0)]


def test_entity_links_are_made_once_and_not_shuffled(spark):
    rows = [(e, u, u) for e in (1, 2) for u in range(40)] + [(3, 7, 7), (None, 1, 1), (1, None, 2)]
    new = spark.createDataFrame([r for r in rows if r[1] is None or r[1] % 3 == 0 or r[0] == 3], "entity_id long, unit_id long, event_date long")
    known = spark.createDataFrame([r for r in rows if r[1] is None or r[1] % 2], "entity_id long, unit_id long, event_date long")  # some are new too
    found = links.by_entity(new.unionByName(new), known, last=9, block=4)
    want = set()
    for e in (1, 2):
        n, k = [u for u in range(40) if u % 3 == 0], [u for u in range(39, 0, -2)][:9]
        want |= {(e, x, y) for a in n for b in n + k if a != b for x, y in ((a, b), (b, a))}
    got = [(r.entity_id, r.from_id, r.to_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    top = found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert "Exchange" not in top and "HashAggregate" not in top


def test_entity_links_are_dealt_by_pairs_and_pack_in_files(spark, tmp_path):
    ids = spark.range(0, 200_000, 100).select(F.lit(1).cast("long").alias("entity_id"), F.col("id").alias("unit_id"), F.lit(0).cast("long").alias("event_date"))
    links.by_entity(ids, ids).write.parquet(f"{tmp_path}/links")
    assert spark.read.parquet(f"{tmp_path}/links").count() == 2_000 * 1_999
    assert sum(f.stat().st_size for f in tmp_path.glob("links/*.parquet")) < 0.5 * 2_000 * 1_999
    few = spark.createDataFrame([(e, 100 * i, 0) for e in (1, 2) for i in range(60)], "entity_id long, unit_id long, event_date long")
    new, known = few.where("entity_id = 1 AND unit_id % 300 < 200"), few
    new = new.unionByName(spark.createDataFrame([(3, 7, 0)], new.schema))
    found = links.by_entity(new, known, last=30, block=4, run=3, wide=2, per_task=50)
    assert found.rdd.getNumPartitions() == 33 + 50  # 1,601 pairs of new facts and 41 * 30 * 2 with known ones at most, 50 a task
    got = [(r.from_id, r.to_id) for r in found.collect()]
    n, k = [100 * i for i in range(60) if i % 3 < 2], [100 * i for i in range(30)]
    want = {(a, b) for a in n for b in n + k if a != b}
    assert len(got) == len(set(got)) and set(got) == want | {(b, a) for a, b in want}


def test_pairs_are_counted_in_tasks_by_the_size_of_the_input(spark):
    assert filters.tasks_for(spark, 10_000_001, 200_000) == 51 and filters.tasks_for(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(u, e, u % 3) for u in range(30) for e in range(u % 5)], "unit_id long, entity_id long, event_date long")
    one, dealt = graph.count_pairs(rows), graph.count_pairs(rows, tasks=37)
    assert dealt.rdd.getNumPartitions() == 37 and sorted(one.collect()) == sorted(dealt.collect())
    best = graph.neighbours(dealt, 2, 41)
    assert best.rdd.getNumPartitions() == 41 and sorted(best.collect()) == sorted(graph.neighbours(one, 2).collect())


def test_facts_are_dealt_into_tasks_by_their_number(spark, tmp_path):
    spark.range(2_500).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    rows = views.dealt(spark.range(100).withColumnRenamed("id", "unit_id"), spark, str(tmp_path), 100)
    assert rows.rdd.getNumPartitions() == 25 and rows.count() == 100
