import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import nearest as N


def vectors(rng, n, dim=6):
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(n + 40, None), (n + 41, [0.0] * dim), (n + 42, [math.nan] * dim), (n + 43, [1.0, 2.0]), (n + 44, [1.0, None, *[0.0] * (dim - 2)]), (n + 45, [])]
    return rows


def brute(known, asked, k, l2, least, other):
    good = lambda v: v and all(x is not None and not math.isnan(x) for x in v) and (l2 or any(v))
    out = []
    for q, a in asked:
        scored = []
        for i, b in known:
            if good(a) and good(b) and len(a) == len(b) and not (other and q == i):
                s = math.dist(a, b) if l2 else sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
                if least is None or s >= least:
                    scored.append((round(s if l2 else -s, 9), i))
        out += [(q, i, round(abs(s) if l2 else -s, 6)) for s, i in sorted(scored)[:k]]
    return sorted(out)


def found(spark, known, asked, k, **kw):
    a = spark.createDataFrame(known, "id long, embedding array<double>")
    b = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    return sorted((r.query_id, r.id, round(r.score, 6)) for r in N.nearest(a.repartition(5), b, k, **kw).collect())


@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize(("l2", "least", "other"), [(False, None, False), (False, 0.5, True), (True, None, True)])
def test_against_all_pairs(spark, blocked, l2, least, other):
    rng = random.Random(3)
    known = vectors(rng, 300)
    asked = known[::7] + [(3, known[3][1]), (5000, None)]
    asked = list({q: (q, v) for q, v in asked}.values())
    kw = {"pivots": 7, "block_rows": 20, "query_rows": 5} if blocked else {}
    if blocked:  # a join of one width: that of most vectors
        asked = [(q, v) for q, v in asked if v is None or len(v) != 2]
    assert found(spark, known, asked, 4, blocked=blocked, l2=l2, least=least, other=other, **kw) == brute(known, asked, 4, l2, least, other)


def test_pools_by_value(spark):
    rng = random.Random(5)
    rows = [(i, ["a", "b", None][i % 3], [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    known = spark.createDataFrame(rows, "id long, kind string, embedding array<double>")
    asked = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0, 0.0])]
    got = sorted((r.query_id, r.kind or "", r.id) for r in N.nearest(known, spark.createDataFrame(asked, "query_id long, query_vector array<double>"), 3, by=("kind",)).collect())
    want = sorted((q, kind or "", i) for kind in ("a", "b", None) for q, i, _ in brute([(i, v) for i, k, v in rows if k == kind], asked, 3, False, None, False))
    assert got == want


def test_blocks_are_passed_over_and_both_sides_are_bounded(spark):
    """Vectors in clusters: most blocks are passed over, and no group has more rows of either side than it may."""
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(25)]
    rows = [(i, [c + rng.gauss(0, 0.03) for c in centres[i % 25]]) for i in range(2000)]
    known = N._usable(spark.createDataFrame(rows, "id long, embedding array<double>"), "id", "embedding", (), False)
    hits, counts = N._blocked(known, known, 5, False, None, True, 30, 50, 40)
    assert counts["visits"] < 0.25 * counts["possible"], counts
    got = N.top_per_group(hits, ["query_id"], [F.desc("score"), F.asc("id")], 5)
    assert sorted((r.query_id, r.id) for r in got.where("query_id < 40").collect()) == [(q, i) for q, i, _ in brute(rows, rows[:40], 5, False, None, True)]


def test_copies_of_one_vector_are_dealt_out(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    assert found(spark, rows, rows[:5], 3, blocked=True, other=True, pivots=4, block_rows=16, query_rows=2) == brute(rows, rows[:5], 3, False, None, True)


def test_empty_and_too_many(spark, monkeypatch):
    assert found(spark, [], [(1, [1.0])], 3) == [] and found(spark, [(1, [1.0])], [], 3) == [] and found(spark, [], [(1, [1.0])], 3, blocked=True) == []
    monkeypatch.setattr(N, "MAX_QUERIES", 2)
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    assert found(spark, rows, rows, 2) == brute(rows, rows, 2, False, None, False)  # beyond the bound the join in blocks takes over
    with pytest.raises(ValueError, match="more than 2"):
        found(spark, rows, rows, 2, blocked=False)


@pytest.mark.parametrize("even", [-1.0, 2.0])
@pytest.mark.parametrize(("l2", "least", "other"), [(False, None, False), (False, 0.5, True), (True, None, True)])
def test_grid_and_bounds_find_the_same(spark, monkeypatch, even, l2, least, other):
    """Whatever a sample says of the vectors, the join by bounds and the grid of all pairs are exact."""
    monkeypatch.setattr(N, "EVEN", even)
    monkeypatch.setattr(N, "LEAST_ROWS", 20)
    rng = random.Random(4)
    known = [r for r in vectors(rng, 200) if r[1] is None or len(r[1]) != 2]
    asked = known[::5] + [(6000, known[3][1])]
    assert found(spark, known, asked, 4, blocked=True, l2=l2, least=least, other=other, pivots=7, block_rows=30, query_rows=9) == brute(known, asked, 4, l2, least, other)


def test_even_vectors_go_to_a_grid(spark, monkeypatch):
    """Vectors that lie evenly are not sent to every pivot: each query goes to as few parts as there are."""
    monkeypatch.setattr(N, "LEAST_ROWS", 100)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(1500)]
    known = N._usable(spark.createDataFrame(rows, "id long, embedding array<double>"), "id", "embedding", (), False)
    hits, counts = N._blocked(known, known, 3, False, None, True, 64, 1000, 1000)
    assert counts == {"blocks": 4, "visits": 6000, "possible": 6000}  # 4 tasks a core make 16 cells
    assert hits.rdd.getNumPartitions() == 16
    got = N.top_per_group(hits, ["query_id"], [F.desc("score"), F.asc("id")], 3)
    assert sorted((r.query_id, r.id) for r in got.where("query_id < 30").collect()) == [(q, i) for q, i, _ in brute(rows, rows[:30], 3, False, None, True)]


def test_widths_are_tested_on_the_vectors_as_given(spark):
    known = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    plan = N._usable(known, "id", "embedding", (), False).where("width = 2").groupBy().agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_own_rows_of_queries_asked_twice():
    import numpy as np

    v = np.eye(3)
    best = N.Best(np.array([7, 5, 7]), v, 3, False, None, True)
    best.add(np.array([5, 6, 7, 7]), np.eye(4)[:, :3] + 0.5)
    assert {(a, b) for a, b, _ in zip(*best.rows())} == {(5, 6), (5, 7), (7, 5), (7, 6)}
