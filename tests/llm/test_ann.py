import tracemalloc

import numpy as np
import pandas as pd
import pytest

from marlstone.llm import ann as A


def run(spark, rows, every=1, schema="vec_id long, embedding array<float>", **kw):
    got = A.nearest(spark.createDataFrame(rows, schema), lambda i: i % every == 0, **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def brute(rows, query, k):
    q = np.array(query[1], np.float32).astype(float)
    scored = [(-float(sum(a * b for a, b in zip(q.tolist(), np.array(v, np.float32).astype(float).tolist()))), i) for i, v in rows if i != query[0]]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, every=25, k=20)
    hit = total = 0
    for i in range(0, 1500, 25):
        want = brute(rows, rows[i], 20)
        assert len(got[i]) == 20 and [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)
        exact = {j: s for j, s in brute(rows, rows[i], 1500)}
        assert all(abs(exact[j] - s) < 1e-12 for j, s in got[i])
        hit += len({j for j, _ in want} & {j for j, _ in got[i]})
        total += 20
    assert hit / total >= 0.9


def test_both_sides_of_a_group_are_bounded(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(600, 8)).astype(np.float32))]
    assert run(spark, rows, k=4, chunk_rows=50, query_rows=40) == run(spark, rows, k=4)
    index = spark.createDataFrame([(i, v) for i, v in rows], "id long, v array<double>")
    left, right = A._sides(index, index, A.CrossPolytope(8, 2), range(2), 16, 4, 50, 40)
    for side, most in ((left, 50), (right, 40)):  # dealt by hash, so about so many
        assert max(x["count"] for x in side.groupBy("t", "g", "c", "p").count().collect()) <= 2 * most
    assert right.select("p").distinct().count() == 15


def _sides_of_a_group(queries, vectors, buckets, dim):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(vectors, dim)), r.normal(size=(queries, dim))
    left = pd.DataFrame({"id": np.arange(vectors), "b": r.integers(0, buckets, vectors).astype(np.int32), "v": list(x)})
    return left, pd.DataFrame({"id": 5 * np.arange(queries), "buckets": [np.arange(buckets)] * queries, "v": list(y)})


def test_what_a_group_makes_is_bounded():
    left, right = _sides_of_a_group(4000, 2000, 16, 32)
    tracemalloc.start()
    try:
        assert len(A._meet(left, right, 20)) == 4000 * 20
        assert tracemalloc.get_traced_memory()[1] < 150e6  # 1,280,000 pairs of vectors are 655 MB
    finally:
        tracemalloc.stop()


def test_blocks_do_not_change_what_is_found(monkeypatch):
    left, right = _sides_of_a_group(70, 150, 4, 3)
    left.loc[100:, "id"] -= 100  # several vectors of an id
    left.loc[:60, "v"] = left.loc[:60, "b"].map(lambda b: [float(b), 0.0, 0.0])
    right.loc[:40, "v"] = right.loc[:40, "id"].map(lambda i: [0.0, 0.0, float(i)])  # many ties
    want = A._meet(left, right, 5).sort_values(["query_id", "vec_id"]).values.tolist()
    scores = {}
    for q in right.itertuples():
        for v in left.itertuples():
            if v.id != q.id:
                scores.setdefault(q.id, {}).setdefault(v.id, []).append(sum(a * b for a, b in zip(q.v, v.v)))
    best = {q: sorted((-max(s), v) for v, s in by.items())[:5] for q, by in scores.items()}
    assert [(q, v) for q, v, _ in want] == sorted((q, v) for q, found in best.items() for _, v in found)
    monkeypatch.setattr(A, "QUERY_BLOCK", 7)
    monkeypatch.setattr(A, "PRODUCTS", 50)
    assert A._meet(left, right, 5).sort_values(["query_id", "vec_id"]).values.tolist() == want


def test_queries_leave_python_once_a_group_and_floats_stay_floats(spark):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 8)).astype(np.float32))]
    usable = A._usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    left, right = A._sides(usable, usable, A.CrossPolytope(8, 2), range(2), 16, 4, 10, 500)
    assert left.schema["v"].dataType.simpleString() == right.schema["v"].dataType.simpleString() == "array<float>"
    plan = right._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan.split("MapInPandas")[0] and right.select("t", "g", "c").distinct().count() > 2 * 4 * 4


def test_copies_ties_and_few_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0, 0.0]), (101, [0.9, 0.1, 0.0])]
    got = run(spark, rows, k=5, chunk_rows=8)
    for i in (0, 3, 59, 100):
        assert got[i] == brute(rows, (i, dict(rows)[i]), 5)
    few = rows[:1] + rows[-2:]
    assert {q: [j for j, _ in v] for q, v in run(spark, few, k=20).items()} == {i: [j for j, _ in brute(few, (i, v), 20)] for i, v in few}


def test_repeated_rows_and_several_vectors_of_an_id_count_once(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0, 0.0]), (101, [0.9, 0.1, 0.0])]
    want = {i: brute(rows, (i, dict(rows)[i]), 20) for i in dict(rows)}
    assert run(spark, rows * 2, k=20) == want and run(spark, rows * 3, k=20, chunk_rows=8) == want
    # Ids 0 to 9 have five vectors each, all nearer to the query than those of the others.
    many = [(i, [1.0, 0.001 * j, 0.0]) for i in range(10) for j in range(5)] + [(i, [0.5, 0.001 * i, 0.0]) for i in range(20, 40)] + [(999, [1.0, 0.0, 0.0])]
    assert [j for j, _ in run(spark, many, every=999, k=20)[999]] == [*range(10), *range(20, 30)]


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0])]
    got = run(spark, rows)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {7: [9, 8], 8: [9, 7], 9: [7, 8]}
    assert run(spark, []) == {} and run(spark, [(1, None)]) == {}


def test_clashing_columns(spark):
    got = run(spark, [(1, [1.0, 0.0], 1, 2, 3), (2, [1.0, 0.5], 1, 2, 3)], schema="vec_id long, embedding array<float>, id int, v int, b int")
    assert [j for j, _ in got[1]] == [2]


@pytest.mark.parametrize("dim", [2, 5, 64])
def test_rotation_keeps_lengths_and_the_bucket_is_the_nearest_axis(dim):
    x = np.random.default_rng(dim).normal(size=(50, dim))
    cp = A.CrossPolytope(dim, 3)
    for t in range(3):
        y = cp.rotate(x, t)
        assert np.allclose(np.linalg.norm(y, axis=1), 1)
        assert (cp.nearest(y, 1)[:, 0] == cp.bucket(y)).all()
