import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import nearest as N


def test_products_are_bounded():
    """What a task holds beside its input does not grow with a batch, whatever the queries; copies are no exception."""
    rng = np.random.default_rng(1)
    q, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(1500, 8)), rng.normal(size=(20_000, 8))))
    v[5_000:9_000] = v[0]
    tracemalloc.start()
    best = N.Best(np.arange(1500), q, 5, False, 0.2, False)
    best.add(np.arange(20_000), v)
    qid, ids, score = best.rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak
    near = q @ v.T
    for i in range(0, 1500, 50):
        mine = ids[qid == i]
        assert np.allclose(np.sort(near[i])[::-1][:5], near[i][mine]) and len(mine) == 5


def test_lengths_are_found_once_a_row(spark):
    """The filter on usable vectors holds no vectors: their lengths would be found again for each number of each."""
    known = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    plan = N._usable(known, "id", "embedding", (), False).groupBy().agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan
