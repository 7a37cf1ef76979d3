import math
import random
from datetime import datetime, timedelta

import pytest

from marlstone.operators import dedup
from marlstone.operators import nearest as N


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)


@pytest.mark.parametrize("rows", [16_384, 7])
def test_duplicate_facts_against_all_pairs(spark, rows):
    """Also before 1970, at the first moment of a bucket, and with many copies; groups of few rows change nothing."""
    rng, start = random.Random(4), datetime(1969, 12, 30)
    made = []
    for i in range(240):
        v = [rng.gauss(0, 1) for _ in range(3)] if i % 5 else None
        made.append((i, i % 2 if i % 17 else None, f"t{rng.randrange(60)}", v, start + timedelta(minutes=30 * rng.randrange(0, 150))))
    made += [(300 + i, 1, "same", [1.0, 2.0, 2.0 + i % 2], start + timedelta(hours=12 * (i % 4))) for i in range(40)]
    made += [(400, 0, "edge", None, datetime(1969, 12, 31, 23, 30)), (401, 0, "edge", None, datetime(1970, 1, 1, 10)), (402, 1, "zero", [0.0, 0.0, 0.0], start), (403, 1, "short", [1.0, 2.0], start)]
    facts = spark.createDataFrame(made, "unit_id long, vault_id int, text string, embedding array<double>, event_date timestamp_ntz")
    got = {(r.unit_id, r.kind) for r in dedup.duplicate_facts(facts.where("unit_id % 2 = 0"), facts, rows=rows).collect()}
    want, hour = {}, lambda t: (t - datetime(1970, 1, 1)).total_seconds() / 3600
    for i, vault, text, v, t in made:
        for j, other, text2, w, u in made:
            if i % 2 == 0 and i != j and vault is not None and vault == other and abs(hour(u) - math.floor(hour(t) / 12) * 12) <= 12:
                if text == text2:
                    want[i] = "exact"
                elif v and w and any(v) and any(w) and len(v) == len(w) and 1 - cosine(v, w) < 0.05:
                    want.setdefault(i, "near")
    assert got == set(want.items()) and {"exact", "near"} == set(want.values()) and 400 not in want


@pytest.mark.parametrize("few", [10_000, 5])
def test_nearest_within_a_value(spark, monkeypatch, few):
    monkeypatch.setattr(N, "MAX_QUERIES", few)
    rng = random.Random(8)
    rows = [(i, ["a", "b", None][i % 3], [rng.gauss(0, 1) for _ in range(4 if i % 7 else 2)]) for i in range(200)]
    known = spark.createDataFrame(rows, "id long, kind string, embedding array<double>")
    asked = known.where("id % 10 = 1").withColumnsRenamed({"id": "query_id", "embedding": "query_vector"})
    got = sorted((r.query_id, r.id) for r in N.nearest(known, asked, 3, within="kind", least=0.1, other=True).collect())
    want = []
    for q, a, v in rows[1::10]:
        near = sorted((-cosine(v, w), i) for i, b, w in rows if a and a == b and i != q and len(v) == len(w) and cosine(v, w) >= 0.1)
        want += [(q, i) for _, i in near[:3]]
    assert got == sorted(want) and want
