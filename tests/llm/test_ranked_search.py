import heapq
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marlstone.llm import catalog
from marlstone.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(docs, items, k):
    """Every document against every item, in Python's integers."""
    words = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t or "")))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, w in words:
            tf, m = Counter(w), 50 + (50 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k, **kw):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, R.best_documents(docs, items, k, **kw).collect()), key=str)


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 7, "shard_cells": 40}, {"block_bytes": 60}])
def test_all_documents_against_all_items(spark, kw):
    rng = random.Random(3)
    words = ["a", "B", "cé", "D9", "ee", "f", "ß", "h", "日本", "j"]
    text = lambda n: " ".join(rng.choices(words, range(10, 0, -1), k=n)) + rng.choice(["", ".", "-A_b"])
    docs = [(i, text(rng.randrange(40))) for i in range(120)] + [(500, "B " * 3000), (501, ""), (502, None), (503, "..-_"), (None, "a b"), (7, "j j")]
    docs += [(600 + i, "ee f") for i in range(30)]  # ties
    items = [(i, text(6)) for i in range(9)] + [(9, None), (10, "unknown words"), (3, "ee ee"), (None, "f")]
    assert found(spark, docs, items, 5, **kw) == brute(docs, items, 5)


def test_terms_are_runs_and_only_ascii_is_lowered():
    assert R.terms_of("Ab-c_D É9 x\x85y z") == ["ab".encode(), b"c", b"d", "É9".encode(), "x\x85y z".encode()]
    every = "".join(map(chr, range(256)))
    assert [t.decode() for t in R.terms_of(every)] == TERM.findall(lower(every))


def test_the_search_stops_early_and_strictly_below():
    n = 4000
    ids = np.arange(n)
    points = np.sort(np.random.default_rng(1).integers(1, 10**6, n))[::-1]
    lists = [(np.arange(n), points), (np.arange(n), points // 2)]
    best = []
    assert R.best_positions(lists, ids, best, 10) < 100
    assert sorted(best, reverse=True) == heapq.nlargest(10, zip((points + points // 2).tolist(), (-ids).tolist()))
    even = [(np.arange(n)[::-1].copy(), np.ones(n, np.int64))]  # all are equal, so the smallest ids are found only at the end
    best = []
    assert R.best_positions(even, ids, best, 10) == n
    assert sorted(-d for _, d in best) == list(range(10))


def test_direct_access_moves_the_best_position():
    """What one list shows at its top is next in the other: by the places read last the bound would be 10, by best positions it is 2."""
    n = 640
    points = np.where(np.arange(n) < 40, 5, 1)
    lists = [(np.arange(n), points), (np.r_[32:64, 0:32, 64:n], points)]
    best = []
    assert R.best_positions(lists, np.arange(n), best, 10) == 64 and sorted(best, reverse=True)[0] == (10, 0)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == [] and found(spark, [(1, "a")], [], 5) == [] and found(spark, [(1, None)], [(1, None)], 5) == []
    docs = spark.createDataFrame([(1, "a b", "en", 3)], "doc_id long, text string, item_id string, rank int")
    assert R.best_documents(docs, docs.select(docs.doc_id.alias("item_id"), "text", docs.rank.alias("n"))).count() == 1


def test_query_equals_sql(spark):
    docs = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS FROM '{docs}/{t}.parquet'")
    want = sorted(duckdb.sql(R.ORACLE).fetchall())
    assert sorted(map(tuple, catalog.op12_ranked_search(spark, docs).collect())) == want and want
