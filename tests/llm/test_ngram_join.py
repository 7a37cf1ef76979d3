import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import candidates as K
from marlstone.llm import components as C
from marlstone.llm import ngram_join as J
from marlstone.llm import ngram_sets as G
from marlstone.llm.components import components


def brute_force(data, n, percent):
    sets = {}
    for doc, text in data:
        if doc is None:
            continue
        w = (text or "").encode().lower().split()
        sets.setdefault(doc, set()).update({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, data, **kw):
    rows = J.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), **kw).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def corpus(seed, n):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 300)}" for _ in range(r.randint(3, 120))] for _ in range(n // 6)]
    common = [f"c{i}" for i in range(40)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
        out.append((i, " ".join(w + (common if i % 3 == 0 else []))))
    return out


@pytest.mark.parametrize(("n", "percent", "block", "sets_block"), [(3, 90, 2048, 512), (5, 80, 2048, 512), (3, 90, 5, 4), (2, 70, 7, 3)])
def test_components_match_all_pairs(spark, n, percent, block, sets_block):
    data = corpus(percent + block, 180)
    assert run(spark, data, n=n, percent=percent, block=block, sets_block=sets_block) == brute_force(data, n, percent)


def test_threshold_is_exact_in_whole_numbers(spark):
    words = [f"w{i}" for i in range(21)]  # 19 shingles; with the last word changed 18 are shared of 20
    data = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, " ".join(words[:-2] + ["x", "y"]))]
    assert run(spark, data) == {1: (19, 1), 2: (19, 1), 3: (19, 3)}


def test_short_empty_null_and_repeated(spark):
    data = [(1, "one two"), (2, "ONE  two"), (3, "one"), (4, ""), (5, None), (6, " \t"), (7, ""), (8, "Éa b c"), (9, "éa b c"), (10, "one two"), (10, "one two")]
    got = run(spark, data)
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[10] == (1, 1) and got[3] == (1, 3)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7)) and got[8] == (1, 8) and got[9] == (1, 9)
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in J.jaccard_components(df).collect()) == [(-1, -1), (1, 1)]
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_one_of_each_group_stays_with_its_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "k", 1), (1, text + " x", "k", 1), (2, "other words here", "k", 1), (None, text, "k", 1)], "doc_id long, text string, key string, rep int")
    assert sorted(r.doc_id or 0 for r in J.keep_one(df, n=3, percent=90).collect()) == [0, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 24), min_size=1, max_size=20), min_size=2, max_size=14), st.sampled_from([60, 80, 90]))
def test_prefix_tree_finds_every_component(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    found = J.UnionFind(len(sets))
    for i, j in J.PrefixTree(arrays).links(percent):
        assert 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        found.union(i, j)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= percent * len(a | b):
                assert found.find(i) == found.find(j)


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(1)
    for size in (10, 300, 5000, 40_000):
        a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.97)], r.integers(0, 1 << 63, size // 50, dtype=np.uint64)]))
        bits = K.Bitmaps([G.bitmap(x, G.bitmap_words(len(x), 90)) for x in (a, b)])
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert 100 * inter >= 90 * union
        assert bits.may_link(np.array([0]), np.array([1]), np.array([G.most_differences(len(a), len(b), 90)]))[0]


@pytest.mark.parametrize(("hub", "one_task"), [(20_000, 200_000), (20_000, 0), (3, 0)])
def test_connected_components_of_chains_and_stars(spark, hub, one_task, monkeypatch):
    monkeypatch.setattr(C, "HUB", hub)
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


def test_slices_do_not_change_sets(monkeypatch):
    text = " ".join(f"w{i % 700}\t" for i in range(5000)) + "x" * 900
    whole = G.ngram_set(text, 3, G.WordHashes())
    monkeypatch.setattr(G, "SLICE", 97)
    assert G.ngram_set(text, 3, G.WordHashes()).tolist() == whole.tolist()
    assert len(G.ngram_set(" \n " * 100, 3, G.WordHashes())) == 0


def shared_passages(seed, n):
    """A third of the texts hold one passage, for some it is nearly all they are; n // 3 near copies of one text; mixtures of two passages."""
    r = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(4)]
    text = [f"t{i}" for i in range(90)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            w = [f"o{r.randint(0, 10**6)}" for _ in range(r.choice([3, 8, 20, 90]))] + passages[0]
        elif i % 3 == 1:
            w = list(text)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
        else:
            a, b = r.sample(passages, 2)
            w = a[: r.randint(50, 60)] + b[: r.randint(50, 60)]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 20), (5, 80, 12)])
def test_common_passages_and_large_groups_of_near_copies(spark, n, percent, block):
    data = shared_passages(block, 420)
    assert run(spark, data, n=n, percent=percent, block=block, sets_block=16) == brute_force(data, n, percent)


def test_common_ngrams_go_last(spark, monkeypatch):
    common = np.array([3, 5], np.uint64)
    grams = np.arange(1, 21, dtype=np.uint64)
    rare, last = G.prefix(grams, 20, 90, common)
    assert rare.tolist() == [1, 2, 4] and last.tolist() == []
    assert G.prefix(np.array([3, 5], np.uint64), 2, 50, common)[1].tolist() == [3, 5]
    assert G.prefix(grams[:3], 20, 90, common) is None
    df = spark.createDataFrame([(7, 9), (8, 5), (-1, 40), (2, 1)], "gram long, df long")
    assert K.common_grams(df, 4, common).tolist() == [3, 5, 7, 8, 2**64 - 1]
    monkeypatch.setattr(K, "MAX_COMMON", 2)
    assert K.common_grams(df, 4, common[:0]).tolist() == [7, 2**64 - 1]
    monkeypatch.setattr(K, "MAX_COMMON", 0)
    assert len(K.common_grams(df, 4, common[:0])) == 0


@pytest.mark.parametrize("most", [0, 40])
def test_a_bounded_list_of_common_ngrams_loses_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(K, "MAX_COMMON", most)
    monkeypatch.setattr(G, "MAX_BROADCAST_IDS", most)  # and ids beyond the bound are shuffled
    data = shared_passages(3, 150)
    assert run(spark, data, block=10, sets_block=8) == brute_force(data, 3, 90)


def test_counts_of_a_partition_are_whole(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(K, "COUNTED", 16)
    r = random.Random(1)
    sets = [sorted(r.sample(range(40), r.randint(1, 9))) for _ in range(60)]
    batches = (pd.DataFrame({"grams": [np.array(s, np.int64).tobytes() for s in sets[i : i + 3]]}) for i in range(0, 60, 3))
    got = pd.concat(K._counted(batches)).groupby("gram")["df"].sum().to_dict()
    assert got == {g: n for g in range(40) if (n := sum(g in s for s in sets))}
