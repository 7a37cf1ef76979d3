from collections import Counter, defaultdict

import pytest

from marlstone.llm import packing as P


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.bin_id, r.slot))


def make(spark, data, extra=""):
    return spark.createDataFrame(data, "doc_id long, text string, source string" + extra)


def test_each_choice_is_that_of_an_exhaustive_search():
    """Every piece goes to a bin without conflict that has the least room among all of these, or to a new bin if there is none."""
    import random

    r = random.Random(4)
    for _ in range(200):
        items = [(i, r.randint(0, 60), r.choice(["a", "b", "c", "d", None]), r.choice([1, 2, 3, None, None])) for i in range(r.randint(1, 80))]
        packer, bins = P.Packer(100), []  # room, sources, clusters
        ordered = sorted(items, key=lambda x: (-x[1], x[0]))
        for (_, size, source, cluster), s, c in zip(ordered, P._bits([x[2] for x in ordered]), P._bits([x[3] for x in ordered])):
            fit = [b[0] for b in bins if b[0] >= size and source not in b[1] and cluster not in b[2]]
            k = packer.add(size, s, c)
            if fit:
                assert k < len(bins) and bins[k][0] == min(fit) and source not in bins[k][1] and cluster not in bins[k][2]
            else:
                assert k == len(bins)
                bins.append([100, set(), set()])
            bins[k][0] -= size
            bins[k][1] |= {source} - {None}
            bins[k][2] |= {cluster} - {None}
        assert packer.n_bins == len(bins)


def test_every_unit_is_packed_once_without_conflicts(spark):
    data = [(i, "x" * (37 * i % 900), f"s{i % 3}" if i % 2 else "hot") for i in range(300)] + [(1000, "y" * 5000, "big")]
    got = rows(P.best_fit_pack(make(spark, data), capacity=1024, shard_docs=100))
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == {i: len(t) for i, t, _ in data}
    source = {i: s for i, _, s in data}
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r.bin_id].append(r)
    for members in by_bin.values():
        assert sum(r.length for r in members) == members[0].bin_length <= 1024
        assert max(Counter(source[r.doc_id] for r in members).values()) == 1
        assert [r.slot for r in members] == list(range(len(members)))
    pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 1000)
    assert [p[1] for p in pieces] == [0, 1024, 2048, 3072, 4096] and sum(p[2] for p in pieces) == 5000


def test_copies_do_not_meet(spark):
    got = rows(P.best_fit_pack(make(spark, [(i, "Same  text" if i % 2 else "same text", None) for i in range(6)]), capacity=100))
    assert len({r.bin_id for r in got}) == 6


def test_nulls_empty_texts_repeated_rows_and_empty_tables(spark):
    data = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "abc", None), (2, "abc", None)]
    got = rows(P.best_fit_pack(make(spark, data), capacity=10))
    assert len(got) == 5 and sum(r.length for r in got) == 6
    assert P.best_fit_pack(make(spark, []), capacity=10).count() == 0


@pytest.mark.parametrize("names", ["bin_id string, shard int, length long, bin string"])
def test_clashing_columns(spark, names):
    df = make(spark, [(1, "abc", "s", "b", 3, 4, "x")], ", " + names)
    assert rows(P.best_fit_pack(df, capacity=10))[0].length == 3
