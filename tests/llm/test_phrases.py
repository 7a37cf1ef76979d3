import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marlstone.llm import catalog
from marlstone.llm import phrases as P
from marlstone.llm.automata import Automaton


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, cover, top):
    """Every n-gram of every piece, in dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    around = {}
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                around[lang, p[i : i + k]] = max(a, around.get((lang, p[i : i + k]), 0))
    out = []
    for lang in sorted({x for x, _ in found}):
        rows = []
        for (own, p), a in found.items():
            if own == lang and not (x := around.get((lang, p), 0)) * 100 >= cover * a or own == lang and x == 0:
                s, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def texts(rng, words, n):
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("kw", [{}, {"range_chars": 900, "chunk_bytes": 300}, {"range_chars": 50, "chunk_bytes": 5000, "top": 7}])
def test_all_phrases_against_plain_counts(spark, kw):
    rng = random.Random(4)
    rows = texts(rng, ["the", "The", "a", "cat", "sat", "é", "x-y", "日本", "\x01", "b"] + ["of the"] * 3, 250)
    rows += [("en", "one two three four five. " * 40), ("de", "hot pair " * 400), ("de", "hot pair w%d hot pair. " * 50 % tuple(range(50))), ("en", None), (None, ""), ("", "no name " * 9), ("und", "é é é é é")]
    top = kw.get("top", 2000)
    got = sorted(map(tuple, P.collocations(table(spark, rows).repartition(5), least=6, top=top, **{k: v for k, v in kw.items() if k != "top"}).collect()))
    assert got == sorted(brute(rows, 6, 80, top)) and len({r[0] for r in got}) == 5


def test_contained_phrases_go_by_counts_of_dropped_ones_as_well(spark):
    rows = [("en", "a b c d. " * 10 + "a b c. " * 1 + "b c. " * 4)]
    assert sorted(map(tuple, P.collocations(table(spark, rows), least=10).collect())) == sorted(brute(rows, 10, 80, 2000))


def test_empty_and_no_candidates_and_more_columns(spark):
    assert P.collocations(table(spark, [])).count() == 0
    assert P.collocations(table(spark, [("en", "a b c"), ("en", None)])).count() == 0
    wide = spark.createDataFrame([("en", "a b. " * 40, 7, "s")], "lang string, text string, n int, score string")
    assert [tuple(r) for r in P.collocations(wide).collect()] == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000)]


def test_query_equals_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sorted(map(tuple, catalog.op11_phrases(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(duckdb.sql(P.ORACLE).fetchall()) and got


# ---------------------------------------------------------------- automata


def phrases(rng, n):
    return {tuple(rng.choice([b"a", b"ab", b"b", b"\xff", b"\x01"]) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 9) for _ in range(n)}


@pytest.mark.parametrize("seed", range(20))
def test_union_dump_cut_and_composition(seed):
    rng = random.Random(seed)
    a, b = phrases(rng, rng.randrange(40)), phrases(rng, rng.randrange(40))
    x, y = (Automaton.of_phrases(sorted(p.items())) for p in (a, b))
    whole = Automaton.union([x, Automaton.load(y.dump()), Automaton([], [])])
    both = {p: a.get(p, 0) + b.get(p, 0) for p in a | b}
    assert dict(whole.phrases()) == both
    assert dict(whole.at_least(6).phrases()) == {p: c for p, c in both.items() if c >= 6}
    assert dict(x.compose(y).phrases()) == {p: a[p] for p in b if p in a}
    bounds = sorted(phrases(rng, 4))
    parts = dict(whole.ranges(bounds))
    for i in range(len(bounds) + 1):
        want = {p: c for p, c in both.items() if (i == 0 or p >= bounds[i - 1]) and (i == len(bounds) or p < bounds[i])}
        assert dict(parts[i].phrases() if i in parts else ()) == want
    assert dict(Automaton.union(list(parts.values())).phrases()) == both


def test_counts_of_a_text_and_of_allowed_pairs_only():
    rng = np.random.default_rng(3)
    text = rng.integers(-1, 4, 400)
    words = [b"a", b"b", b"c", b"d"]
    allowed = rng.random(399) < 0.7
    for orders, flags in ((range(1, 3), None), (range(3, 5), allowed), (range(1, 5), None)):
        want = Counter()
        for n in orders:
            for i in range(len(text) - n + 1):
                if (text[i : i + n] >= 0).all() and (flags is None or flags[i : i + n - 1].all()):
                    want[tuple(words[j] for j in text[i : i + n])] += 1
        assert dict(Automaton.of_text(words, text, orders, flags).phrases()) == want
    assert len(Automaton.of_text([], np.zeros(0, np.int64), range(1, 5))) == 0
    assert len(Automaton.of_text([b"a"], np.zeros(1, np.int64), range(3, 5))) == 0
