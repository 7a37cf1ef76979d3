import random
import re

import pytest

from marlstone.operators import coverage, strategies


def stems(text):
    return [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in re.findall(r"[a-z0-9]+", text.lower())]


def by_windows(words, wanted):
    """Every stretch from one asked word to another that has all of them, and no shorter one inside that has."""
    at = [i for i, w in enumerate(words) if w in wanted]
    full = [(p, q) for p in at for q in at if p <= q and wanted <= set(words[p : q + 1])]
    tight = [x for x in full if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in full)]
    return sum(0.1 / (1 + (q - p + 1) - sum(p <= i <= q for i in at)) for p, q in sorted(tight))


def ranks(spark, docs, asked, **kw):
    units = spark.createDataFrame(docs, "unit_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    return {(r.query_id, r.id): round(r.score, 9) for r in strategies.keyword(units, queries, pool=10_000, **kw).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_all_words_against_every_window(spark, seed):
    rng = random.Random(seed)
    words = ["user", "pages", "cat", "dog", "noise", "the", "hat"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(80)] + [(900, None), (901, ""), (902, "cat " * 40 + "dog" + " cat" * 3)]
    asked = [(1, "cat dog"), (2, "cat"), (3, "page user hat cat"), (4, "cat the cat"), (5, "the of"), (6, "absent cat"), (7, None)]
    want = {}
    for q, text in asked:
        wanted = set(stems(text or "")) - {"the", "of"}
        for i, doc in docs:
            if wanted and (s := by_windows(stems(doc or ""), wanted)):
                want[q, i] = round(s, 9)
    assert ranks(spark, docs, asked, every=True) == want and any(q == 3 for q, _ in want)


def test_any_word_counts_places(spark):
    docs = [(1, "cat dog cat"), (2, "cats and a dog"), (3, "no match"), (4, "cat " * 300), (5, "x " * 16_382 + "cat cat cat dog"), (6, None)]
    got = ranks(spark, docs, [(1, "the cat or dogs"), (2, "cat cat")])
    n = lambda i, wanted: sum(min(256, len({min(at, 16_383) for at, w in enumerate(stems(dict(docs)[i] or ""), 1) if w == x})) for x in wanted)
    want = {(q, i): round(0.1 * n(i, wanted), 9) for q, wanted in ((1, ["cat", "dog", "or"]), (2, ["cat"])) for i, _ in docs if n(i, wanted)}
    assert got == want and got[2, 4] == 25.6 and got[1, 5] == 0.2


def test_covers_and_their_noise(spark):
    rows = spark.createDataFrame([(1, 7, w, p) for w, p in [("a", 1), ("b", 4), ("a", 6), ("a", 9), ("b", 10)]], "query_id long, id long, word string, place int")
    asked = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, word string")
    got = sorted((r.first, r.last, r.noise) for r in coverage.covers(rows, ["id"], asked).collect())
    assert got == [(1, 4, 2), (4, 6, 1), (9, 10, 0)]
    many = spark.createDataFrame([(1, f"w{i}") for i in range(65)], "query_id long, word string")
    with pytest.raises(ValueError, match="65 words"):
        coverage.covers(rows, ["id"], many)
    assert coverage.covers(rows, ["id"], asked.limit(0)).count() == 0


def test_all_places_of_a_word_count_if_asked_for(spark):
    docs = [(1, "cat " * 300 + "dog " + "cat dog " * 300)]
    words = stems(docs[0][1])
    assert ranks(spark, docs, [(1, "cat dog")], every=True, most_places=None) == {(1, 1): round(by_windows_of_two(words, "cat", "dog"), 9)}
    assert ranks(spark, docs, [(1, "cat dog")], every=True) != ranks(spark, docs, [(1, "cat dog")], every=True, most_places=None)


def by_windows_of_two(words, a, b):
    """Neighbours of different words, all of which were asked for: no noise."""
    return sum(0.1 for x, y in zip(words, words[1:]) if {x, y} == {a, b})
