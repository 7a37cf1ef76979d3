import random

import pytest

from marlstone.operators import headers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(title, window, at):
    found = [(distance(title, window[a:b]), abs(a - at), a, b) for a in range(len(window)) for b in range(a + 1, len(window) + 1)]
    e, _, a, b = min(found)
    return (a, b, e) if e <= headers.tolerance(title) else None


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé日🙂"])
def test_alignment_against_all_parts_of_the_window(letters):
    rng = random.Random(letters)
    hits = 0
    for _ in range(150):
        title = "".join(rng.choices(letters, k=rng.randint(1, 12)))
        damaged = list(title)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(damaged) + 1)
            damaged[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        window = "".join([*rng.choices(letters, k=rng.randint(0, 8)), *damaged, *rng.choices(letters, k=rng.randint(0, 8))])
        at = rng.randint(-3, 12)
        want = plain(title, window, at) if window else None
        assert headers.align(title, window, at) == want
        hits += want is not None
    assert hits > 50


def test_long_titles():
    title = "".join(random.Random(1).choices("abcdefgh", k=3000))
    damaged = title[:100] + title[110:2000] + "x" * 20 + title[2000:]
    assert headers.align(title, "zz" + damaged + "zz", 0) == (2, 2 + len(damaged), 30)
    assert headers.align(title, "z" * 3000, 0) is None


def test_proposals_of_texts(spark):
    text = "Introduktion\nsome words\n# Methods and Materials\nmore words"
    proposed = [("Introduction", 3), ("# Methods and Materials", 24), ("# Metods and Materals", 30), ("Results", 5), ("", 1), (None, 1), ("words", None), ("words", 4000), ("words", -9), ("words", 60)]
    schema = "id long, text string, proposed array<struct<title: string, start: long>>, title string, n int"
    docs = spark.createDataFrame([(1, text, proposed, "x", 1), (2, None, proposed[:1], None, None), (3, text, None, "y", 2), (None, text, proposed, "z", 3), (4, "", proposed[:1], "", 0), (5, text, [], "", 0)], schema)
    got = {(r.id, r.n): (r.title, r.start, r.errors, r.verified) for r in headers.verified(docs, "id", "text", "proposed").collect()}
    assert got[1, 0] == ("Introduktion", 0, 1, True) and got[1, 1] == (proposed[1][0], 24, 0, True) and got[1, 2] == (proposed[1][0], 24, 2, True)
    assert got[1, 3] == ("Results", 5, None, False) and got[1, 4] == ("", 1, None, False) and got[1, 5] == (None, 1, None, False)
    assert got[1, 6] == ("words", None, None, False) and got[1, 7] == ("words", 4000, None, False) and got[1, 9] == ("words", 53, 0, True)
    assert got[1, 8][3] in (True, False) and got[2, 0] == got[4, 0] == ("Introduction", 3, None, False)
    assert len(got) == 12 and headers.verified(docs.limit(0), "id", "text", "proposed").count() == 0


def test_copies_and_long_texts(spark):
    text = "ab cd " * 200_000 + "Final Remarks\n" + "ef " * 1000
    rows = [(i, text, [("Final Remorks", 1_200_000 + i)]) for i in range(5)]
    docs = spark.createDataFrame(rows, "id long, text string, p array<struct<title: string, start: int>>")
    assert sorted(tuple(r) for r in headers.verified(docs, "id", "text", "p").collect()) == [(i, 0, "Final Remarks", 1_200_000, 1, True) for i in range(5)]


def test_many_at_a_time_against_one_at_a_time():
    rng = random.Random(6)
    titles = ["".join(rng.choices("abc日🙂 ", k=rng.choice([1, 2, 9, 24, 62, 63]))) for _ in range(400)]
    windows = ["".join(rng.choices("abc", k=rng.randint(0, 9))) + "".join(c for c in t if rng.random() > 0.05) + "".join(rng.choices("abc", k=rng.randint(0, 20))) for t in titles]
    ats = [rng.randint(-5, 20) for _ in titles]
    want = [headers.align(*x) for x in zip(titles, windows, ats)]
    assert headers.align_many(titles, windows, ats) == want and 200 < sum(x is not None for x in want) < 400
    assert headers.align_many([], [], []) == [] and headers.align_many(["ab"], [""], [0]) == [None]


def test_texts_are_gone_through_once(spark):
    docs = spark.createDataFrame([(1, "abc", [("abd", 0)])], "id long, text string, p array<struct<title: string, start: int>>")
    assert headers.verified(docs, "id", "text", "p")._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
