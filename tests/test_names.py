import random

import pytest

from marlstone.operators import names, strategies


def grams(name):
    import re

    return {f"  {w} "[i : i + 3] for w in re.findall(r"[a-z0-9]+", (name or "").lower()) for i in range(len(w) + 1)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def people(rng, n):
    syllables = ["an", "ber", "to", "Mar", "li", "x9", "ra", "the", "É", "-"]
    return ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) + rng.choice(["", " Smith", " of the", " 7"]) for _ in range(n)]


@pytest.mark.parametrize(("least", "hot"), [(0.3, 5000), (0.3, 7), (0.7, 3), (1.0, 5000), (0.05, 20)])
def test_similar_names_against_all_pairs(spark, least, hot):
    rng = random.Random(int(least * 100) + hot)
    asked = [(i, x) for i, x in enumerate(people(rng, 40))] + [(90, None), (91, ""), (92, "--"), (93, "xyzzy")]
    known = [(i, x) for i, x in enumerate(people(rng, 150))] + [(900, None), (901, ""), (1, "Smith"), (1, "Smith")]
    got = [(r.asked.q, r.asked.name, r.known.id, r.known.name, round(r.similarity, 9)) for r in names.similar(spark.createDataFrame(asked, "q long, name string"), spark.createDataFrame(known, "id long, name string"), least, hot=hot).collect()]
    want = {(q, a, i, b, round(similarity(a, b), 9)) for q, a in asked for i, b in known if grams(a) and grams(b) and similarity(a, b) >= least - 1e-12}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_one_trigram_in_every_name_is_dealt_out(spark):
    """All names hold the grams of ``corp``; what is similar is found, and no task meets all of one gram."""
    known = spark.createDataFrame([(i, f"corp {'abcdefghij'[i % 10] * 3}{i}") for i in range(400)], "id long, name string")
    asked = spark.createDataFrame([(1, "corp"), (2, "corp aaa10")], "q long, name string")
    got = names.similar(asked, known, 0.3, hot=25)
    rows = [(r.asked.q, r.known.id) for r in got.collect()]
    want = [(q, i) for q, a in ((1, "corp"), (2, "corp aaa10")) for i in range(400) if similarity(a, f"corp {'abcdefghij'[i % 10] * 3}{i}") >= 0.3]
    assert sorted(rows) == sorted(want) and len({i for _, i in rows}) > 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("hot", [5000, 4])
def test_names_inside_names(spark, hot):
    rng = random.Random(7)
    asked = [(i, x) for i, x in enumerate(["a", "an", "Mar", "smith", "to", "tolongtobefound", "", None, " ", "é", "o_t", "%", "ANBER", *people(rng, 20)])]
    known = [(i, x) for i, x in enumerate([None, "", "a", "anto_t", "100%", *people(rng, 120)])]
    got = [(r.asked.q, r.known.id) for r in names.containing(spark.createDataFrame(asked, "q long, name string"), spark.createDataFrame(known, "id long, name string"), hot=hot).collect()]
    want = [(q, i) for q, a in asked for i, b in known if a and b and a.lower() in b.lower()]
    assert sorted(got) == sorted(want)


def test_seeds_by_name_have_no_cross_join(spark):
    entities = spark.createDataFrame([(1, "Ada Lovelace"), (2, "Adam"), (3, "Bob")], "entity_id long, name string")
    aliases = spark.createDataFrame([(3, "Robert Adam"), (3, None)], "entity_id long, name string")
    queries = spark.createDataFrame([(1, "adam"), (2, "ADA LOVELACE"), (3, None), (4, "nobody")], "query_id long, asked string")
    seeds = strategies.named_seeds(entities, aliases, queries)
    assert sorted(map(tuple, seeds.collect())) == [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0)]
    plan = seeds._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert names.similar(entities.limit(0), entities).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        names.similar(entities, entities, 0)


@pytest.mark.parametrize(("least", "few"), [(0.3, 0), (0.3, 2048), (0.05, 0), (0.05, 2048), (1.0, 2048)])
def test_few_asked_and_many_asked_find_the_same(spark, monkeypatch, least, few):
    monkeypatch.setattr(names, "KNOWN_BLOCK", 7)
    rng = random.Random(11)
    asked = [(i, x) for i, x in enumerate(people(rng, 50))] + [(90, None), (91, ""), (1, "Smith"), (1, "Smith")]
    known = [(i, x) for i, x in enumerate(people(rng, 130))] + [(900, None), (901, ""), (1, "Smith"), (1, "Smith")]
    got = [(r.asked.q, r.asked.name, r.known.id, r.known.name, r.similarity) for r in names.similar(spark.createDataFrame(asked, "q long, name string"), spark.createDataFrame(known, "id long, name string").repartition(3), least, hot=9, few=few).collect()]
    want = {(q, a, i, b, similarity(a, b)) for q, a in asked for i, b in known if similarity(a, b) >= least}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_a_few_asked_names_meet_no_pairs_as_rows(spark):
    """All names share common trigrams: none is posted, known names are not shuffled and nothing is joined."""
    known = spark.createDataFrame([(i, f"the and of number {i}") for i in range(200)], "id long, name string")
    found = names.similar(spark.createDataFrame([(1, "the and of number 7")], "q long, name string"), known, 0.9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan.lower()
    assert [(r.known.id, r.similarity) for r in found.collect()] == [(i, similarity("the and of number 7", f"the and of number {i}")) for i in [7]]


def test_asked_names_are_cut_into_blocks():
    sets = [["x"] * n for n in (5_000, 3_000, 200, 50_000, *[1] * 600)]
    blocks = [list(at) for at in names._asked_blocks(sets)]
    assert [i for at in blocks for i in at] == list(range(len(sets))) and blocks[:3] == [[0, 1], [2], [3]] and max(map(len, blocks)) == names.ASKED_BLOCK
    assert names._asked_blocks([]) == []
