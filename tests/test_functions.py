from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import scoring, text, vector
from marlstone.operators import filters, strategies


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


def test_vectors(spark):
    a, b, zero = arr(1.0, 0.0), arr(1.0, 1.0), arr(0.0, 0.0)
    r = one(spark, vector.cosine(a, b), vector.cosine(a, zero), vector.cosine(a, arr(float("nan"), 1.0)), vector.l2_distance(a, b), vector.cosine(F.lit(None).cast("array<double>"), a))
    assert abs(r.c0 - 2**-0.5) < 1e-12 and r.c1 is None and r.c2 is None and r.c3 == 1.0 and r.c4 is None


@pytest.mark.parametrize(("name", "normal"), [("The Bank of the", "bank"), ("Émile  Zola!", "mile zola"), ("A", ""), ("of and the", ""), ("Jean-Luc", "jean-luc"), ("then", "then")])
def test_normal_name(spark, name, normal):
    assert one(spark, text.normal_name(F.lit(name))).c0 == normal


def test_trigram_similarity(spark):
    a, b = text.trigrams(F.lit("word")), text.trigrams(F.lit("two words"))
    r = one(spark, text.trigram_similarity(a, b), text.trigram_similarity(a, a), text.trigram_similarity(text.trigrams(F.lit("")), text.trigrams(F.lit(""))))
    assert abs(r.c0 - 4 / 11) < 1e-9 and r.c1 == 1.0 and r.c2 == 0.0


def test_decay_clamps_and_futures(spark):
    r = one(spark, scoring.decay(F.lit(1e9)), scoring.decay(F.lit(-30.0)), scoring.half_life(F.lit(-30.0), 30.0), scoring.half_life(F.lit(30.0), 30.0), scoring.recency(F.lit(None).cast("double")), scoring.recency(F.lit(4000.0)))
    assert r.c0 > 0 and r.c1 == 2.0 and r.c2 == 1.0 and r.c3 == 0.5 and r.c4 == 0.5 and r.c5 == 0.1


NOW = datetime(2024, 3, 15, 12)


def test_filters(spark):
    t = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    null = F.lit(None).cast("timestamp_ntz")
    r = one(spark, filters.valid_at(null, null, t), filters.valid_at(t, t, t), filters.valid_at(t, null, t), filters.date_between(t, datetime(2024, 1, 10), datetime(2024, 1, 10)), filters.has_all_tags(F.lit(None).cast("array<string>"), ["a"]), filters.key_pattern(F.lit("ab"), "a*"), filters.key_pattern(F.lit("ab"), "a"))
    assert [r.c0, r.c1, r.c2, r.c3, r.c4, r.c5, r.c6] == [True, False, True, True, False, True, False]
    with pytest.raises(ValueError):
        filters.note_date("other")


def test_strategy_choice():
    assert strategies.select_strategies(None) == list(strategies.UNIT_STRATEGIES)
    assert strategies.select_strategies(["keyword", "semantic", "keyword"]) == ["keyword", "semantic"]
    for bad in ([], ["other"]):
        with pytest.raises(ValueError):
            strategies.select_strategies(bad)
    with pytest.raises(ValueError):
        strategies.graph_strategy("other")


def test_names(spark):
    for name, good in [("Report 2024", True), ("untitled-1", False), ("tmp_x", False), ("12345678-1234-1234-1234-123456789abc", False), (None, False), ("", False), ("Temperature", True)]:
        assert one(spark, text.meaningful_name(F.lit(name).cast("string"))).c0 is good
    r = one(spark, text.strip_namespace(F.lit("kv://user:1:x")), text.valid_namespace(F.lit("user:1:x")), text.valid_namespace(F.lit("other:x")))
    assert (r.c0, r.c1, r.c2) == ("user:1:x", True, False)


