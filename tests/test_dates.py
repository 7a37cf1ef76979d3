import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import dates

NOW = datetime(2024, 3, 31, 15, 30)  # a Sunday


def one(text, now=NOW):
    got = dates.meant(list(dates.find(text, now)))
    return got and (got[0].date(), got[1].date())


@pytest.mark.parametrize(
    ("text", "lo", "hi"),
    [
        ("what happened yesterday", "2024-03-30", "2024-03-30"), ("notes of Today, please", "2024-03-31", "2024-03-31"),
        ("last week", "2024-03-24", "2024-03-31"), ("over the last year", "2023-04-01", "2024-03-31"),
        ("three days ago", "2024-03-28", "2024-03-28"), ("2 weeks ago", "2024-03-11", "2024-03-17"), ("a month ago", "2024-02-01", "2024-02-29"),
        ("4 months ago", "2023-11-01", "2023-11-30"), ("one year ago", "2023-02-01", "2023-04-30"), ("in February 2023", "2023-02-01", "2023-02-28"),
        ("in 2022", "2022-01-01", "2022-12-31"), ("on March 5, 2021", "2021-03-05", "2021-03-05"), ("on 2024-02-29", "2024-02-29", "2024-02-29"),
        ("of April 2nd", "2023-04-02", "2023-04-02"), ("on March 30", "2024-03-30", "2024-03-30"), ("2/28/2023", "2023-02-28", "2023-02-28"), ("June 2020", "2020-06-01", "2020-06-30"),
        ("last monday", "2024-03-25", "2024-03-25"), ("last Sunday", "2024-03-24", "2024-03-24"), ("past 10 days", "2024-03-21", "2024-03-31"), ("this week", "2024-03-25", "2024-03-31"),
        ("in March or 2024-01-02, but not yesterday", "2024-03-30", "2024-03-30"), ("2024-01-02 or June 2020", "2024-01-02", "2024-01-02"), ("2 days ago or in 2020", "2024-03-29", "2024-03-29"),
    ],
)
def test_phrases(text, lo, hi):
    assert one(text) == (date.fromisoformat(lo), date.fromisoformat(hi))


@pytest.mark.parametrize("text", [None, "", "in March", "may I march", "2024-02-30", "2024-13-01", "on 2024-04-02", "9999 years ago", "who is Ada", "12024-01-01", "in 0000", "todays", "June 2030"])
def test_what_names_no_range(text):
    assert one(text) is None


@given(st.text(alphabet="0123456789 -/,adgoinlstwekymarch", max_size=60))
def test_any_text(text):
    for start, end, kind, lo, hi in dates.find(text, NOW):
        assert 0 <= start < end <= len(text) and kind in dates.KINDS and lo <= hi


def test_generated_phrases_with_places(spark):
    """Many phrases in one text, each in its place, against ranges worked out day by day."""
    rng = random.Random(3)
    rows = []
    for n in range(60):
        text, want = "", []
        for _ in range(rng.randrange(4)):
            text += rng.choice(["é word ", "and then, ", "😀 "])
            k, day = rng.randrange(1, 40), NOW.date() - timedelta(days=rng.randrange(900))
            phrase, lo, hi = rng.choice([(f"{k} days ago", NOW.date() - timedelta(days=k), None), (day.isoformat(), day, None), (f"{dates.MONTHS[day.month - 1].title()} {day.day}, {day.year}", day, None), (f"in {day.year}", date(day.year, 1, 1), date(day.year, 12, 31)), (f"past {k} weeks", NOW.date() - timedelta(days=7 * k), NOW.date())])
            want.append((len(text), len(text) + len(phrase), lo, hi or lo))
            text += phrase + rng.choice([" ", ", ", ". "])
        rows.append((n, text, want))
    df = spark.createDataFrame([(n, t, NOW) for n, t, _ in rows] + [(60, None, NOW), (61, "today", None)], "id long, text string, at timestamp_ntz")
    got = {r.id: r.p for r in df.select("id", dates.phrases(F.col("text"), F.col("at")).alias("p")).collect()}
    assert [[(p.start, p.end, p.lo.date(), p.hi.date()) for p in got[n]] for n, _, _ in rows] == [w for _, _, w in rows]
    assert got[60] == [] and got[61] == []
    r = {r.id: r.c for r in df.select("id", dates.constraint(F.col("text"), F.col("at")).alias("c")).collect()}
    assert r[60] is None and r[61] is None and all((r[n] is None) == (not w) for n, _, w in rows)
    assert all(c.hi.microsecond == 999_999 for c in r.values() if c)
