"""Dates in free English text: every phrase with its place and range, and the one that a question means.

Phrases are found by one pattern with a rule for each kind. A question's range is that of the first phrase of the kind that
comes first in ``KINDS``; kinds from ``day`` on are equals, and the first in the text counts. A bare month
says nothing, days without a year are the last such day, and a day more than one ahead is refused.
All ranges are whole days, from the first moment of one to the last microsecond of another.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import date, datetime, time, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Names of months, weekdays and small numbers.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = {"a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

_MONTH, _COUNT = "|".join(MONTHS), rf"\d{{1,4}}|{'|'.join(NUMBERS)}"
_GRAMMAR = {
    "yesterday": r"yesterday",
    "today": r"today|tonight",
    "last": r"last\s+(?P<last>week|month|year)",
    "ago": rf"(?P<n>{_COUNT})\s+(?P<unit>day|week|month|year)s?\s+ago",
    "month": rf"in\s+(?P<month>{_MONTH})(?:\s+(?P<month_year>\d{{4}}))?(?!\s+\d{{1,2}}\b)",
    "year": r"in\s+(?P<year>\d{4})",
    "day": rf"(?:(?P<md>{_MONTH})\s+(?P<dm>\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,?\s*(?P<dy>\d{{4}}))?|(?P<iy>\d{{4}})[/-](?P<im>\d{{1,2}})[/-](?P<id>\d{{1,2}})|(?P<um>\d{{1,2}})[/-](?P<ud>\d{{1,2}})[/-](?P<uy>\d{{4}}))(?!\d)",
    "whole_month": rf"(?P<wm>{_MONTH})\s+(?P<wy>\d{{4}})",
    "weekday": rf"last\s+(?P<weekday>{'|'.join(WEEKDAYS)})",
    "past": rf"past\s+(?P<pn>{_COUNT})?\s*(?P<punit>day|week|month|year)s?",
    "this": r"this\s+(?P<this>week|month|year)",
}
KINDS = tuple(_GRAMMAR)
_ORDERED = KINDS.index("day")
_PHRASE = re.compile(r"\b(?:" + "|".join(f"(?P<{k}_>{p})" for k, p in _GRAMMAR.items()) + r")\b", re.I)
_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
SCHEMA = "array<struct<start: int, end: int, kind: string, lo: timestamp_ntz, hi: timestamp_ntz>>"


def _month(year: int, month: int) -> tuple[date, date]:
    """Of a month that may be beyond its year."""
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _range(kind: str, m: re.Match, today: date) -> tuple[date, date] | None:
    g = {k: v.lower() for k, v in m.groupdict().items() if v}
    count = lambda name: NUMBERS.get(g[name]) or int(g[name])
    if kind in ("yesterday", "today"):
        at = today - timedelta(days=kind == "yesterday")
        return at, at
    if kind == "last":
        return today - timedelta(days=_DAYS[g["last"]]), today
    if kind == "ago":
        n = count("n")
        if g["unit"] == "day":
            return today - timedelta(days=n), today - timedelta(days=n)
        if g["unit"] == "week":
            return today - timedelta(days=7 * n + 6), today - timedelta(days=7 * n)
        if g["unit"] == "month":
            return _month(today.year, today.month - n)
        return _month(today.year - n, today.month - 1)[0], _month(today.year - n, today.month + 1)[1]
    if kind == "month":
        return _month(int(g["month_year"]), MONTHS.index(g["month"]) + 1) if "month_year" in g else None
    if kind == "year":
        return date(int(g["year"]), 1, 1), date(int(g["year"]), 12, 31)
    if kind == "whole_month":
        lo, hi = _month(int(g["wy"]), MONTHS.index(g["wm"]) + 1)
    elif kind == "weekday":
        lo = hi = today - timedelta(days=(today.weekday() - WEEKDAYS.index(g["weekday"]) - 1) % 7 + 1)
    elif kind == "past":
        lo, hi = today - timedelta(days=_DAYS[g["punit"]] * (count("pn") if "pn" in g else 1)), today
    elif kind == "this":
        lo, hi = today - timedelta(days={"week": today.weekday(), "month": today.day - 1, "year": today.timetuple().tm_yday - 1}[g["this"]]), today
    else:
        if "md" in g:
            month, day, year = MONTHS.index(g["md"]) + 1, int(g["dm"]), int(g["dy"]) if "dy" in g else today.year
            if "dy" not in g and (month, day) > (today.month, today.day):
                year -= 1
        else:
            year, month, day = (int(g[k]) for k in (("iy", "im", "id") if "iy" in g else ("uy", "um", "ud")))
        lo = hi = date(year, month, day)
    return None if lo > today + timedelta(days=1) else (lo, hi)


def find(text: str | None, now: datetime) -> Iterator[tuple[int, int, str, datetime, datetime]]:
    """(start, end, kind, lo, hi) of each phrase that names a range."""
    for m in _PHRASE.finditer(text or ""):
        kind = next(k for k in KINDS if m[f"{k}_"])
        try:
            found = _range(kind, m, now.date())
        except (ValueError, OverflowError):  # no such day
            found = None
        if found:
            yield m.start(), m.end(), kind, datetime.combine(found[0], time.min), datetime.combine(found[1], time.max)


def meant(found: list[tuple[int, int, str, datetime, datetime]]) -> tuple[datetime, datetime] | None:
    if not found:
        return None
    return min(found, key=lambda f: (min(KINDS.index(f[2]), _ORDERED), f[0]))[3:]


def phrases(text: Column, now: Column) -> Column:
    """Array of (start, end, kind, lo, hi), places in code points; ``now`` is a timestamp."""

    @pandas_udf(SCHEMA)
    def run(texts: pd.Series, nows: pd.Series) -> pd.Series:
        return pd.Series([[] if pd.isna(n) else [dict(zip(("start", "end", "kind", "lo", "hi"), f)) for f in find(t, n.to_pydatetime())] for t, n in zip(texts, nows)])

    return run(text, now.cast("timestamp_ntz"))


def constraint(text: Column, now: Column) -> Column:
    """struct(lo, hi) of the range that a text means, or null."""

    @pandas_udf("struct<lo: timestamp_ntz, hi: timestamp_ntz>")
    def run(texts: pd.Series, nows: pd.Series) -> pd.DataFrame:
        found = [None if pd.isna(n) else meant(list(find(t, n.to_pydatetime()))) for t, n in zip(texts, nows)]
        return pd.DataFrame({"lo": pd.Series([f[0] if f else pd.NaT for f in found], dtype="datetime64[us]"), "hi": pd.Series([f[1] if f else pd.NaT for f in found], dtype="datetime64[us]")})

    found = run(text, now.cast("timestamp_ntz"))
    return F.when(found["lo"].isNotNull(), found)
