"""Score expressions: decay, boosts, link strengths, priorities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, DECAY_FLOOR = 60, -996.0


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 86_400e6


def decay(age_days: Column, days: float = 30.0, base: float = 2.0) -> Column:
    """base ^ (-age / days), the exponent clamped so that it never underflows; dates in the future score over 1."""
    return F.pow(F.lit(base), F.greatest(-age_days / days, F.lit(DECAY_FLOOR)))


def half_life(age_days: Column, days: float) -> Column:
    """Like ``decay`` with base 2, but 1.0 for the future."""
    return F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(2.0), F.greatest(-age_days / days, F.lit(DECAY_FLOOR))))


def link_strength(count: Column, mentions: Column) -> Column:
    return F.log(count + 1.0) / F.log(mentions + 2.0)


def entity_overlap(n: Column) -> Column:
    return F.tanh(n * 0.5)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def recency(age_days: Column) -> Column:
    """1 now, falling to 0.1 over a year; 0.5 for a null date."""
    return F.when(age_days.isNull(), 0.5).otherwise(F.least(F.greatest(1.0 - age_days / 365.0, F.lit(0.1)), F.lit(1.0)))


def boosted(raw: Column, recency_value: Column, proximity: Column, alpha: float = 0.2) -> Column:
    return sigmoid(raw) * (1.0 + alpha * (recency_value - 0.5)) * (1.0 + alpha * (F.coalesce(proximity, F.lit(0.5)) - 0.5))


def rarity(mentions: Column) -> Column:
    return 1.0 / (1.0 + F.log1p(mentions))


def neighbour_weight(frequency: Column) -> Column:
    return 1.0 / F.log2(2.0 + frequency)


def priority(evidence: Column, mentions: Column, retrievals: Column) -> Column:
    one = F.lit(1.0)
    return F.round(0.5 * evidence + 0.2 * F.log10(F.greatest(mentions, one)) + 0.3 * F.log10(F.greatest(retrievals, one)), 4)


def priority_of(evidence: int, mentions: int, retrievals: int) -> float:
    """``priority`` of one item, for keyed state."""
    return round(0.5 * evidence + 0.2 * math.log10(max(mentions, 1)) + 0.3 * math.log10(max(retrievals, 1)), 4)


def mention_score(mentions: Column, retrievals: Column, centrality: Column) -> Column:
    return 0.4 * mentions + 0.4 * retrievals + 0.2 * centrality
