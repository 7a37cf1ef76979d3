"""Pairwise similarity and greedy diversification of bounded candidate pools."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAMBDA_UNITS, LAMBDA_NOTES, EPSILON, COSINE_SHARE = 0.9, 0.8, 0.01, 0.6


def pairwise(pool: DataFrame) -> DataFrame:
    """(query_id, a, b, va, vb) for a < b within each query's pool, which must be bounded beforehand."""
    one = pool.select("query_id", F.col("id").alias("a"), F.col("embedding").alias("va"))
    two = pool.select("query_id", F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return one.join(two, "query_id").where("a < b")


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similarity_matrix(vectors: list, sets: list) -> np.ndarray:
    """0.6 cosine + 0.4 Jaccard of entities; a part that is missing counts 0."""
    n = len(vectors)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            cos = 0.0
            if a is not None and b is not None and len(a) == len(b):
                size = float(np.linalg.norm(a) * np.linalg.norm(b))
                cos = float(np.dot(a, b)) / size if size else 0.0
            union = len(sets[i] | sets[j])
            out[i, j] = COSINE_SHARE * cos + (1 - COSINE_SHARE) * (len(sets[i] & sets[j]) / union if union else 0.0)
    return out


def greedy_units(similar: np.ndarray, dates: list, limit: int, weight: float = LAMBDA_UNITS) -> list[int]:
    """Rows come in order of relevance, which is (n - i) / n; the first is always kept. Each
    further one is found in one pass: a row takes the lead if its value is over the leader's by
    more than EPSILON, or within EPSILON of it and newer."""
    n = len(dates)
    picked, left = ([0], list(range(1, n))) if n else ([], [])
    while left and len(picked) < limit:
        lead, best = left[0], -np.inf
        for i in left:
            value = weight * (n - i) / n - (1 - weight) * max(0.0, *(similar[i, j] for j in picked))
            newer = dates[i] is not None and (dates[lead] is None or dates[i] > dates[lead])
            if value > best + EPSILON or abs(value - best) <= EPSILON and newer:
                lead, best = i, value
        picked.append(lead)
        left.remove(lead)
    return picked


def greedy_notes(similar: np.ndarray, scores: list[float], limit: int, weight: float = LAMBDA_NOTES) -> list[int]:
    """Scores are divided by their maximum; the first of equal values wins."""
    top = max(scores, default=0) or 1.0
    picked: list[int] = []
    left = list(range(len(scores)))
    while left and len(picked) < limit:
        best = max(left, key=lambda i: (weight * scores[i] / top - (1 - weight) * max((similar[i, j] for j in picked), default=0.0), -i))
        picked.append(best)
        left.remove(best)
    return picked


def _apply(pool: DataFrame, choose) -> DataFrame:
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = choose(pdf)
        return pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "place": np.arange(1, len(rows) + 1)})

    return pool.groupBy("query_id").applyInPandas(pick, "query_id long, id long, place long")


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return similarity_matrix([None if v is None else np.asarray(v, float) for v in pdf["embedding"]], [set(s) for s in pdf["entities"]])


def mmr_units(pool: DataFrame, limit: int, weight: float = LAMBDA_UNITS) -> DataFrame:
    """(query_id, id, place) of a pool (query_id, id, score as distance, embedding, entities, event_date)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ignore_index=True)
        dates = [None if pd.isna(t) else t.value for t in pd.to_datetime(pdf["event_date"])]
        return pdf.iloc[greedy_units(_matrix(pdf), dates, limit, weight)]

    return _apply(pool, choose)


def mmr_notes(pool: DataFrame, limit: int, weight: float = LAMBDA_NOTES) -> DataFrame:
    """Like ``mmr_units`` over scores where more is better."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        return pdf.iloc[greedy_notes(_matrix(pdf), pdf["score"].tolist(), limit, weight)]

    return _apply(pool, choose)
