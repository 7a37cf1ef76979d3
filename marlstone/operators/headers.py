"""Proposed headers against the text they stand in: approximate alignment near the place that was proposed.

Texts stay on the JVM side, where they are gone through once: what is proposed for a text is cut out as windows there, and of these only
those that don't hold their title in its place go to Python. Edit distances are found there for a whole title at a time (bit-parallel), and for titles
of up to ``WORD`` characters for many windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK, LEAST_ERRORS, SHARE = 20, 2, 10
#: Titles that fit a machine word, and so many windows at a time.
WORD, ROWS = 63, 2_000


def tolerance(title: str) -> int:
    """Edits that a title may have: a tenth of its length, at least two, but never all of it."""
    return min(max(LEAST_ERRORS, len(title) // SHARE), len(title) - 1)


def _errors(title: str, text: str, anchored: bool) -> list[int]:
    """Edit distance of the title and the best part of the text that ends behind each character; ``anchored``: that begins at the text's start.

    The columns of the distance table are held as two bit vectors of steps up and down."""
    places: dict[str, int] = {}
    for i, c in enumerate(title):
        places[c] = places.get(c, 0) | 1 << i
    mask, top = (1 << len(title)) - 1, 1 << len(title) - 1
    up, down, score, out = mask, 0, len(title), []
    for c in text:
        same = places.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (~(level | up) & mask), up & level
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | anchored) & mask, fall << 1 & mask
        kept = same | down
        up, down = fall | (~(kept | rise) & mask), rise & kept
        out.append(score)
    return out


def align(title: str, window: str, at: int) -> tuple[int, int, int] | None:
    """(start, end, errors) of the part of the window that is nearest to the title within its tolerance: fewest errors, then nearest to ``at``, then first, then shortest."""
    if not title or not window:
        return None
    ends = _errors(title, window, False)
    fewest = min(ends)
    if fewest > tolerance(title):
        return None
    best = None
    for end in (i + 1 for i, e in enumerate(ends) if e == fewest):
        back = _errors(title[::-1], window[max(0, end - len(title) - fewest) : end][::-1], True)
        for start in (end - 1 - j for j, e in enumerate(back) if e == fewest):
            found = (abs(start - at), start, end)
            best = found if best is None else min(best, found)
    return best[1], best[2], fewest


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row a text; lengths)."""
    return np.array(texts, dtype=str).view(np.uint32).reshape(len(texts), -1), np.array([len(t) for t in texts])


def _many_errors(titles: np.ndarray, sizes: np.ndarray, windows: np.ndarray, anchored: bool) -> np.ndarray:
    """``_errors`` of many titles of at most WORD characters, each with the window of its row."""
    one = np.uint64(1)
    same = np.zeros(windows.shape, np.uint64)
    for i in range(titles.shape[1]):
        same |= (titles[:, i : i + 1] == windows).astype(np.uint64) << np.uint64(i)
    mask, top = (one << sizes.astype(np.uint64)) - one, one << (sizes - 1).astype(np.uint64)
    same &= mask[:, None]
    up, down, score, out = mask.copy(), np.zeros(len(sizes), np.uint64), sizes.copy(), np.zeros(windows.shape, int)
    for j in range(windows.shape[1]):
        here = np.ascontiguousarray(same[:, j])
        level = (((here & up) + up) ^ up) | here
        rise, fall = down | (~(level | up) & mask), up & level
        score += ((rise & top) != 0).astype(int) - ((fall & top) != 0)
        rise, fall = (rise << one | np.uint64(anchored)) & mask, fall << one & mask
        kept = here | down
        up, down = fall | (~(kept | rise) & mask), rise & kept
        out[:, j] = score
    return out


def align_many(titles: list[str], windows: list[str], ats: list[int]) -> list[tuple[int, int, int] | None]:
    """``align`` of each title, of one to WORD characters, with its window."""
    out: list[tuple[int, int, int] | None] = [None] * len(titles)
    if not titles:
        return out
    (t, m), (w, size) = _characters(titles), _characters(windows)
    at, far = np.array(ats), 1 << 30
    ends = np.where(np.arange(w.shape[1]) < size[:, None], _many_errors(t, m, w, False), far)
    fewest = ends.min(1)
    row, last = np.nonzero((ends == fewest[:, None]) & (fewest <= np.array([tolerance(x) for x in titles]))[:, None])
    if not len(row):
        return out
    m, few = m[row], fewest[row]
    length = np.minimum(last + 1, m + few)
    back = np.arange(length.max())
    turned = np.take_along_axis(t[row], np.maximum(m[:, None] - 1 - np.arange(t.shape[1]), 0), 1)
    before = np.take_along_axis(w[row], np.maximum(last[:, None] - back, 0), 1)
    pair, j = np.nonzero((_many_errors(turned, m, before, True) == few[:, None]) & (back < length[:, None]))
    start, end, row = last[pair] - j, last[pair] + 1, row[pair]
    order = np.lexsort((end, start, np.abs(start - at[row]), row))
    first = order[np.unique(row[order], return_index=True)[1]]
    for i in first:
        out[row[i]] = int(start[i]), int(end[i]), int(fewest[row[i]])
    return out


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            pdf = whole.iloc[at : at + ROWS].reset_index(drop=True)
            titles, starts, errors, verified = pdf["title"].tolist(), pdf["start"].tolist(), [0 if x else None for x in pdf["exact"]], pdf["exact"].tolist()
            los, windows = pdf["lo"].tolist(), pdf["window"].tolist()
            asked = [i for i in np.flatnonzero(pdf["window"].notna()) if windows[i]]
            short = [i for i in asked if len(titles[i]) <= WORD]
            found = dict(zip(short, align_many([titles[i] for i in short], [windows[i] for i in short], [int(starts[i] - los[i]) for i in short])))
            found |= {i: align(titles[i], windows[i], int(starts[i] - los[i])) for i in asked if len(titles[i]) > WORD}
            for i, hit in found.items():
                if hit is not None:
                    titles[i], starts[i], errors[i], verified[i] = windows[i][hit[0] : hit[1]], los[i] + hit[0], hit[2], True
            starts, errors = ([None if x is None or x != x else int(x) for x in numbers] for numbers in (starts, errors))
            yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "title": titles, "start": pd.array(starts, "Int64"), "errors": pd.array(errors, "Int64"), "verified": np.array(verified, bool)})


def verified(docs: DataFrame, id_col: str, text_col: str, proposed_col: str) -> DataFrame:
    """(id, n, title, start, errors, verified): the n-th proposed header of each text, with its title and place as the text has them.

    Proposed are arrays of (title, start), places in characters from 0. A title is looked for within 20 characters of its place; with more than a tenth
    of its characters wrong (two in short ones) it is not verified, and stays as proposed, errors null. Headers with a null or empty title or without
    a place are not verified either; rows with a null id, a null array or an empty one have none. A place outside of the text is allowed.
    """
    t, p = F.coalesce(F.col(text_col), F.lit("")), F.col(proposed_col)

    def window(x, n):
        lo = F.greatest(x["start"] - SLACK, F.lit(0))
        size = F.greatest(F.least(x["start"], F.length(t)) + F.length(x["title"]) + SLACK - lo, F.lit(0))
        there = F.substring(t, (F.greatest(x["start"], F.lit(0)) + 1).cast("int"), F.length(x["title"])) == x["title"]
        return F.struct(n.cast("long").alias("n"), x["title"].alias("title"), x["start"].cast("long").alias("start"), lo.cast("long").alias("lo"),
                        F.substring(t, (lo + 1).cast("int"), size.cast("int")).alias("window"), (there & (x["start"] >= 0)).alias("there"))

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.inline(F.transform(p, window)))
    known = F.coalesce(F.length("title") > 0, F.lit(False)) & F.col("start").isNotNull()
    exact = F.coalesce("there", F.lit(False)) & known
    asked = rows.select("id", "n", "title", "start", "lo", F.when(known & ~exact, F.col("window")).alias("window"), exact.alias("exact"))
    return asked.mapInPandas(_aligned, "id long, n long, title string, start long, errors long, verified boolean")
