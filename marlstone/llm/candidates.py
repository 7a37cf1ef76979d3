"""Candidate components of the n-gram join: a prefix filter with common n-grams last.

The prefix filter holds for any order that all sets share. Hash order is free, but
a passage that a third of all texts share would bring these together pairwise. So
n-grams of more than ``block`` sets go to the end of the order: found by a count of
the sets' first n-grams, and then of all n-grams of the sets that these leave too few
to fill a prefix. The list is bounded (``MAX_COMMON``, the commonest there are); what
it lacks costs time, never links.

Sets that nearly consist of common n-grams meet at these all the same. They are
first parted by ranges of size, each set in its own range and the next, for linked
sets are never further apart. Groups of more than ``block`` are then cut into blocks
that meet in themselves; of each part found, ``SAMPLE`` sets meet across blocks, and
in groups that still fall into parts of more sets than that the blocks of the smaller
parts meet those of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, fanout_join, materialise, trimmed
from marlstone.llm.components import UnionFind, components
from marlstone.llm.ngram_sets import BASE_WORDS, folded, most_differences, prefix, sets_of
from marlstone.operators.filters import top_per_group

SAMPLE = 8
#: Most n-grams that are moved to the end of the order at once: 8 MB in each task.
MAX_COMMON = 1 << 20
#: N-grams that a task counts before it gives counts out.
COUNTED = 1 << 20


# ---------------------------------------------------------------- meetings


def _forest_pairs(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (i, j) of row numbers."""
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    found, keep = UnionFind(len(nodes)), []
    for k, (a, b) in enumerate(zip(ends[: len(i)].tolist(), ends[len(i) :].tolist())):
        if found.union(a, b):
            keep.append(k)
    return rep[i[keep]], rep[j[keep]]


class Bitmaps:
    """Bitmaps of unequal lengths: compared folded to the base length first, then, where
    both are longer, folded to the shorter of the two."""

    def __init__(self, bits) -> None:
        self.whole = [np.asarray(b, np.int64).view(np.uint64) for b in bits]
        self.base = np.stack([folded(b, BASE_WORDS) for b in self.whole])
        self.words = np.array([len(b) for b in self.whole])

    def take(self, rows: np.ndarray) -> Bitmaps:
        out = object.__new__(Bitmaps)
        out.whole, out.base, out.words = [self.whole[i] for i in rows], self.base[rows], self.words[rows]
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(self.base[i] ^ self.base[j]).sum(1, dtype=np.int64) <= most
        for k in np.flatnonzero(ok & (np.minimum(self.words[i], self.words[j]) > BASE_WORDS)):
            a, b = self.whole[i[k]], self.whole[j[k]]
            words = min(len(a), len(b))
            ok[k] = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum() <= most[k]
        return ok


def _meet(rep: np.ndarray, n: np.ndarray, bits: Bitmaps, side: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate forest of one meeting, of pairs of unlike label. side: 0 and 1 in a pair
    of blocks (only pairs across count), all 0 otherwise."""
    order = np.argsort(n, kind="stable")
    rep, n, bits, side, label = rep[order], n[order], bits.take(order), side[order], label[order]
    two = side.any()
    # Row k meets the rows before it that are long enough.
    first = np.searchsorted(100 * n, percent * n, side="left")
    left, right = [], []
    for at in range(0, len(n), 256):
        stop = min(len(n), at + 256)
        low = int(first[at])
        i, j = np.meshgrid(np.arange(low, stop), np.arange(at, stop), indexing="xy")
        fit = (i < j) & (i >= first[at:stop, None]) & (label[i] != label[j])
        if two:
            fit &= side[i] != side[j]
        i, j = i[fit], j[fit]
        for part in range(0, len(i), 1 << 18):
            a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            ok = bits.may_link(a, b, most_differences(n[a], n[b], percent))
            left.append(a[ok])
            right.append(b[ok])
    i, j = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
    return _forest_pairs(rep, i, j) if len(i) else (rep[:0], rep[:0])


def _meetings(percent: int):
    """Forests of meetings; rows come sorted by (gram, pair), a meeting after the other."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        gram, pair, rep, n, side, label = (rows[c].to_numpy() for c in ("gram", "pair", "rep", "n", "side", "label"))
        bits = Bitmaps(rows["bits"])
        edge = np.flatnonzero((np.diff(gram) != 0) | (np.diff(pair) != 0)) + 1
        starts = np.r_[0, edge]
        sizes = np.diff(np.r_[starts, len(gram)])
        out = []
        small = sizes <= 8
        two = np.repeat(np.add.reduceat(side, starts) > 0, sizes)
        for offset in range(1, 8):  # small meetings all at once
            at = np.concatenate([starts[small & (sizes > offset + k)] + k for k in range(8 - offset)])
            i, j = at, at + offset
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fit = (100 * low >= percent * high) & (~two[i] | (side[i] != side[j])) & (label[i] != label[j])
            i, j, low, high = i[fit], j[fit], low[fit], high[fit]
            ok = bits.may_link(i, j, most_differences(low, high, percent))
            out.append((rep[i[ok]], rep[j[ok]]))
        for s, m in zip(starts[~small].tolist(), sizes[~small].tolist()):
            out.append(_meet(rep[s : s + m], n[s : s + m], bits.take(np.arange(s, s + m)), side[s : s + m], label[s : s + m], percent))
        return pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]):
        for rows in whole_groups(batches, ["gram", "pair"]):
            yield work(rows)

    return run


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that no group of equal keys is divided."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iat[-1]).to_numpy()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = [pdf.iloc[cut:]]
        else:
            if held and any(held[-1][k].iat[-1] != pdf[k].iat[0] for k in keys):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def blocks_of(rows: DataFrame, count: str, block: int, id_col: str) -> DataFrame:
    """Adds pair and side: which meetings of two blocks a row takes part in (one, numbered 0, for small groups)."""
    nb = F.ceil(F.col(count) / block).cast("int")
    mine = F.pmod(F.xxhash64(id_col), nb).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), nb - 1), lambda o: F.struct((F.least(mine, o) * nb + F.greatest(mine, o) + 1).alias("pair"), (mine > o).cast("int").alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))
    return rows.select("*", F.inline(F.when(nb <= 1, alone).otherwise(pairs)))


def blocks_between_parts(rows: DataFrame, group: str, block: int) -> DataFrame:
    """pair and side, as above, for groups of labelled rows (rep, label): the largest part meets the
    others and these meet each other, but the largest does not meet itself. Groups of one part are left out."""
    sizes = rows.groupBy(group, "label").agg(F.count("*").alias("sets"))
    parts = sizes.groupBy(group).agg(F.sum("sets").alias("all"), F.max(F.struct("sets", "label")).alias("top")).where(F.col("all") > F.col("top.sets"))
    several = F.ceil((F.col("all") - F.col("top.sets")) / block).cast("int")
    largest = F.ceil(F.col("top.sets") / block).cast("int")
    parts = parts.select(group, several.alias("_several"), largest.alias("_largest"), F.col("top.label").alias("_top"))
    met = fanout_join(rows, parts, group, F.col("rep"), "inner")
    top, n, k = F.col("label") == F.col("_top"), F.col("_several"), F.col("_largest")
    mine = F.pmod(F.xxhash64("rep"), F.when(top, k).otherwise(n)).cast("int")

    def meetings(count, pair, side):
        return F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.struct(pair(o).alias("pair"), side(o).alias("side")))

    with_top = meetings(k, lambda o: mine * k + o, lambda o: F.lit(0))
    with_others = meetings(n, lambda o: -1 - (F.least(mine, o) * n + F.greatest(mine, o)), lambda o: (mine > o).cast("int"))
    of_top = meetings(n, lambda o: o * k + mine, lambda o: F.lit(1))
    return met.select(*rows.columns, F.inline(F.when(top, of_top).otherwise(F.concat(with_top, with_others))))


# ---------------------------------------------------------------- order


def common_grams(df: DataFrame, block: int, known: np.ndarray) -> np.ndarray:
    """The n-grams of a table (gram, df) that are in more than ``block`` sets, sorted, ``known`` ones
    included: at most ``MAX_COMMON`` new ones, those above the least power of two that leaves no more."""
    df = materialise(df.where(F.col("df") > block), "common-grams")
    level = F.floor(F.log2("df")).cast("int").alias("level")
    found, least = 0, None
    for row in df.groupBy(level).agg(F.count("*").alias("grams")).orderBy(F.desc("level")).collect():  # a row a power of two
        found += row["grams"]
        if found > MAX_COMMON:
            break
        least = row["level"]
    if least is None:
        return known
    new = df.where(level >= least).select("gram").toPandas()
    return np.union1d(known, new["gram"].to_numpy(np.int64).view(np.uint64))


def _ordered(percent: int, held, whole: bool):
    """Prefixes in the common order from the first n-grams, or from whole sets; rest: these were too few to tell."""

    def run(batches: Iterator[pd.DataFrame]):
        common = held.value
        for pdf in batches:
            rare, last = [], []
            for first, n in zip(pdf["first"], pdf["n"]):
                first = np.frombuffer(first, np.uint64) if whole else np.asarray(first, np.int64).view(np.uint64)
                a, b = prefix(first, len(first) if whole else n, percent, common) or (None, None)
                rare.append(None if a is None else a.view(np.int64).tolist())
                last.append(None if b is None else b.view(np.int64).tolist())
            yield pd.DataFrame({"rep": pdf["rep"], "n": pdf["n"], "rare": rare, "common": last})

    return trimmed(run)


def ordered_prefixes(docs: DataFrame, classes: DataFrame, n: int, percent: int, block: int) -> tuple[DataFrame, bool]:
    """(rep, n, rare, common): each class's prefix, parted into its two kinds; and whether there are common n-grams."""
    context, schema = docs.sparkSession.sparkContext, "rep long, n long, rare array<long>, common array<long>"

    def arrange(rows: DataFrame, common: np.ndarray, whole: bool = False) -> DataFrame:
        return rows.mapInPandas(_ordered(percent, context.broadcast(common), whole), schema)

    rows = classes.select("rep", "n", "first")
    counts = rows.select(F.explode("first").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    common = common_grams(counts, block, np.zeros(0, np.uint64))
    if not len(common):
        return arrange(rows, common), False
    short = materialise(arrange(rows, common).where("rare IS NULL").select("rep", "n"), "short-prefixes")
    sets = materialise(sets_of(docs, short, n), "short-sets")
    if not short.isEmpty():
        counted = sets.select("grams").mapInPandas(trimmed(_counted), "gram long, df long")
        common = common_grams(counted.groupBy("gram").agg(F.sum("df").alias("df")), block, common)
    made = arrange(rows, common)
    rest = made.where("rare IS NULL").select("rep", "n")
    more = materialise(rest.join(short.select("rep"), "rep", "left_anti"), "more-short-prefixes")
    whole = sets.join(rest.select("rep"), "rep", "left_semi").unionByName(sets_of(docs, more, n))
    whole = arrange(whole.withColumnRenamed("grams", "first"), common, True)
    out = materialise(made.where("rare IS NOT NULL").unionByName(whole), "ngram-prefixes")
    discard(sets)
    return out, True


def _counted(batches: Iterator[pd.DataFrame]):
    """Counts of the n-grams of a partition's sets, given out whenever there are many: sets that are alike are few n-grams."""
    held, size = [], 0

    def out():
        gram, place = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return gram, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

    for pdf in batches:
        grams = np.frombuffer(b"".join(pdf["grams"]), np.int64)
        held.append((grams, np.ones(len(grams), np.int64)))
        size += len(grams)
        if size >= COUNTED:
            held = [out()]
            size = len(held[0][0])
            if size >= COUNTED // 2:
                yield pd.DataFrame({"gram": held[0][0], "df": held[0][1]})
                held, size = [], 0
    if held:
        gram, n = out()
        yield pd.DataFrame({"gram": gram, "df": n})


# ---------------------------------------------------------------- candidates


def candidate_components(docs: DataFrame, classes: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(id, component) of candidates: every link lies inside a component. docs: (id, text); classes: (rep, n, first, bits)."""

    def meet(rows: DataFrame) -> DataFrame:
        met = rows.join(classes.select("rep", "n", "bits"), "rep").repartition("gram", "pair").sortWithinPartitions("gram", "pair")
        return met.select("gram", "pair", "side", "rep", "label", "n", "bits").mapInPandas(trimmed(_meetings(percent)), "a long, b long")

    prefixes, some = ordered_prefixes(docs, classes, n, percent, block)
    rare = prefixes.select("rep", F.explode("rare").alias("gram"))
    counts = rare.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    edges = meet(blocks_of(rare.join(counts, "gram"), "df", 2 * block, "rep").withColumn("label", F.col("rep")))
    if some:
        edges = common_edges(prefixes.select("rep", "n", F.explode("common").alias("gram")), edges, meet, percent, block)
    groups = materialise(components(edges), "ngram-groups")
    if some:
        discard(prefixes)
    return groups


def common_edges(rows: DataFrame, edges: DataFrame, meet, percent: int, block: int) -> DataFrame:
    """``edges`` and those between sets that meet at common n-grams; rows: (rep, n, gram)."""
    step = math.log(100 / percent) * 1.0001  # a little wide: rounding must not part linked sets by two ranges
    at = F.floor(F.log("n") / step)
    keyed = rows.select("rep", "gram", F.explode(F.array(at, at + 1)).alias("range")).select("rep", F.xxhash64("gram", "range").alias("gram"))
    counts = keyed.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    rows = materialise(fanout_join(keyed, counts, "gram", F.col("rep"), "inner"), "common-rows")
    mine = F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / block)).cast("int")
    alone = rows.select("rep", "gram", mine.alias("pair"), F.lit(0).alias("side"), F.col("rep").alias("label"))
    edges = edges.unionByName(meet(alone))
    large = rows.where(F.col("m") > block)
    if large.isEmpty():
        return edges
    # From here on, what has been found is kept as an edge from each set to its component.
    found = components(edges).select(F.col("id").alias("a"), F.col("component").alias("b"))

    def labelled() -> DataFrame:
        parts = found.select(F.col("a").alias("rep"), F.col("b").alias("label"))
        return materialise(large.join(parts, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "common-parts")

    few = top_per_group(labelled().drop("m"), ["gram", "label"], [F.asc("rep")], SAMPLE)
    apart = few.groupBy("gram").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram", "m")
    few = fanout_join(few, apart, "gram", F.col("rep"), "inner")
    found = components(found.unionByName(meet(blocks_of(few, "m", block, "rep")))).select(F.col("id").alias("a"), F.col("component").alias("b"))
    # Where no part has more sets than have met, all pairs have been looked at.
    parts = labelled()
    more = parts.groupBy("gram", "label").agg(F.count("*").alias("sets")).groupBy("gram").agg(F.max("sets").alias("most")).where(F.col("most") > SAMPLE).select("gram")
    rest = fanout_join(parts, more, "gram", F.col("rep"), "inner")
    return found.unionByName(meet(blocks_between_parts(rest, "gram", block)))
