"""Set-similarity index of names: who is similar to whom, without comparing every pair.

Names are sets of trigrams, ordered with the rarest first (ties by the trigram). Two sets of at least a given
Jaccard similarity share one of their first trigrams, how many of these is told by their size (the prefix), so only prefixes
are posted. Of what meets there, sets of too unlike a size and places too late for
enough to follow are passed over, and a pair counts at its first common trigram only, so none comes twice.

The alphabet is letters a-z, digits and a blank, hence there are at most ``ALPHABET`` ** 3 different trigrams and
their counts may be broadcast. A trigram held by more than ``hot`` names is dealt over as many salts as it
takes: common ones are rarely in a prefix, and where all names hold the same few they don't meet in one task.

Where a few names are asked (checked), their sets go to every task instead, and trigrams in common are counted by matrix products: in running
text most names share a trigram with each asked one, so an index would post and meet nearly all pairs as rows.

Names inside names are found by their rarest run of three characters (of one or two, if they are that short).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from marlstone.functions import text

ALPHABET, HOT, SLACK = 37, 5_000, 1e-9
#: So many asked rows, with so many trigrams and so many characters, go to every task. Products are made of so many of them, with so many trigrams, and of so many known names at a time.
FEW, FEW_GRAMS, FEW_CHARS, ASKED_BLOCK, GRAMS_BLOCK, KNOWN_BLOCK = 2_048, 131_072, 8 << 20, 512, 8_192, 512


def _grams(rows: DataFrame, name: str, row: str) -> DataFrame:
    """(row, grams): rows as structs with their trigrams; equal rows are one, rows without trigrams are none."""
    return rows.select(F.struct("*").alias(row), text.trigrams(F.col(name)).alias("grams")).where(F.size("grams") > 0).distinct()


def _counts(known: DataFrame) -> DataFrame:
    """(gram, held): at most ALPHABET ** 3 rows."""
    return known.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))


def _prefixes(named: DataFrame, counts: DataFrame, row: str, least: float) -> DataFrame:
    """(row, grams, prefix): prefix has (held, gram), rarest first."""
    one = named.select(row, "grams", F.explode("grams").alias("gram")).join(F.broadcast(counts), "gram", "left")
    ordered = one.groupBy(row, "grams").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram"))).alias("o"))
    n = F.size("grams")
    return ordered.select(row, "grams", F.slice("o", F.lit(1), n - F.ceil(n * least - SLACK).cast("int") + 1).alias("prefix"))


def _salts(held: Column, hot: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(held / hot)).cast("int")


def _few(asked: DataFrame, few: int) -> pa.Table | None:
    """The asked rows with their trigrams, if they are few and small enough for every task."""
    size = asked.limit(few + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("grams"), F.coalesce(F.sum(F.length(F.to_json(F.struct("asked")))), F.lit(0)).alias("chars")).first()
    return asked.toArrow() if size["n"] <= few and size["grams"] <= FEW_GRAMS and size["chars"] <= FEW_CHARS else None


def _asked_blocks(sets: list[list[str]]) -> list[np.ndarray]:
    """Places of sets, at most ASKED_BLOCK of them and GRAMS_BLOCK trigrams in a block, or one set."""
    out, sizes = [[]], [0]
    for i, grams in enumerate(sets):
        if out[-1] and (len(out[-1]) == ASKED_BLOCK or sizes[-1] + len(grams) > GRAMS_BLOCK):
            out.append([])
            sizes.append(0)
        out[-1].append(i)
        sizes[-1] += len(grams)
    return [np.array(at) for at in out if at]


def _incidence(rows: np.ndarray, places: np.ndarray, n: int, width: int) -> np.ndarray:
    """0 and 1: numbers in single precision are exact up to 2 ** 24."""
    out = np.zeros((n, width), np.float32)
    out[rows, places] = 1
    return out


def _scan(known: DataFrame, held: pa.Table, asked_type: StructType, least: float) -> DataFrame:
    """The pairs of a few asked rows and all known ones: each task takes known names a block at a time and counts common trigrams in matrix products."""
    shared = known.sparkSession.sparkContext.broadcast(held)  # bounded by _few
    schema = StructType().add("asked", asked_type).add("known", known.schema["known"].dataType).add("similarity", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sets = shared.value.column("asked").combine_chunks(), shared.value.column("grams").combine_chunks()
        m = sets.value_lengths().to_numpy()
        blocks = []
        for at in _asked_blocks(sets.to_pylist()):
            part = sets.take(pa.array(at))
            grams = part.flatten().unique()
            blocks.append((at, grams, part.flatten(), np.repeat(np.arange(len(at)), m[at])))
        for batch in batches:
            rows, lists = batch.column(0), batch.column(1)
            n = lists.value_lengths().to_numpy()
            for at, grams, flat, mine in blocks:
                wanted = _incidence(mine, pc.index_in(flat, grams).to_numpy(), len(at), len(grams))
                for first in range(0, len(n), KNOWN_BLOCK):
                    some = lists.slice(first, KNOWN_BLOCK)
                    sizes = n[first : first + KNOWN_BLOCK]
                    place = pc.fill_null(pc.index_in(some.flatten(), grams), -1).to_numpy()
                    there = place >= 0
                    common = wanted @ _incidence(np.repeat(np.arange(len(sizes)), sizes)[there], place[there], len(sizes), len(grams)).T
                    union = m[at][:, None] + sizes[None, :] - common
                    i, j = np.nonzero(common >= (least - SLACK) * union)
                    alike = common[i, j].astype(float) / (m[at][i] + sizes[j] - common[i, j].astype(float))
                    keep = alike >= least
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([asked.take(pa.array(at[i[keep]])), rows.take(pa.array(first + j[keep])), pa.array(alike[keep])], ["asked", "known", "similarity"])

    return known.select("known", "grams").mapInArrow(run, schema).distinct()


def similar(asked: DataFrame, known: DataFrame, least: float = 0.3, asked_name: str = "name", known_name: str = "name", hot: int = HOT, few: int = FEW) -> DataFrame:
    """(asked, known, similarity) of the pairs of rows, as structs, whose names are at least ``least`` similar in trigrams. ``least`` is above 0.

    Up to ``few`` asked rows go to every task, where known rows are not shuffled; more are joined by the index."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    a, b = _grams(asked, asked_name, "asked"), _grams(known, known_name, "known")
    held = _few(a, few) if few else None
    if held is not None:
        rows = known.select(F.struct("*").alias("known"), text.trigrams(F.col(known_name)).alias("grams")).where(F.size("grams") > 0)
        return _scan(rows, held, a.schema["asked"].dataType, least)
    counts = _counts(b)
    a, b = _prefixes(a, counts, "asked", least), _prefixes(b, counts, "known", least)
    posted = b.select("known", F.col("grams").alias("bg"), F.col("prefix").alias("bp"), F.posexplode("prefix").alias("bi", "g"))
    posted = posted.withColumn("salt", F.pmod(F.xxhash64("known"), _salts(F.col("g.held"), hot)).cast("int"))
    wanted = a.select("asked", F.col("grams").alias("ag"), F.col("prefix").alias("ap"), F.posexplode("prefix").alias("ai", "g")).where("g.held > 0")
    wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("g.held"), hot) - 1)))
    m, n = F.size("ag"), F.size("bg")
    met = wanted.withColumn("gram", F.col("g.gram")).drop("g").join(posted.withColumn("gram", F.col("g.gram")).drop("g"), ["gram", "salt"])
    fits = (m >= least * n - SLACK) & (n >= least * m - SLACK)
    enough = 1 + F.least(m - F.col("ai"), n - F.col("bi")) - 1 >= least / (1 + least) * (m + n) - SLACK
    first = F.array_intersect("ap", "bp")[0]["gram"] == F.col("gram")
    pairs = met.where(fits & enough).where(first)
    return pairs.select("asked", "known", text.trigram_similarity(F.col("ag"), F.col("bg")).alias("similarity")).where(F.col("similarity") >= least)


def sounding_alike(asked: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """(asked, known) of the pairs of rows, as structs, of one phonetic code (column ``code`` in both); rows without a code are in none. A code of
    more than ``hot`` known rows is dealt over salts."""
    a, b = (rows.where("code IS NOT NULL").select(F.struct("*").alias(row), "code") for rows, row in ((asked, "asked"), (known, "known")))
    salts = b.groupBy("code").agg(F.count("*").alias("held")).where(F.col("held") > hot).join(a.select("code").distinct(), "code", "left_semi").select("code", _salts(F.col("held"), hot).alias("salts"))
    n = F.coalesce("salts", F.lit(1))
    posted = b.join(salts, "code", "left").withColumn("salt", F.pmod(F.xxhash64("known"), n).cast("int")).drop("salts")
    wanted = a.join(salts, "code", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    return wanted.join(posted, ["code", "salt"]).select("asked", "known")


def _runs(name: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substr(name, i, F.lit(size))))


def containing(asked: DataFrame, known: DataFrame, asked_name: str = "name", known_name: str = "name", hot: int = HOT) -> DataFrame:
    """(asked, known) of the pairs of rows, as structs, where the known name contains the asked one, whatever the case.

    An asked name without characters is in none. Lengths of runs that nothing asked for needs are not posted.
    """
    a = asked.select(F.struct("*").alias("asked"), F.lower(asked_name).alias("an")).where(F.length("an") > 0).distinct()
    b = known.select(F.struct("*").alias("known"), F.lower(known_name).alias("bn")).distinct()
    out = None
    for size in (1, 2, 3):
        mine = a.where(F.length("an") >= 3) if size == 3 else a.where(F.length("an") == size)
        posted = b.where(F.length("bn") >= size).select("known", "bn", F.explode(_runs(F.col("bn"), size)).alias("gram"))
        wanted = mine.select("asked", "an", F.explode(_runs(F.col("an"), size)).alias("gram"))
        held = posted.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
        rarest = wanted.join(held, "gram", "left").groupBy("asked", "an").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g")).where("g.held > 0")
        salts = rarest.select("g.gram", _salts(F.col("g.held"), hot).alias("salts")).distinct()
        spread = posted.join(salts, "gram").withColumn("salt", F.pmod(F.xxhash64("known"), "salts").cast("int")).drop("salts")
        asking = rarest.select("asked", "an", "g.gram", F.explode(F.sequence(F.lit(0), _salts(F.col("g.held"), hot) - 1)).alias("salt"))
        pairs = asking.join(spread, ["gram", "salt"]).where(F.contains("bn", "an")).select("asked", "known")
        out = pairs if out is None else out.unionByName(pairs)
    return out
