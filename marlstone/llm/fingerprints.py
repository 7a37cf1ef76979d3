"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is a sequence of *symbols*, each a hash. A run of k symbols is a *closed syncmer* iff, of the runs of s symbols inside
it, one with the least hash stands at its start or at its end. Whether a run is chosen depends on its own symbols
alone, so what is inserted, deleted or moved elsewhere changes no anchor, and two in k - s + 1
runs are chosen on average, wherever they stand.

A fingerprint is the ``size`` anchors with the least hashes, each with its first place. Likeness is
positional: of the ``size`` least hashes of both, those held by both count if their shifts (place in one text
less place in the other) agree within a window, for the most frequent such window. Chance
matches of common runs have shifts all over and don't count; a moved or prefixed copy has one shift.

Symbols are words (lower case, runs of no white space) in texts of ``MIN_WORDS`` words and more, and
characters in those of less than ``MAX_WORDS``; in between, a text has fingerprints of both
scales. Likeness is the higher of the scales that both texts have. Texts with no scale in
common differ fourfold in words, and are not alike. Texts of fewer than k symbols are one anchor.

``edited_fingerprints`` applies this to documents and to edited texts, whose last third is replaced by the opening of the
next document. Order is by ids alone: these are dealt by ranges, each row finds the next in
its range, and the first of each range (one row a range) closes the gaps. Texts are
shuffled once by id, and once more only the openings that are put into other texts.

Defined cases: null is the empty text; the empty text has an empty fingerprint, like
only to other empty ones (1.0). Order is by id descending, null ids last, equal ids by the hash of their texts; equal rows
follow each other, so all but the last copy are edited by the text itself. A single row is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm.common import materialise

#: Symbols a run, symbols an inner run, by scale.
WORD_RUN, WORD_INNER, CHAR_RUN, CHAR_INNER = 5, 2, 12, 5
MIN_WORDS, MAX_WORDS = 20, 80
SIZE, PLACE_BITS, SHIFT = 64, 24, 16
LAST_PLACE = (1 << PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _run(h: Column, x: Column, i: Column, n: int) -> Column:
    """Hash of the n symbols from place i on, the first of which is x."""
    return F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)])


def syncmers(symbols: Column, k: int, s: int) -> Column:
    """Anchors of an array of hashed symbols, as 64-bit numbers: the upper bits of the run's hash, then its place.

    Places beyond the last that fits count as that; hashes are the same everywhere. s is less than k.
    """
    w = k - s + 1

    def packed(hashed: Column, i: Column) -> Column:
        return F.shiftleft(hashed, PLACE_BITS).bitwiseOR(F.least(i, F.lit(LAST_PLACE)).cast("long"))

    def chosen(h: Column) -> Column:
        def among(m: Column) -> Column:
            edge = lambda x, i: F.least(x, F.get(m, i + (w - 1)))
            inside = lambda i: F.least(*[F.get(m, i + min(j, w - 2)) for j in range(1, max(3, w - 1))])
            closed = lambda x, i: edge(x, i) <= inside(i) if w > 2 else F.lit(True)
            return F.transform(m, lambda x, i: F.when((i <= F.size(h) - k) & closed(x, i), packed(_run(h, F.get(h, i), i, k), i)))

        return F.filter(_let(F.transform(h, lambda x, i: _run(h, x, i, s)), among), lambda x: x.isNotNull())

    whole = lambda h: F.when(F.size(h) > 0, F.array(packed(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<long>"))
    return _let(symbols, lambda h: F.when(F.size(h) >= k, chosen(h)).otherwise(whole(h)))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(LAST_PLACE).cast("long"))


def sketch(anchors: Column, size: int = SIZE) -> Column:
    """The ``size`` anchors with the least hashes, each hash with its first place."""
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1))))
    return F.slice(_let(F.sort_array(anchors), once), 1, size)


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """struct(words, chars): sketches by scale, null where a text has none of that scale."""

    def both(words: Column) -> Column:
        n = F.size(words)
        chars = F.transform(F.split(F.lower(text), ""), lambda c: F.xxhash64(c))
        by_word = F.when(n >= MIN_WORDS, sketch(syncmers(F.transform(words, lambda x: F.xxhash64(x)), WORD_RUN, WORD_INNER), size))
        by_char = F.when(n < MAX_WORDS, sketch(syncmers(F.when(F.length(text) > 0, chars).otherwise(F.array().cast("array<long>")), CHAR_RUN, CHAR_INNER), size))
        return F.struct(by_word.alias("words"), by_char.alias("chars"))

    return _let(F.filter(F.split(F.lower(text), "[\\x09-\\x0D ]+"), lambda x: x != ""), both)


def shown(fp: Column) -> Column:
    """A fingerprint as a string: w and c, each followed by its anchors in hexadecimal digits."""
    anchors = lambda name: F.array_join(F.transform(fp[name], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    parts = [F.when(fp[name].isNotNull(), F.concat(F.lit(f"{name[0]}:"), anchors(name))) for name in ("words", "chars")]
    return F.concat_ws(";", *parts)


def _alike(a: Column, b: Column, size: int) -> Column:
    """Likeness of two sketches of one scale."""

    def matched(t: Column) -> Column:
        ha, hb, least = t["ha"], t["hb"], t["least"]
        shift = lambda h: F.floor((place_of(F.get(t["a"], (F.array_position(ha, h) - 1).cast("int"))) - place_of(F.get(t["b"], (F.array_position(hb, h) - 1).cast("int")))) / SHIFT)
        shifts = F.transform(F.array_intersect(F.array_intersect(ha, hb), least), shift)
        near = lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda d: F.size(F.filter(all_, lambda x: (x == d) | (x == d + 1)))))
        return F.coalesce(_let(shifts, near), F.lit(0)) / F.size(least)

    hashes = lambda x: F.transform(x, hash_of)
    whole = lambda u: F.struct(u["a"].alias("a"), u["b"].alias("b"), u["ha"].alias("ha"), u["hb"].alias("hb"), F.slice(F.sort_array(F.array_union(u["ha"], u["hb"])), 1, size).alias("least"))
    start = F.struct(a.alias("a"), b.alias("b"), hashes(a).alias("ha"), hashes(b).alias("hb"))
    return _let(start, lambda u: F.when(F.size(u["a"]) + F.size(u["b"]) == 0, F.lit(1.0)).when(~F.arrays_overlap(u["ha"], u["hb"]), F.lit(0.0)).otherwise(_let(whole(u), matched)))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """0 to 1 of two fingerprints; 1 for equal ones."""
    return F.greatest(F.lit(0.0), *[F.when(a[x].isNotNull() & b[x].isNotNull(), _alike(a[x], b[x], size)) for x in ("words", "chars")])


# ---------------------------------------------------------------- the next document

_KEY = ("_id", "_none", "_hash")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _none, _hash, text): a null id is told from 0 by _none."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_none"), F.xxhash64(text).alias("_hash"), text.alias("text"))


def following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_chars, copies, next_ key): each different row and the one that follows, the first after the last."""
    order = [F.asc("_none"), F.desc("_id"), F.asc("_hash")]
    rows = _rows(docs, id_col, text_col).select(*_KEY, F.length("text").alias("n_chars"))
    rows = rows.groupBy(*_KEY).agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ranged = materialise(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "fingerprint-order")
    within = ranged.withColumn("next", F.lead(F.struct(*_KEY)).over(W.partitionBy("range").orderBy(*order)))
    first = F.min(F.struct("_none", F.bitwise_not("_id").alias("_id"), "_hash"))
    heads = ranged.groupBy("range").agg(first.alias("first"))  # a row a range
    ring = W.orderBy("range")
    after = F.coalesce(F.lead("first").over(ring), F.first("first").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("range", after.alias("after")).select("range", F.struct(F.bitwise_not("after._id").alias("_id"), "after._none", "after._hash").alias("after"))
    closed = within.join(heads, "range").withColumn("next", F.coalesce("next", "after"))
    return closed.select(*_KEY, "n_chars", "copies", *[F.col(f"next.{c}").alias(f"_next{c}") for c in _KEY])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """A row a document: fingerprints of its text and of its edited text, and their likeness."""
    order = materialise(following(docs, id_col, text_col), "fingerprint-next")
    printed = _rows(docs, id_col, text_col).withColumn("fp", fingerprint(F.col("text"), size))
    texts = printed.groupBy(*_KEY).agg(F.first("text").alias("text"), F.first("fp").alias("fp"))  # shuffled once, for both uses
    before = order.select(*[F.col(f"_next{c}").alias(c) for c in _KEY], *[F.col(c).alias(f"_to{c}") for c in _KEY], F.expr("n_chars div 3").cast("int").alias("need"))
    heads = texts.join(before, list(_KEY)).select(*[F.col(f"_to{c}").alias(c) for c in _KEY], F.expr("substring(text, 1, need)").alias("head"), F.col("fp").alias("next_fp"))
    whole = texts.join(heads, list(_KEY)).join(order.select(*_KEY, "copies"), list(_KEY))
    third = F.expr("length(text) div 3").cast("int")
    # All copies but the last are followed by the text itself.
    own = F.struct(F.substring("text", F.lit(1), third).alias("head"), F.col("fp").alias("next_fp"), (F.col("copies") - 1).alias("times"))
    other = F.struct("head", "next_fp", F.lit(1).cast("long").alias("times"))
    rows = whole.withColumn("by", F.explode(F.filter(F.array(own, other), lambda x: x["times"] > 0)))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.col("by.head"))
    rows = rows.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "fp", "by.next_fp", "by.times", edited.alias("edited"))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited"), size))
    done = rows.select("doc_id", "n_chars", "times", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp"), size).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), size).alias("near_next"))
    return done.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
