"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A line occurrence with words is deleted iff it lies in a run of lines with
``min_words`` words or more that equals, line for line, one at an earlier place;
places are ordered by (doc_id, text digest, line). Lines that the earlier copy
itself covers (self-overlap in one document) stay.

A *stretch* is a run of consecutive lines; from a given line, its *stretch of n
words* is the fewest lines, that one first, which hold n words. To the right a match
goes on by the stretches of the lines after, and to the left and at its end by those
that end at a line: the fewest lines, that one last, which hold n words. Any repeated run
is made up of repeated stretches of ``min_words`` words of these two kinds.

Plan
1. Lines are exploded as (document, position, md5, words); texts stay behind.
2. Winnowing: each line's stretch of ``gram_words`` words is hashed; of those
   that start within ``window_words`` words the one with the least hash is a
   fingerprint. A line as long as the window is always one. Since gram + window
   - 1 <= min_words, equal stretches of ``min_words`` words have a fingerprint
   in common, wherever they stand.
3. Fingerprint hashes are counted (combined before the shuffle), and positions
   of those that occur twice are joined back, dealt over salts.
4. Matches are extended both ways: of every stretch of ``min_words`` words that
   starts up to a window left of a matched fingerprint, or ends within that many words
   right of one, the 128-bit digest is compared with the first place of that digest; neighbouring
   stretches carry the match on. No pairs are made: a group of n copies costs n rows.
5. Repeated intervals are merged and cut out of the documents they are in.

Defined cases: null and empty texts stay as they are. Blank lines have no words:
one inside a deleted stretch goes with it, others stay. Rows with a null id are
left alone. A row given twice counts as one place, so both copies are cut alike.
Other columns pass through; an ``n_chars`` column is set anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm.common import fanout_join, materialise

MIN_WORDS, GRAM_WORDS, WINDOW_WORDS = 50, 25, 26


def count_words(c: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    marked = F.regexp_replace(c, r"[^\x20\x09-\x0D]+", "w")
    return F.length(marked) - F.length(F.replace(marked, F.lit("w"), F.lit("")))


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def line_grams(docs: DataFrame, id_col: str, text_col: str, min_words: int, gram_words: int, window_words: int) -> DataFrame:
    """(doc, tk, pos, c, past, end, key, back, back_key, gram, fp): a row for each line with words.

    c, past: words before the line and up to its end; key, end: digest and last line of its
    stretch of ``min_words`` words (key null if the document ends before); back, back_key: first
    line and digest of the stretch that ends there (null where it is the stretch of
    its first line, too); gram: hash of its
    stretch of ``gram_words`` words; fp: whether winnowing selects it.
    """
    lines = (
        docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0))
        .select(F.col(id_col).alias("doc"), _text_key(F.col(text_col)).alias("tk"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
        .select("doc", "tk", "pos", F.md5("line").alias("h"), count_words(F.col("line")).cast("long").alias("w"))
        .where("w > 0")
        .repartition("doc", "tk")
        .dropDuplicates(["doc", "tk", "pos"])
    )
    by_line = W.partitionBy("doc", "tk").orderBy("pos")
    lines = lines.withColumn("c", F.sum("w").over(by_line.rowsBetween(W.unboundedPreceding, 0)) - F.col("w"))
    by_word = W.partitionBy("doc", "tk").orderBy("c")
    stretch, gram, window = (by_word.rangeBetween(0, n - 1) for n in (min_words, gram_words, window_words))
    lines = lines.withColumn("past", F.col("c") + F.col("w"))
    behind = W.partitionBy("doc", "tk").orderBy("past").rangeBetween(-(min_words - 1), 0)
    longer = F.sum("w").over(behind) - F.col("w") >= min_words
    hashed = lines.select(
        "doc", "tk", "pos", "c", "past",
        F.min("pos").over(behind).alias("back"),
        F.when(longer, F.md5(F.array_join(F.collect_list("h").over(behind), ""))).alias("back_key"),
        F.max("pos").over(stretch).alias("end"),
        F.when(F.sum("w").over(stretch) >= min_words, F.md5(F.array_join(F.collect_list("h").over(stretch), ""))).alias("key"),
        F.when(F.sum("w").over(gram) >= gram_words, F.xxhash64(F.collect_list("h").over(gram))).alias("gram"),
    )
    # A line is a fingerprint if any window that holds it has its least hash (the leftmost of equal ones) there.
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "c"))).over(window)
    chosen = hashed.withColumn("at", least["c"])
    back = by_word.rangeBetween(-(window_words - 1), 0)
    return chosen.withColumn("fp", F.array_contains(F.collect_set("at").over(back), F.col("c")) & F.col("gram").isNotNull()).drop("at")


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc, tk, cut): for each document touched, its merged [first, last] line intervals to delete."""
    if gram_words + window_words - 1 > min_words:
        raise ValueError("gram_words + window_words - 1 must not exceed min_words, or repeats are missed")
    grams = materialise(line_grams(docs, id_col, text_col, min_words, gram_words, window_words), "line-grams")
    prints = grams.where("fp").select("doc", "tk", "c", "gram")
    shared = prints.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    matched = fanout_join(prints, shared, "gram", F.struct("doc", "c"), "inner").select("doc", "tk", "c", F.lit(True).alias("hit"))
    ahead = W.partitionBy("doc", "tk").orderBy("c").rangeBetween(0, window_words - 1)
    marked = grams.drop("gram", "fp").join(matched, ["doc", "tk", "c"], "left").withColumn("near", F.max("hit").over(ahead))
    # Equal stretches share a fingerprint, so a match inside is enough.
    behind = W.partitionBy("doc", "tk").orderBy("past").rangeBetween(-(min_words - 1), 0)
    forward, backward = (F.struct(F.col(lo).alias("pos"), F.col(hi).alias("end"), F.col(key).alias("key")) for lo, hi, key in (("pos", "end", "key"), ("back", "pos", "back_key")))
    both = F.array(F.when(F.col("near"), forward), F.when(F.max("hit").over(behind), backward))
    marked = marked.select("doc", "tk", both.alias("both")).select("doc", "tk", F.inline("both"))
    near = marked.where("key IS NOT NULL").select("doc", "tk", "pos", "end", "key")
    near = materialise(near, "line-stretches")
    first = near.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tk", "pos", "end")).alias("first")).where("n > 1")
    later = fanout_join(near, first, "key", F.struct("doc", "pos"), "inner").where(F.struct("doc", "tk", "pos") > F.struct("first.doc", "first.tk", "first.pos"))
    same = (F.col("doc") == F.col("first.doc")) & (F.col("tk") == F.col("first.tk"))
    cuts = later.select("doc", "tk", F.when(same, F.greatest("pos", F.col("first.end") + 1)).otherwise(F.col("pos")).alias("lo"), F.col("end").alias("hi")).where("lo <= hi")
    order = W.partitionBy("doc", "tk").orderBy("lo", "hi")
    islands = cuts.withColumn("new", F.coalesce((F.col("lo") > F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "tk", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("doc", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with later repeated runs deleted; with ``counts`` also n_lines_removed. With
    ``drop_emptied`` documents go that lose all their words; those that had none stay."""
    cuts = repeated_intervals(docs, id_col, text_col, min_words, gram_words, window_words)
    cuts = cuts.select(F.col("doc").alias("_ld_doc"), F.col("tk").alias("_ld_tk"), F.col("cut").alias("_ld_cut"))
    joined = docs.withColumn("_ld_key", _text_key(F.col(text_col))).join(cuts, (F.col(id_col) == F.col("_ld_doc")) & (F.col("_ld_key") == F.col("_ld_tk")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_ld_cut", lambda v: (v["lo"] <= i) & (i <= v["hi"])))
    out = joined.withColumn("_ld_text", F.when(F.col("_ld_cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    if drop_emptied:
        out = out.where(F.col("_ld_cut").isNull() | F.col("_ld_text").rlike(r"[^\x20\x09-\x0D]"))
    removed = F.coalesce(F.aggregate("_ld_cut", F.lit(0), lambda a, v: a + v["hi"] - v["lo"] + 1), F.lit(0)).cast("long")
    columns = [F.col("_ld_text").alias(c) if c == text_col else F.length("_ld_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns, *([removed.alias("n_lines_removed")] if counts else []))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, md5(line) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents WHERE length(text) > 0)
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0
), placed AS (
  SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS past, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS BIGINT) AS c FROM lines
), stretches AS (
  SELECT doc_id, pos, max(pos) OVER f AS hi, sum(w) OVER f AS words, list(h) OVER f AS hs
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, lo AS pos, pos AS hi, words, hs FROM (
    SELECT doc_id, pos, w, min(pos) OVER b AS lo, sum(w) OVER b AS words, list(h) OVER b AS hs
    FROM placed WINDOW b AS (PARTITION BY doc_id ORDER BY past RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE words - w >= 50
), firsts AS (
  SELECT *, row_number() OVER k AS nth, first_value(doc_id) OVER k AS d0, first_value(hi) OVER k AS hi0
  FROM stretches WHERE words >= 50 WINDOW k AS (PARTITION BY hs ORDER BY doc_id, pos)
), cuts AS (
  SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(pos, hi0 + 1) ELSE pos END AS lo, hi FROM firsts WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM cuts WHERE lo <= hi
), every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE length(text) > 0
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS gone
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(k.text, '') END AS text,
       CAST(length(CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(k.text, '') END) AS BIGINT) AS n_chars,
       CAST(coalesce(k.gone, 0) AS BIGINT) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
