"""Phrase collocations by weighted acyclic automata.

Phrases of two to four words are scored by how often they occur against how often their two parts do, for the cut
that suits them least; each language has its own counts.

Plan
1. Ranges: n-grams in the order of their words are cut into ranges at the quantiles of a bounded sample, so a frequent word or
   pair takes several ranges. Bounds only deal the work; no count depends on them.
2. Words and pairs: each task turns its texts, a chunk of bounded size at a time, into a count automaton and sends
   each range its stretch. Within a range the stretches are united and their counts added.
3. Three and four words: what occurs often has pairs that do, so a bitmap of the frequent pairs (of fixed size; a
   false hit costs work and changes nothing) thins the texts out before they are counted as in 2.
4. Parts: each range asks other ranges for the counts of its phrases' parts, by one automaton of sorted phrases for each range
   that has some; there it is composed with the counts and goes back. With it go the counts of
   the longer phrases that hold a phrase, which may drop it.
5. Scores, in whole numbers of any size; each range keeps its ``top`` best, and a window ranks them.

Defined cases: null and empty texts have no words; a null lang is ``und``. Repeated rows count as often as they are there; nothing
else of a row is read. A language without a frequent phrase has no rows. Only A-Z are lower-cased.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm.automata import Automaton, Phrase
from marlstone.llm.common import materialise, trimmed

ORDER, LEAST, COVER, TOP = 4, 30, 80, 2000
CHUNK_BYTES, RANGE_CHARS, MAX_RANGES, SAMPLE_DOCS, SAMPLES = 8 << 20, 12 << 20, 1 << 16, 20_000, 32
BITS, SLABS = 27, 64

#: A-Z in lower case, what ends a piece as line feeds, tabs as blanks.
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_PART = "lang string, longer boolean, range int, kind int, asker_longer boolean, asker int, data binary"

Bounds = dict[tuple[str, bool], list[Phrase]]


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """(words in order, the text as numbers of them with -1 between pieces)."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    tokens = text.translate(_PIECES).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    words = sorted(w for w in number if w not in (b"", b"\n"))
    rank = np.empty(len(number), np.int64)
    rank[[number[w] for w in words]] = np.arange(len(words))
    for w, r in ((b"", -2), (b"\n", -1)):
        if w in number:
            rank[number[w]] = r
    ids = rank[ids]
    return words, ids[ids != -2]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text): texts of one language put together until all that is held has ``most`` bytes. Longer texts are cut where a piece ends."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            left = text.as_py().encode("utf-8", "surrogatepass")
            while left:
                cut = len(left)
                if cut > most:
                    shown = left[most:].translate(_PIECES).find(b"\n")
                    cut = len(left) if shown < 0 else most + shown + 1
                held[lang].append(left[:cut])
                left, size = left[cut:], size + cut
                if size >= most:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held.clear()
                    size = 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)


def bounds_of(texts: DataFrame, range_chars: int = RANGE_CHARS) -> Bounds:
    """Where ranges begin, by language, for n-grams of up to two words and (True) for longer ones: quantiles of sampled places.

    At most about SAMPLE_DOCS texts are read, and SAMPLES n-grams a range come to the driver.
    """
    sizes = {r["lang"]: (r["n"], r["chars"]) for r in texts.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}  # a row a language
    wanted = {lang: min(MAX_RANGES, -(-chars // range_chars)) for lang, (_, chars) in sizes.items()}
    share = max(1, sum(n for n, _ in sizes.values()) // SAMPLE_DOCS)
    step = {lang: max(1, chars // share // 6 // (SAMPLES * wanted[lang])) for lang, (_, chars) in sizes.items()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if wanted[lang] > 1:
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    words, ids = numbered(data)
                    for at in range(zlib.crc32(data) % step[lang], len(ids), step[lang]):
                        run = ids[at : at + ORDER].tolist()
                        run = run[: run.index(-1)] if -1 in run else run
                        if run:
                            found.append((lang, b" ".join(words[i] for i in run)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["lang", "words"])

    sampled = defaultdict(list)
    for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(trimmed(look), "lang string, words binary").toLocalIterator():
        sampled[r["lang"]].append(tuple(bytes(r["words"]).split(b" ")))
    out: Bounds = {}
    for lang, n in wanted.items():
        for longer in (False, True):
            found = sorted(p if longer else p[:2] for p in sampled[lang])
            out[lang, longer] = sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []
    return out


def _pair_bits(words: list[bytes], lang: str) -> np.ndarray:
    """A 64-bit number for each word; a pair's place in the bitmap comes from two of them."""
    salt = lang.encode()
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8, key=salt[:64]).digest(), "little") for w in words], np.uint64)


def _place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


def _counted(texts: DataFrame, bounds, longer: bool, bitmap, chunk_bytes: int) -> DataFrame:
    """(lang, range, data): count automata, cut by range, of the texts of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _chunks(batches, chunk_bytes):
            words, ids = numbered(text)
            if longer:
                bits, codes = np.frombuffer(bitmap.value, np.uint8), _pair_bits(words, lang)
                at = _place(codes[ids[:-1]], codes[ids[1:]]) if len(ids) > 1 and words else np.zeros(max(0, len(ids) - 1), np.uint64)
                allowed = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                automaton = Automaton.of_text(words, ids, range(3, ORDER + 1), allowed)
            else:
                automaton = Automaton.of_text(words, ids, range(1, 3))
            for i, part in automaton.ranges(bounds.value[lang, longer]):
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([i], pa.int32()), pa.array([part.dump()], pa.binary())], ["lang", "range", "data"])

    return texts.mapInArrow(trimmed(count), "lang string, range int, data binary")


def _united(parts: DataFrame, longer: bool, least: int) -> DataFrame:
    """A row a range: its automaton of frequent n-grams, and how many words begin there."""

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, held, size = Automaton([], []), [], 0
        for data in pdf["data"]:
            held.append(Automaton.load(data))
            size += len(held[-1])
            if size > 1 << 20 and size > len(whole):
                whole, held, size = Automaton.union([whole, *held]), [], 0
        whole = Automaton.union([whole, *held])
        words = int(whole.levels[0][2].sum()) if whole.levels else 0
        return pd.DataFrame({"lang": pdf["lang"].iat[0], "longer": longer, "range": pdf["range"].iat[0], "n": words, "data": [whole.at_least(least).dump()]})

    return parts.groupBy("lang", "range").applyInPandas(unite, "lang string, longer boolean, range int, n long, data binary")


def _bitmap(pairs: DataFrame) -> bytes:
    """Bits of the frequent pairs; SLABS rows, 2^BITS bits in all, come to the driver."""
    width = (1 << BITS) // SLABS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = Automaton.load(data)
                if len(a.levels) > 1 and a.words:
                    codes = _pair_bits(a.words, lang)
                    state, word, _ = a.levels[1]
                    at = np.unique(_place(codes[a.levels[0][1][state]], codes[word])).astype(np.int64)
                    slabs = np.unique(at // width)
                    yield pa.RecordBatch.from_arrays([pa.array(slabs.astype(np.int32)), pa.array([(at[at // width == s] % width).astype(np.uint32).tobytes() for s in slabs], pa.binary())], ["slab", "at"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width // 8, np.uint8)
        for data in pdf["at"]:
            at = np.frombuffer(data, np.uint32)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"slab": [pdf["slab"].iat[0]], "bits": [bits.tobytes()]})

    slabs = pairs.select("lang", "data").mapInArrow(trimmed(places), "slab int, at binary").groupBy("slab").applyInPandas(fill, "slab int, bits binary")
    out = bytearray((1 << BITS) // 8)
    for r in slabs.collect():
        out[r["slab"] * width // 8 : (r["slab"] + 1) * width // 8] = r["bits"]
    return bytes(out)


def _inner(phrase: Phrase) -> Iterator[Phrase]:
    """The shorter phrases of two words and more inside."""
    for n in range(2, len(phrase)):
        yield from (phrase[i : i + n] for i in range(len(phrase) - n + 1))


def _asks(counts: DataFrame, bounds) -> DataFrame:
    """Counts, and for each range what others ask of it: automata of phrases, weighted by the longer phrases' counts plus one."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lang, me = row["lang"], (row["longer"], row["range"])
                wanted: defaultdict[tuple[bool, int], dict[Phrase, int]] = defaultdict(dict)

                def want(phrase: Phrase, cover: int) -> None:
                    longer = len(phrase) > 2
                    to = wanted[longer, bisect_right(bounds.value[lang, longer], phrase)]
                    to[phrase] = max(to.get(phrase, 0), cover + 1)

                for phrase, count in Automaton.load(row["data"]).phrases():
                    for k in range(1, len(phrase)):
                        want(phrase[:k], 0)
                        want(phrase[k:], 0)
                    for part in _inner(phrase):
                        want(part, count)
                rows = [(lang, *me, 0, *me, row["data"]), *((lang, *to, 1, *me, Automaton.of_phrases(sorted(found.items())).dump()) for to, found in wanted.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], ["lang", "longer", "range", "kind", "asker_longer", "asker", "data"])

    return counts.select("lang", "longer", "range", "data").mapInArrow(trimmed(ask), _PART)


def _answers(asked: DataFrame) -> DataFrame:
    """By range: its counts (0), the answers to what it asked (1), and how often the longer phrases around its own occur (2)."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [Automaton.load(x) for x in pdf["data"][pdf["kind"] == 0]]
        rows, cover = [], {}
        for lang, longer, at, kind, asker_longer, asker, data in pdf.itertuples(index=False, name=None):
            if kind == 0:
                rows.append((lang, longer, at, 0, longer, at, data))
                continue
            request = Automaton.load(data)
            rows.append((lang, asker_longer, asker, 1, longer, at, own[0].compose(request).dump()))
            for phrase, weight in request.phrases():
                if weight > 1:
                    cover[phrase] = max(cover.get(phrase, 0), weight - 1)
        if cover:
            lang, longer, at = pdf["lang"].iat[0], pdf["longer"].iat[0], pdf["range"].iat[0]
            rows.append((lang, longer, at, 2, longer, at, Automaton.of_phrases(sorted(cover.items())).dump()))
        return pd.DataFrame(rows, columns=["lang", "longer", "range", "kind", "asker_longer", "asker", "data"])

    return asked.groupBy("lang", "longer", "range").applyInPandas(answer, _PART)


def _scored(answers: DataFrame, cover: int, top: int) -> DataFrame:
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        part: dict[Phrase, int] = {}
        around: dict[Phrase, int] = {}
        for kind, data in zip(pdf["kind"], pdf["data"]):
            if kind:
                (part if kind == 1 else around).update(Automaton.load(data).phrases())
        rows = []
        for data in pdf["data"][pdf["kind"] == 0]:
            for phrase, a in Automaton.load(data).phrases():
                if len(phrase) > 1 and 100 * around.get(phrase, 0) < cover * a:
                    cuts = [(part[phrase[:k]], part[phrase[k:]]) for k in range(1, len(phrase))]
                    value, _, left, right = min((1_000_000 * 2 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
                    rows.append((-value, -a, b" ".join(phrase), left, right))
        rows = sorted(rows)[:top]
        return pd.DataFrame([(pdf["lang"].iat[0], p.decode("utf-8", "surrogatepass"), -a, x, y, -s) for s, a, p, x, y in rows], columns=["lang", "phrase", "a", "l", "r", "score"]).astype({c: "int64" for c in "a l r score".split()})

    return answers.groupBy("lang", "longer", "range").applyInPandas(score, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, text_col: str = "text", lang_col: str = "lang", range_chars: int = RANGE_CHARS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    texts = _texts(docs, text_col, lang_col)
    context = docs.sparkSession.sparkContext
    bounds = context.broadcast(bounds_of(texts, range_chars))
    pairs = materialise(_united(_counted(texts, bounds, False, None, chunk_bytes), False, least), "phrases-pairs")
    bitmap = context.broadcast(_bitmap(pairs))
    longer = materialise(_united(_counted(texts, bounds, True, bitmap, chunk_bytes), True, least), "phrases-longer")
    asked = _asks(pairs.unionByName(longer), bounds)
    best = _scored(materialise(_answers(asked), "phrases-answers"), cover, top)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(16))
    some = best.withColumn("nth", F.row_number().over(W.partitionBy("lang", spread).orderBy(*order))).where(F.col("nth") <= top).drop("nth")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = pairs.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, len(g) AS n, array_to_string(g, ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, unnest([w[i:i], w[i:i + 1], w[i:i + 2], w[i:i + 3]][1:least(4, len(w) - i + 1)]) AS g FROM placed) GROUP BY lang, g
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE n = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, n, a FROM grams WHERE n > 1 AND a >= 30
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, n)) AS k FROM candidates)
), scores AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = first JOIN grams y ON y.lang = c.lang AND y.phrase = rest
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, n - m + 2)) AS i FROM (SELECT *, unnest(range(2, n)) AS m FROM candidates))
), around AS (
  SELECT lang, phrase, max(a) AS longest FROM inner_ GROUP BY lang, phrase
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN around USING (lang, phrase) WHERE coalesce(100 * longest < 80 * l.a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
