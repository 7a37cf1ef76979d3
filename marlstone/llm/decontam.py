"""Benchmark decontamination by template canonicalisation.

Tokens are runs without ASCII white space, stripped of signs at their edges and
lower-cased; tokens of signs alone vanish. Numbers, units of measure and names
become typed placeholders whose values are kept as slots. A name is a
capitalised word inside a sentence that the text never has in lower case (also
at a sentence's start, if it is a name elsewhere), or a common given name. Windows of ``window`` tokens are
hashed. A template needs at least ``min_literal`` tokens that are no placeholders;
windows with placeholders are hashed in their own words too, so that a copy is
found whatever its case.

1. The benchmark's windows form a table; their hashes also set the bits of a
   filter of fixed size, which is broadcast.
2. Documents pass by once; windows that the filter lets through become rows.
3. Those rows are hash-joined with the benchmark's windows: by broadcast while
   the benchmark has at most ``broadcast_rows`` windows, else by a shuffle that
   deals every hash over salts.
4. Matches of a document and an item at one offset are an alignment. Its slots
   must be consistent: each value of the item stands for one value in the
   document, and back. Consistent alignments with the same values are verbatim,
   others are the question with new parameters. Of an inconsistent alignment only
   the windows with the same values count.
5. A document is contaminated by an item if the windows that count are at least
   ``min_cover`` of the item's windows; or if they are that share of those that can match as templates, which in questions full
   of slots may be few, and hold that share of the item's tokens. cover is the larger share that counts.

Defined cases: null or empty texts match nothing; items of fewer than
``min_tokens`` tokens match nothing, items shorter than a window are one window;
null ids are never reported; repeated rows count once, and rows of one id with unlike
texts are one document, in which windows of either count at their places; items of one text are
each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fanout_join, materialise, trimmed

WINDOW, MIN_LITERAL, MIN_TOKENS, MIN_COVER = 8, 4, 4, 0.5
FILTER_BITS, BROADCAST_ROWS = 1 << 23, 100_000

# Word lists.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice double triple".split()
)
UNITS = frozenset(
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh kph volt volts watt watts joule joules newton newtons celsius fahrenheit kelvin".split()
)
GIVEN_NAMES = frozenset(
    "alice bob carol dave david emma john mary james anna maria tom sarah michael susan peter paul lisa mark laura janet julia kevin jack jane george henry kate mike sam ben lucy natalia weng betty randy tina ken joy carlos hans marie pierre juan".split()
)

SLICE = 1 << 16
NUM, UNIT, NAME = 1, 2, 4
_QUOTES = frozenset("\"')]*")


def _table(test) -> np.ndarray:
    """A truth value for each code point of the basic plane, and one for all above."""
    return np.array([*(test(chr(i)) for i in range(0x10000)), test(chr(0x20000))], bool)


class Characters:
    """Properties of characters as tables; made once a worker."""

    def __init__(self) -> None:
        self.space, self.alnum, self.digit, self.upper, self.small = map(_table, (str.isspace, str.isalnum, str.isdigit, str.isupper, str.islower))
        self.quote, self.stop = _table(_QUOTES.__contains__), _table(frozenset(".!?:").__contains__)
        self.power = np.random.default_rng(29).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.numbers, self.units, self.given = (np.unique(self.tokens(" ".join(sorted(w)))[0]) for w in (NUMBERS, UNITS, GIVEN_NAMES))
        self.place = {k: self.tokens(f"placeholder{k}")[0][0] ^ np.uint64(0x5555) for k in (NUM, UNIT, NAME)}

    def tokens(self, text: str) -> tuple[np.ndarray, ...]:
        """(hash, first character, past the last, digit, capital, small, ends a sentence) of each token of a text.

        ``lead`` tells whether signs before the first token end a sentence.
        """
        self.lead = False
        low = text.lower()
        if len(low) != len(text):  # a few letters have more than one in lower case
            low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
        c, o = (np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000) for t in (low, text))
        exact = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = self.space[c]
        edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        inside = np.flatnonzero(self.alnum[c])
        if not len(inside) or not len(starts):
            return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, bool, bool, bool, bool))
        at, last = np.searchsorted(inside, starts), np.searchsorted(inside, ends) - 1
        real = at <= last
        # A token of signs alone vanishes, but it may end the sentence before it.
        mark = ends - 1
        for _ in range(3):
            mark = np.where((mark > starts) & self.quote[c[mark]], mark - 1, mark)
        stop = self.stop[c[mark]]
        owner = np.cumsum(real) - 1
        closes = np.zeros(max(1, int(real.sum())), bool)
        closes[owner[stop & (owner >= 0)]] = True
        self.lead = bool((stop & (owner < 0)).any())
        first, past = inside[at[real]], inside[last[real]] + 1
        length = len(c)
        place = np.arange(length) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, length]))
        weight = self.power[place & 63] * (np.uint64(2) * (place >> 6).astype(np.uint64) + np.uint64(1))
        sums = np.r_[np.uint64(0), np.cumsum((exact.astype(np.uint64) + np.uint64(1)) * weight, dtype=np.uint64)]
        h = sums[past] - sums[first]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

        def count(table: np.ndarray) -> np.ndarray:
            run = np.r_[0, np.cumsum(table[o], dtype=np.int64)]
            return run[past] - run[first]

        upper, small = count(self.upper), count(self.small)
        capital = self.upper[o[first]] & ((small > 0) | (past - first == 1))
        return h, first, past, count(self.digit) > 0, capital, (upper == 0) & (small > 0), closes[: len(first)]


class Texts:
    """The canonical tokens of a list of texts, one after the other.

    ``h`` has placeholders, ``plain`` has not; ``of`` is each token's text, ``begin``
    each text's first token. Short texts are read together, long ones in slices.
    """

    def __init__(self, texts: list[str | None], chars: Characters) -> None:
        made, self.parts, of, held = [], [], [], []

        def read(part: str, offsets: list[int], numbers: list[int]) -> None:
            found = chars.tokens(part)
            if chars.lead and made and len(made[-1][6]):  # a sentence that ended with the slice before
                made[-1][6][-1] = True
            made.append(found)
            self.parts.append(part)
            of.append(np.asarray(numbers)[np.searchsorted(offsets, found[1], side="right") - 1] if len(found[1]) else np.zeros(0, int))

        def flush() -> None:
            if held:
                offsets = np.r_[0, np.cumsum([len(t) + 1 for _, t in held])][:-1]
                read("\n".join(t for _, t in held), offsets.tolist(), [k for k, _ in held])
                held.clear()

        size = 0
        for k, text in enumerate(texts):
            text = text or ""
            if len(text) > SLICE:
                flush()
                for part in _slices(text):
                    read(part, [0], [k])
            else:
                held.append((k, text))
            size = size + len(text) if held else 0
            if size > SLICE:
                flush()
                size = 0
        flush()
        if not made:
            read("", [0], [0])
        h, self.first, self.past, digit, capital, small, closes = (np.concatenate(x) for x in zip(*made))
        self.part, self.of = np.repeat(np.arange(len(made)), [len(m[0]) for m in made]), np.concatenate(of)
        self.begin = np.searchsorted(self.of, np.arange(len(texts) + 1))
        starts = np.ones(len(h), bool)
        starts[1:] = closes[:-1] | (np.diff(self.of) > 0)
        number, unit, given = digit | np.isin(h, chars.numbers), np.isin(h, chars.units), np.isin(h, chars.given)
        capital &= ~number & ~unit
        names = capital & ~starts & ~given
        if names.any():
            mine = h ^ (self.of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a word of one text
            names[names] = ~np.isin(mine[names], mine[small])
            names |= capital & np.isin(mine, mine[names])
        names |= capital & given
        kind = np.where(names, NAME, np.where(number, NUM, np.where(unit, UNIT, 0)))
        self.plain, self.placeholder, self.h = h, kind > 0, h
        if self.placeholder.any():
            self.h = h.copy()
            for k, value in chars.place.items():
                self.h[kind == k] = value

    def word(self, i: int) -> str:
        return self.parts[self.part[i]][self.first[i] : self.past[i]].lower()

    def slots(self, start: int, size: int) -> list[str]:
        return [self.word(i) for i in range(start, start + size) if self.placeholder[i]]

    def windows(self, size: int, min_literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, hash, whether typed) of the windows of each text: templates with enough
        literal tokens, and those with placeholders also in their own words."""
        n = len(self.h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        whole = self.of[size - 1 :] == self.of[:n]
        typed = _runs(self.h, size)
        if not self.placeholder.any():
            at = np.flatnonzero(whole)
            return at, typed[at], np.zeros(len(at), bool)
        slots = np.r_[0, np.cumsum(self.placeholder)]
        slots = slots[size:] - slots[:-size]
        enough, some = np.flatnonzero(whole & (size - slots >= min(min_literal, size))), np.flatnonzero(whole & (slots > 0))
        return np.r_[enough, some], np.r_[typed[enough], _runs(self.plain, size)[some]], np.r_[slots[enough] > 0, np.zeros(len(some), bool)]


def _slices(text: str) -> Iterator[str]:
    """Parts of at most SLICE characters, cut at a blank where there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens.

    Runs of 1, 2, 4, ... tokens are put together from two halves, a run of any
    size from those of its binary digits.
    """
    n = len(h) - size + 1
    out, run, factor, length, done = np.full(n, size, np.uint64), h, 0x9E3779B97F4A7C15, 1, 0
    while length <= size:
        if size & length:
            out = out * np.uint64(factor) + run[done : done + n]
            done += length
        run = run[:-length] * np.uint64(factor) + run[length:]
        factor, length = factor * factor % (1 << 64), 2 * length
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


_WINDOW_ROWS = "id long, size int, pos int, h long, slots array<string>"
_ITEM_ROWS = _WINDOW_ROWS + ", template boolean"


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, min_literal: int, min_tokens: int) -> DataFrame:
    """(item_id, size, ipos, h, islots, n_windows, n_templates) of the benchmark; n_templates: windows that others than copies can match."""

    def cut(batches):
        chars = Characters()
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["id"], pdf["text"]):
                t = Texts([text], chars)
                size = min(window, len(t.h))
                if size >= min(min_tokens, window):
                    for p, x, typed in zip(*t.windows(size, min_literal)):
                        rows.append((item, size, int(p), int(x.view(np.int64)), t.slots(p, size) if typed else [], bool(typed) or not t.placeholder[p : p + size].any()))
            yield pd.DataFrame(rows, columns=["id", "size", "pos", "h", "slots", "template"])

    known = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut_up = known.mapInPandas(cut, _ITEM_ROWS).dropDuplicates(["id", "pos", "h"])
    total = cut_up.groupBy("id").agg(F.countDistinct("pos").cast("int").alias("n_windows"), F.countDistinct(F.when(F.col("template"), F.col("pos"))).cast("int").alias("n_templates"))
    return cut_up.join(total, "id").select(F.col("id").alias("item_id"), "size", F.col("pos").alias("ipos"), "h", F.col("slots").alias("islots"), "n_windows", "n_templates")


def _filter_bits(table: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of ``table``; at most ``bits`` numbers meet in one task, one row of bits/8 bytes comes back."""

    def gather(batches: Iterator[pd.DataFrame]):
        out = np.zeros(bits, bool)
        for pdf in batches:
            out[pdf["bit"].to_numpy()] = True
        yield pd.DataFrame({"bits": [np.packbits(out).tobytes()]})

    rows = table.select(F.pmod("h", F.lit(bits)).alias("bit")).distinct().coalesce(1).mapInPandas(gather, "bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_literal: int = MIN_LITERAL, min_tokens: int = MIN_TOKENS, min_cover: float = MIN_COVER, filter_bits: int = FILTER_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, cover, matched_windows, verbatim, first_token, last_token): a row a contaminated pair.

    ``filter_bits`` is a power of two.
    """
    table = materialise(item_windows(items, item_col, item_text_col, window, min_literal, min_tokens), "item-windows")
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # at most `window` numbers
    held = docs.sparkSession.sparkContext.broadcast(_filter_bits(table, filter_bits))

    def probe(batches):
        chars, bits = Characters(), held.value
        for pdf in batches:
            rows, ids = [], pdf["id"].tolist()
            for at in range(0, len(ids), 200):
                t = Texts(pdf["text"].iloc[at : at + 200].tolist(), chars)
                for size in sizes:
                    first, hashes, typed = t.windows(size, min_literal)
                    bit = (hashes & np.uint64(filter_bits - 1)).view(np.int64)
                    hit = np.flatnonzero((bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                    for i in hit:
                        k = int(t.of[first[i]])
                        rows.append((ids[at + k], size, int(first[i] - t.begin[k]), int(hashes[i].view(np.int64)), t.slots(first[i], size) if typed[i] else []))
            yield pd.DataFrame(rows, columns=["id", "size", "pos", "h", "slots"])

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = known.mapInPandas(trimmed(probe), _WINDOW_ROWS).select(F.col("id").alias("doc_id"), "h", F.col("pos").alias("dpos"), F.col("slots").alias("dslots"))
    if table.count() <= broadcast_rows:
        met = hits.join(F.broadcast(table), "h")
    else:
        by_hash = table.groupBy("h").agg(F.collect_list(F.struct("item_id", "size", "ipos", "islots", "n_windows", "n_templates")).alias("in"))  # items that share a window
        met = fanout_join(hits, by_hash, "h", F.struct("doc_id", "dpos"), "inner").select("*", F.inline("in")).drop("in")
    met = met.withColumn("offset", F.col("dpos") - F.col("ipos"))
    aligned = met.groupBy("doc_id", "item_id", "offset").agg(
        F.collect_set("ipos").alias("at"), F.collect_set(F.when(F.col("islots") == F.col("dslots"), F.col("ipos"))).alias("own"),
        F.array_distinct(F.flatten(F.collect_set(F.zip_with("islots", "dslots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))))).alias("slots"),
        F.first("n_windows").alias("n_windows"), F.first("n_templates").alias("n_templates"), F.first("size").alias("size"),
    )
    ways = [F.size(F.array_distinct(F.col("slots")[k])) == F.size("slots") for k in ("i", "d")]
    aligned = aligned.withColumn("at", F.when(ways[0] & ways[1], F.col("at")).otherwise(F.col("own"))).where(F.size("at") > 0)
    aligned = aligned.withColumn("same", F.forall("slots", lambda s: s["i"] == s["d"]))
    per_pair = aligned.groupBy("doc_id", "item_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
        F.first("n_windows").alias("n_windows"), F.first("n_templates").alias("n_templates"), F.first("size").alias("size"), F.min("same").alias("verbatim"),
        F.min(F.col("offset") + F.array_min("at")).cast("long").alias("first_token"), F.max(F.col("offset") + F.array_max("at") + F.col("size") - 1).cast("long").alias("last_token"),
    )
    matched, size = F.size("at").cast("long"), F.col("size")
    # Tokens in matched windows: each window brings those since the one before, at most all of its own.
    tokens = F.aggregate(F.transform("at", lambda p, n: F.least(size, p - F.coalesce(F.get("at", n - 1), p - size))), F.lit(0), lambda a, b: a + b)
    share = F.least(F.lit(1.0), matched / F.nullif(F.col("n_templates"), F.lit(0)), tokens / (F.col("n_windows") + size - 1))
    cover = F.greatest(matched / F.col("n_windows"), F.when(matched / F.nullif(F.col("n_templates"), F.lit(0)) >= min_cover, share))
    found = per_pair.withColumn("matched_windows", matched).withColumn("cover", cover).where(F.col("cover") >= min_cover)
    return found.select("doc_id", "item_id", "cover", "matched_windows", "verbatim", "first_token", "last_token")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that an item contaminates; rows with a null id stay."""
    bad = contaminated(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("_dc_doc")).distinct()
    return docs.join(bad, docs[id_col].cast("long") == F.col("_dc_doc"), "left_anti")
