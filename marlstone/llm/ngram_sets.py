"""Texts as sets of n-gram hashes, their prefixes and parity bitmaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import trimmed

CACHE_WORDS, BASE_WORDS, MAX_WORDS, SLICE = 100_000, 4, 256, 1 << 20
#: Ids (of a few longs a row) that are broadcast at most: some 10 MB.
MAX_BROADCAST_IDS = 200_000
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of about SLICE bytes, cut at white space, so that few words are held as objects at once."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + SLICE)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def ngram_set(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text.

    Bytes are lower-cased and split as ASCII, as the contract's word rule says.
    """
    if len(words) > CACHE_WORDS:
        words.clear()
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    parts = [np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)) for tokens in map(bytes.split, _slices(data))]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def first_grams(grams: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a set: its prefix, and half as many to take the place of common ones."""
    wanted = prefix_length(len(grams), percent)
    return grams[: wanted + wanted // 2 + 2]


def is_common(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which n-grams are in the sorted array ``common``."""
    if not len(common):
        return np.zeros(len(grams), bool)
    return common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams


def prefix(first: np.ndarray, n: int, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(rare, common) n-grams of the prefix of a set of n, of which ``first`` are the least
    hashes; None if these are too few to tell."""
    last, wanted = is_common(first, common), prefix_length(n, percent)
    rare = first[~last][:wanted]
    if len(rare) < wanted and len(first) < n:
        return None
    return rare, first[last][: wanted - len(rare)]


def most_differences(a, b, percent: int):
    """Upper bound of the symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def bitmap_words(size: int, percent: int) -> int:
    """Words of 64 bits that tell sets of this size apart: unlike sets differ in about half
    of the bits, which must be well over the most differences of linked sets."""
    need = 2.8 * most_differences(size, size, percent) / 64
    words = BASE_WORDS
    while words < min(need, MAX_WORDS):
        words *= 2
    return words


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same parity over fewer bits."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def bitmap(grams: np.ndarray, words: int) -> np.ndarray:
    """Parity of the set's hashes over 64 * words bits."""
    at = (grams >> np.uint64(7)).astype(np.int64) % (64 * words)
    odd = np.bincount(at, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(n: int, percent: int):
    def make(batches):
        words = WordHashes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                grams = ngram_set(text, n, words)
                key = xxhash.xxh128(grams.tobytes()).digest() if len(grams) else None
                first = first_grams(grams, percent).view(np.int64).tolist() if len(grams) else []
                rows.append((doc, len(grams), key, first, bitmap(grams, bitmap_words(len(grams), percent)).tolist()))
            yield pd.DataFrame(rows, columns=["id", "n", "key", "first", "bits"])

    return make


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The whole sets of the texts whose id is a ``rep`` of ``ids`` (one row each), with its other columns: (..., grams binary).

    Up to ``MAX_BROADCAST_IDS`` ids are broadcast, so that the texts need not be shuffled.
    """
    columns = ids.columns
    if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)

    def read(batches):
        words = WordHashes()
        for pdf in batches:
            yield pdf[columns].assign(grams=[ngram_set(t, n, words).tobytes() for t in pdf["text"]])

    return docs.select(F.col("id").alias("rep"), "text").join(ids, "rep").select(*columns, "text").mapInPandas(trimmed(read), ", ".join(f"{c} long" for c in columns) + ", grams binary")
