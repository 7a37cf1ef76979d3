"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors of its features: each word, each pair
of neighbouring words (a pair of one word twice, or the same word two to four
places on, is one feature for all words), and each run of three or four
characters inside a word with its edges. Features are hashed to ``buckets`` rows. A linear layer with softmax over the two classes
stands on the mean; vectors and layer are trained together by stochastic
gradient descent in numpy, on hashed features that executors extract from a
bounded sample (``max_train`` documents, and of these, in the order of their hashes, as many as
bring at most ``max_bytes`` of features to the driver).

Since the layer is linear, its difference of logits for a mean of vectors is the
mean of the vectors' own differences; so scoring needs one number a bucket, not
a vector. Whole texts are scored, in slices of bounded size.

Defined cases: a null or empty text, or one of white space, has no features and
gets the model's bias. Labels, lang, source and ids are no inputs. If the sample
has no rows or one class only, every score is that class's share (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

from marlstone.llm.common import materialise, trimmed
from marlstone.llm.labelled import training_rows

BUCKETS, DIM, GRAMS, REPEATS, EPOCHS, RATE, MAX_TRAIN, MAX_BYTES, SLICE = 1 << 16, 16, (3, 4), (1, 2, 3, 4), 5, 1.0, 4000, 200_000_000, 1 << 18
THRESHOLD = 0.3
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0], dtype=np.uint32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


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


def features(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of the features of each slice of a text."""
    for part in _slices(text):
        c = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(np.isin(c, _SPACES), np.uint32(32), c).astype(np.uint64)
        blank = c == 32
        starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        if not len(starts):
            continue
        place = (np.arange(len(c)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(c)]))).astype(np.uint64)
        power = (place + np.uint64(1)) * _MULT[0] ^ (place << np.uint64(17))
        sums = np.r_[np.uint64(0), np.cumsum(c * (power | np.uint64(1)), dtype=np.uint64)]
        words = sums[ends] - sums[starts] + np.uint64(1)
        out = [_bucket(words, buckets), _bucket(words[:-1] * _MULT[1] + words[1:], buckets)]
        for back in REPEATS:
            again = np.count_nonzero(words[back:] == words[:-back])
            out.append(_bucket(np.full(again, back, np.uint64), buckets))
        for n in GRAMS:
            if len(c) < n:
                continue
            windows = len(c) - n + 1
            h = np.zeros(windows, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + c[k : k + windows] * _MULT[k]
            inner = np.zeros(windows, bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + windows]
            out.append(_bucket((h + np.uint64(n))[~inner], buckets))
        yield np.concatenate(out)


def counted(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    total = np.zeros(buckets, np.int64)
    for ids in features(text, buckets):
        total += np.bincount(ids, minlength=buckets)
    ids = np.flatnonzero(total)
    return ids, total[ids] / max(1, total.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(number a bucket, bias): the difference of the two classes' logits."""
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return np.zeros(buckets, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share, label = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = share.astype(np.float32) @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[label] -= 1
            if len(ids):
                # A share-weighted step a bucket, scaled as if each feature had been stepped by itself.
                vectors[ids] -= np.minimum(1.0, share * len(ids))[:, None].astype(np.float32) * (lr * (slope @ layer))
            layer -= lr * np.outer(slope, mean)
            bias -= 0.1 * lr * slope
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def within_bytes(sample: DataFrame, max_bytes: int, buckets: int) -> DataFrame:
    """The first documents of a sample by hash, whose features take at most ``max_bytes``: eight
    bytes a bucket, and a text has at most four features a character."""
    most = 8 * F.least(F.lit(buckets), 4 * F.length("text") + 4).cast("long")
    order = W.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")  # ids and lengths of a bounded sample, in one task
    sizes = sample.select("doc_id", most.alias("most")).withColumn("used", F.sum("most").over(order)).where(F.col("used") <= max_bytes)
    return sample.join(F.broadcast(sizes.select("doc_id")), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, buckets: int = BUCKETS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    def extract(batches):
        for pdf in batches:
            found = [counted(t, buckets) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [i.astype("<u4").tobytes() for i, _ in found], "shares": [s.astype("<f4").tobytes() for _, s in found], "y": pdf["y"]})

    sample = within_bytes(materialise(training_rows(docs, labels, label, max_train), "quality-sample"), max_bytes, buckets)
    got = sample.mapInPandas(trimmed(extract), "doc_id long, ids binary, shares binary, y int").toPandas().sort_values("doc_id", kind="stable")
    return train([(np.frombuffer(i, "<u4"), np.frombuffer(s, "<f4"), int(y)) for i, s, y in zip(got["ids"], got["shares"], got["y"])], buckets)


def raw_score(text: str | None, values: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for ids in features(text or "", len(values)):
        total, n = total + float(values[ids].sum(dtype=np.float64)), n + len(ids)
    return float(1 / (1 + np.exp(-np.clip(total / max(1, n) + bias, -50, 50))))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the score and its prediction."""
    held, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]  # buckets numbers: 256 KB

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def work(parts):
            values = held.value
            for texts in parts:
                yield pd.Series([raw_score(t, values, bias) for t in texts], dtype="float64")

        yield from trimmed(work)(batches)

    return docs.withColumn(score_col, score(text_col)).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
