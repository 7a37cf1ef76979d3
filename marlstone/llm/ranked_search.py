"""Ranked lexical search: the k best documents of every item, by the best position algorithm.

Each term of an item has an impact list: the documents that hold it, by falling share of the
score. Lists are read in step from the top (sorted access); a document met for the first time is looked
up in the item's other lists (direct access), which gives its whole score and marks its place in each. A list's
*best position* is the last of its places that have all been seen. No unseen document has
more than the sum of the impacts there, and that sum falls faster than that of the last
places read, for places marked by direct access count as well. The search ends once that sum is strictly
below the k-th best score, so ties are never cut off.

Plan
1. One pass over the texts: a document's number of terms, and how often it holds each term of the items. No
   text is shuffled; what is left of a document is written to the shared folder.
2. Document frequencies (combined before the shuffle), number and lengths of documents; the weights follow.
3. Each task takes what is left of its documents in shards of bounded size, makes the impact lists of
   a shard and runs the algorithm for each item. The k best so far go on from shard to
   shard, so later shards stop early. A task gives k rows an item, and a window ranks them.

Items are taken in blocks of at most ``block_bytes`` of text, each with a pass of its own, so
that the terms that a task must know are bounded whatever the number of items.

Defined cases: a term is a run of letters and digits of ASCII and of all other characters beyond ASCII; only
A-Z are lower-cased. Null and empty texts have no term: such a document counts nowhere, such an item has no rows.
Each row of documents is a document; rows with a null id come last among equal scores. Rows of items with the same id are one
item with the terms of all; a null item id is an id as any other. No documents or no items: no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm.common import materialise, trimmed

K, BLOCK_BYTES, SHARD_ROWS, SHARD_CELLS, STEP = 50, 16 << 20, 16_384, 1 << 22, 32
NO_ID = (1 << 63) - 1

#: A-Z in lower case, what separates terms as blanks; bytes beyond ASCII stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def _items(items: DataFrame, item_col: str, text_col: str, block: int, blocks: int) -> list[tuple[int | None, list[bytes]]]:
    """(id, terms) of each item of the block; at most about BLOCK_BYTES come to the driver."""
    rows = items.where(F.pmod(F.coalesce(F.xxhash64(item_col), F.lit(0)), F.lit(blocks)) == block).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("x"))
    found: dict = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["i"], set()).update(terms_of(r["x"]))
    return [(i, sorted(found[i])) for i in sorted(found, key=lambda i: (i is None, i or 0)) if found[i]]


def term_counts(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, term array, tf array): a row a document with terms; term numbers are places in ``terms``."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            ids, ns, lists, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    held = [(number[t], n) for t, n in Counter(words).items() if t in number]
                    ids.append(doc_id)
                    ns.append(len(words))
                    lists.append([i for i, _ in held])
                    tfs.append([n for _, n in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0).mapInArrow(trimmed(count), "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Impact lists of a block of documents: for each term its documents (by place in the block), highest impact first."""

    def __init__(self, doc_ids: np.ndarray, damp: np.ndarray, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray, weights: np.ndarray) -> None:
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + damp[docs]))
        order = np.lexsort((doc_ids[docs], -impact, terms))
        self.doc_ids, self.docs, self.impact = doc_ids, docs[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def lists(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        return [(self.docs[c], self.impact[c]) for c in cuts if c.stop > c.start]


def best_positions(lists: list[tuple[np.ndarray, np.ndarray]], doc_ids: np.ndarray, best: list[tuple[int, int]], k: int, step: int = STEP) -> int:
    """Adds a shard's documents to ``best``, a heap of the k best (score, -doc_id); returns how many were looked up.

    Lists are read ``step`` places at a time.
    """
    n, m = len(doc_ids), len(lists)
    place = np.full((m, n), -1, np.int32)
    impact = np.zeros((m, n), np.int64)
    for i, (docs, points) in enumerate(lists):
        place[i, docs] = np.arange(len(docs))
        impact[i, docs] = points
    known = np.zeros(n, bool)
    marked = [np.zeros(len(docs) + 1, bool) for docs, _ in lists]  # the last is never marked: a place to stop at
    upto = np.zeros(m, np.int64)  # places before these are all marked
    looked_up = 0
    for at in range(0, max((len(docs) for docs, _ in lists), default=0), step):
        new = np.unique(np.concatenate([docs[at : at + step] for docs, _ in lists]))
        new = new[~known[new]]
        known[new] = True
        looked_up += len(new)
        points = impact[:, new].sum(0)
        worth = points >= best[0][0] if len(best) >= k else points > 0
        for score, doc in zip(points[worth].tolist(), doc_ids[new[worth]].tolist()):
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            elif (score, -doc) > best[0]:
                heapq.heapreplace(best, (score, -doc))
        bound = 0
        for i, (docs, points) in enumerate(lists):
            there = place[i, new]
            marked[i][there[there >= 0]] = True
            upto[i] += int(np.argmin(marked[i][upto[i] :]))
            if upto[i] < len(docs):
                bound += int(points[max(0, upto[i] - 1)])
        if len(best) >= k and bound < best[0][0]:
            break
    return looked_up


def _search(counts: DataFrame, items: list[tuple[int | None, list[bytes]]], number: dict[bytes, int], weights: np.ndarray, n_docs: int, length: int, k: int, shard_rows: int, shard_cells: int) -> DataFrame:
    """(item, doc_id, score): k rows an item from each task."""
    shared = counts.sparkSession.sparkContext.broadcast(([np.array([number[t] for t in terms], np.int64) for _, terms in items], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            ids, ns, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            damp = np.array([20 * (50 + (50 * n * n_docs) // length) for n in ns.tolist()], np.int64)
            shard = Shard(ids, damp, terms, np.repeat(np.arange(len(ids)), sizes), tfs, w)
            for heap, own in zip(best, wanted):
                lists = shard.lists(own)
                rows = max(1, shard_cells // max(1, len(lists)))
                for lo in range(0, len(ids), rows):  # items of very many terms take their documents in parts
                    part = lists if rows >= len(ids) else [(d[c] - lo, p[c]) for d, p in lists if (c := (d >= lo) & (d < lo + rows)).any()]
                    best_positions(part, ids[lo : lo + rows], heap, k)

        rows = cells = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                terms, tfs = part.column(2), part.column(3)
                held.append((ids, part.column(1).to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
                rows, cells = rows + len(ids), cells + len(held[-1][3])
                if rows >= shard_rows or cells >= shard_cells:
                    search()
                    rows = cells = 0
        if held:
            search()
        found = [(i, None if doc == -NO_ID else -doc, score) for i, heap in enumerate(best) for score, doc in heap]
        cols = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

    return counts.select("doc_id", "n", "terms", "tfs").mapInArrow(trimmed(run), "item int, doc_id long, score long")


def best_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_rows: int = SHARD_ROWS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, scores above 0."""
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        asked = _items(items, item_col, item_text_col, block, blocks)
        number = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
        counts = materialise(term_counts(docs, list(number), id_col, text_col), "term-counts")
        total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        if not number or not total["n"]:
            continue
        weights = np.zeros(len(number), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # a row a term of the block
            weights[r["t"]] = weight(total["n"], r["df"])
        found = _search(counts, asked, number, weights, total["n"], total["terms"], k, shard_rows, shard_cells)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked)], "item int, item_id long")
        out = out.unionByName(top.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE = r"""
WITH words AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), damped AS (
  SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM lengths, total
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN damped USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
