"""Conflict-constrained best-fit packing of documents into fixed-size bins.

A bin holds pieces of at most ``capacity`` units in all and takes no two
documents of one source nor of one duplicate cluster. A document longer than a bin is cut into whole-bin
pieces, each a bin of its own, and a rest that is packed like any other.

Documents are dealt by a hash of their id over shards of about ``shard_docs``
rows, and each shard is packed by itself (best fit, decreasing): no task ever
holds more than a shard, whatever the size of a source or a cluster. The number
of shards follows the number of documents. In a shard, sources and clusters
with more than one document get a bit; each open bin carries the bitmaps of
what it holds. Open bins are kept in order of what room they have left. The
search for a piece starts at the least room that fits and goes on to the next
larger one until a bin has no bit in common with the piece; so it ends at the
tightest compatible bin. Bins with equal room and bitmaps are kept together, so
a step of the search passes all of them at once.

Defined cases: null or empty texts have length 0 and take a slot without room;
a null source or cluster never conflicts; equal lengths go by id, then by the
rows' order of source; a row given twice is packed twice (its copies conflict
if they have a source or cluster); a null id is packed like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192  # code points, about 2,048 tokens of four
SHARD_DOCS = 2048

SCHEMA = "bin_id string, slot int, doc_id long, piece int, start long, length long, bin_length long"


class Packer:
    """Best-fit bins of one shard, ordered by room left.

    ``rooms`` lists (room, sources, clusters) of the kinds of open bins in order;
    ``bins`` has the bins of each kind.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rooms, self.bins, self.n_bins, self.steps = capacity, [], defaultdict(list), 0, 0

    def _put(self, bin_no: int, kind: tuple[int, int, int]) -> None:
        if kind not in self.bins or not self.bins[kind]:
            insort(self.rooms, kind)
        self.bins[kind].append(bin_no)

    def add(self, size: int, sources: int, clusters: int) -> int:
        """The number of the bin that takes a piece with these bits."""
        at = bisect_left(self.rooms, (size, -1, -1))
        while at < len(self.rooms):
            room, s, c = kind = self.rooms[at]
            self.steps += 1
            if not (s & sources or c & clusters):
                held = self.bins[kind]
                bin_no = held.pop()
                if not held:
                    del self.rooms[at], self.bins[kind]
                self._put(bin_no, (room - size, s | sources, c | clusters))
                return bin_no
            at += 1
        bin_no, self.n_bins = self.n_bins, self.n_bins + 1
        self._put(bin_no, (self.capacity - size, sources, clusters))
        return bin_no


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs more than once; 0 for others and None."""
    n = Counter(v for v in values if v is not None)
    bit: dict = {}
    return [1 << bit.setdefault(v, len(bit)) if v is not None and n[v] > 1 else 0 for v in values]


def pack_shard(rows: list[tuple], capacity: int) -> Iterator[tuple]:
    """(bin, doc_id, piece, start, length) of rows (doc_id, length, source, cluster) of one shard."""
    rows = sorted(rows, key=lambda r: (-(r[1] % capacity or (capacity if r[1] else 0)), r[0] is None, r[0], r[2] or "", r[3] or 0))
    sources, clusters = _bits([r[2] for r in rows]), _bits([r[3] for r in rows])
    packer, whole = Packer(capacity), 0
    for (doc, length, _, _), s, c in zip(rows, sources, clusters):
        pieces = max(1, -(-length // capacity))
        for k in range(pieces - 1):
            whole += 1
            yield -whole, doc, k, k * capacity, capacity
        start = (pieces - 1) * capacity
        yield packer.add(length - start, s, c), doc, pieces - 1, start, length - start


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a piece: bin_id, slot in the bin, doc_id, piece, start, length, bin_length.

    ``length`` defaults to the code points of ``text``; with token counts as
    ``length`` a bin is so many tokens and start counts tokens. ``cluster`` is a
    long or null; it defaults to a hash of the text without case and white space.
    """
    length = F.coalesce(F.length("text"), F.lit(0)) if length is None else length
    source = F.col("source") if source is None else source
    cluster = text_cluster(F.col("text")) if cluster is None else cluster
    shards = max(1, -(-docs.count() // shard_docs))
    deal = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(11)), F.lit(shards))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("length"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"), deal.alias("shard"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("doc_id", "length", "source", "cluster")]
        rows = [(None if d is None else int(d), int(n), s, None if c is None else int(c)) for d, n, s, c in zip(*columns)]
        out = pd.DataFrame(pack_shard(rows, capacity), columns=["bin", "doc_id", "piece", "start", "length"])
        out["bin_length"] = out.groupby("bin")["length"].transform("sum")
        out["slot"] = out.groupby("bin").cumcount().astype("int32")
        out["bin_id"] = [f"{key[0]}-{b}" if b >= 0 else f"{key[0]}-w{-b}" for b in out["bin"]]
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out[["bin_id", "slot", "doc_id", "piece", "start", "length", "bin_length"]]

    return narrow.groupBy("shard").applyInPandas(pack, SCHEMA)


def text_cluster(text: Column) -> Column:
    """The exact-copy cluster of a text, regardless of case and white space; null if it has no other characters."""
    bare = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.when(F.length(bare) > 0, F.xxhash64(bare))
