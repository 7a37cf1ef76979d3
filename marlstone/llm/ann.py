"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length, padded to a power of two and turned by a
pseudo-rotation (three rounds of random signs and a fast Hadamard transform);
the nearest signed axis is their bucket. ``tables`` rotations give as many
tables. A query probes its ``probes`` nearest axes in each table, and all that
lies there is reranked by the exact inner product of the original vectors.

Plan: each vector is sent to its bucket of each table, each query to the groups
of buckets it probes; they meet in a cogroup by (table, group, chunk). Counts a
bucket (tables x axes numbers, so bounded) set how many chunks a group is cut
into, hence no task gets more than about ``chunk_rows`` vectors, and queries beyond ``query_rows`` are dealt into
parts that each meet all chunks, hence no task gets more than about that many of them. Where they meet, a block of
queries at a time is compared and cut to its k best, so what a task makes has a bound too. A group of
equal vectors is kept whole but for copies that cannot matter: of each distinct
vector only the k + 1 smallest ids can be among any query's k nearest, so others
are set aside before hashing (they still are queries). Ids are counted, not rows:
repeated rows go first, and every cut to k takes an id once. Queries that find fewer
than k then probe every axis of one table, which is a full search in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
numbers, and those not of the commonest length, take no part; nor do null ids.
A repeated id counts once as a query; a query is never its own neighbour, nor is
a row with its id. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm.common import materialise

TABLES, PROBES, GROUPS, CHUNK_ROWS, QUERY_ROWS, K, SLACK = 8, 16, 4, 65_536, 32_768, 20, 1e-9
#: Queries of a block, and products that are held at a time.
QUERY_BLOCK, PRODUCTS = 1024, 1 << 20


class CrossPolytope:
    """Rotations of one dimension; the same everywhere for the same seed."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = 17) -> None:
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    @property
    def axes(self) -> int:
        return 2 * self.width

    def rotate(self, vectors: np.ndarray, t: int) -> np.ndarray:
        x = np.zeros((len(vectors), self.width))
        x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for signs in self.signs[t]:
            x = x * signs
            h = 1
            while h < self.width:
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(vectors), self.width)
                h *= 2
            x /= np.sqrt(self.width)
        return x

    def bucket(self, rotated: np.ndarray) -> np.ndarray:
        axis = np.abs(rotated).argmax(1)
        return 2 * axis + (rotated[np.arange(len(rotated)), axis] < 0)

    def nearest(self, rotated: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest signed axes of each row."""
        both = np.stack([rotated, -rotated], 2).reshape(len(rotated), -1)
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    if vectors.select(v).dtypes[0][1] != "array<float>":  # floats are as exact as doubles and half as long; they are widened where they are used
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _score_bucket(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of v) of every pair that may be among a query's k best here, ties included."""
    near = q @ v.T
    near[qid[:, None] == vid[None, :]] = -np.inf
    order = np.argsort(vid, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(vid[order])) + 1]
    best = near if len(starts) == len(vid) else np.maximum.reduceat(near[:, order], starts, axis=1)  # a column an id
    if best.shape[1] > k:
        limit = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
    else:
        limit = np.full(len(q), -np.inf)
    return np.nonzero((near >= (limit - SLACK)[:, None]) & (near > -np.inf))


def _exact(q: np.ndarray, i: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of q and j of v, added from the first number on, so that equal vectors get equal scores."""
    out = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(q.T), v.T):
        out += x[i] * y[j]
    return out


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, an id once; ``distinct`` says that no id comes twice."""
    if not distinct:
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        once = np.r_[True, (np.diff(query) != 0) | (np.diff(vec) != 0)] if len(query) else np.zeros(0, bool)
        query, vec, score = query[once], vec[once], score[once]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[rank < k], vec[rank < k], score[rank < k]


def _meet(vectors: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the k best of each query among the vectors of the buckets it asks for."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(vectors) and len(asked):
        vectors = vectors.sort_values("b", kind="stable")
        x, vid, bucket = _matrix(vectors["v"]), vectors["id"].to_numpy(), vectors["b"].to_numpy()
        y, qid, wanted = _matrix(asked["v"]), asked["id"].to_numpy(), asked["buckets"].to_numpy()
        columns, distinct = np.asfortranarray(x), len(np.unique(vid)) == len(vid)
        starts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        for at in range(0, len(qid), QUERY_BLOCK):
            q, ids, lists = y[at : at + QUERY_BLOCK], qid[at : at + QUERY_BLOCK], wanted[at : at + QUERY_BLOCK]
            row, want = np.repeat(np.arange(len(ids)), [len(b) for b in lists]), np.concatenate(lists)
            here = []
            for first, end in zip(starts[:-1], starts[1:]):
                who, step = row[want == bucket[first]], max(1, PRODUCTS // (end - first))
                for part in (who[n : n + step] for n in range(0, len(who), step)):
                    i, j = _score_bucket(q[part], ids[part], x[first:end], vid[first:end], k)
                    pairs = ids[part[i]], vid[first + j], _exact(q, part[i], columns, first + j)
                    here.append(pairs if len(i) <= 2 * k * len(part) else _best(*pairs, k, distinct))  # more are ties, or vectors of one id
            if here:
                found.append(_best(*(np.concatenate(c) for c in zip(*here)), k, distinct))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*found)))))


def _sides(index: DataFrame, queries: DataFrame, cp: CrossPolytope, tables: range, probes: int, groups: int, chunk_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries by (t, g, c, p): table, group of buckets, chunk of its vectors, part of its queries."""
    per_group, kind = cp.axes // groups, index.schema["v"].dataType.simpleString()

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                for t in tables:
                    yield pd.DataFrame({"t": t, "b": cp.bucket(cp.rotate(x, t)), "id": pdf["id"], "v": pdf["v"]})

    def count(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                for t in tables:
                    g, n = np.unique(cp.bucket(cp.rotate(x, t)) // per_group, return_counts=True)
                    yield pd.DataFrame({"t": t, "g": g, "n": n})

    sizes = {(r["t"], r["g"]): r["n"] for r in index.select("v").mapInPandas(count, "t int, g int, n long").groupBy("t", "g").agg(F.sum("n").alias("n")).collect()}  # tables x groups rows
    chunks = {key: max(1, -(-n // chunk_rows)) for key, n in sizes.items()}
    parts = max(1, -(-queries.count() // query_rows))  # a group's queries are at most all, so a part of them has about query_rows

    def ask(batches):
        for pdf in batches:
            x = _matrix(pdf["v"]) if len(pdf) else None
            for t in tables if len(pdf) else ():
                rows = []
                for i, buckets in enumerate(cp.nearest(cp.rotate(x, t), probes)):
                    for g in np.unique(buckets // per_group).tolist():
                        rows.append((t, g, pdf["id"].iat[i], buckets[buckets // per_group == g].tolist(), pdf["v"].iat[i]))
                yield pd.DataFrame(rows, columns=["t", "g", "id", "buckets", "v"])

    many = F.create_map(*[x for (t, g), n in chunks.items() for x in (F.lit(t * groups + g), F.lit(n))]) if chunks else F.create_map(F.lit(0), F.lit(1))
    chunks_here = many[F.col("t") * groups + F.col("g")]
    left = index.mapInPandas(deal, f"t int, b int, id long, v {kind}").withColumn("g", (F.col("b") / per_group).cast("int")).withColumn("c", F.pmod(F.xxhash64("id"), chunks_here).cast("int"))
    spread = queries.repartition(queries.sparkSession.sparkContext.defaultParallelism, "id")  # few rows, but each is turned in every table
    right = spread.mapInPandas(ask, f"t int, g int, id long, buckets array<int>, v {kind}").withColumn("c", F.explode(F.sequence(F.lit(0), chunks_here - 1)))
    right = right.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return left.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)), right


def _search(index: DataFrame, queries: DataFrame, cp: CrossPolytope, tables: range, probes: int, groups: int, chunk_rows: int, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, vec_id, score) of each query's best in each group of buckets probed."""
    left, right = _sides(index, queries, cp, tables, probes, groups, chunk_rows, query_rows)

    return left.groupBy("t", "g", "c", "p").cogroup(right.groupBy("t", "g", "c", "p")).applyInPandas(lambda vectors, asked: _meet(vectors, asked, k), "query_id long, vec_id long, score double")


def _top(parts: DataFrame, k: int) -> DataFrame:
    once = parts.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, groups: int = GROUPS, chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (of the id) holds."""
    usable = _usable(vectors, id_col, vector_col)
    lengths = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not lengths:
        return usable.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["n"]
    usable = usable.where(F.size("v") == dim)
    queries = usable.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    copies = W.partitionBy("v").orderBy("id")
    index = materialise(usable.distinct().withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).drop("nth"), "ann-index")
    cp = CrossPolytope(dim, tables)
    top = materialise(_top(_search(index, queries, cp, range(tables), min(probes, cp.axes), groups, chunk_rows, k, query_rows), k), "ann-top")
    found = top.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    short = materialise(queries.join(found, "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "v"), "ann-short")
    if not short.isEmpty():
        rest = _top(_search(index, short, cp, range(1), cp.axes, groups, chunk_rows, k, query_rows), k)
        top = top.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return top.select("query_id", "rank", "vec_id", "score")
