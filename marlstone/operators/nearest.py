"""Exact k-nearest search by matrix products over blocks, without pairs of rows as rows.

A few queries, up to MAX_QUERIES and MAX_BYTES (checked), go to every task: each takes its vectors
a batch at a time, multiplies batch and queries, and keeps each query's k best so far, whose
worst is the bound that later batches must pass. Vectors are not shuffled; a task gives k rows a query.

More queries are joined in blocks. Vectors go to the nearest of some pivots (a bounded sample), and those of a pivot
into rings by their distance from it, so a block is a pivot, a least and a largest distance. By the triangle
inequality a block at pivot distance d from a query has nothing nearer than d - largest or least - d, and all its vectors
are within d + largest. The sizes of blocks so give each query a radius that holds k vectors, and
only blocks that reach into it are visited. Blocks beyond ``block_rows`` vectors are dealt out, and the queries of a block
are too, so a task has at most about ``block_rows`` of one and ``query_rows`` of the other. Where a sample shows that bounds would pass over
little (vectors that lie evenly), rows are dealt by their ids into a grid instead: each part of the queries meets each part of the vectors in
a task of its own. That is every pair, but a query is sent to as few parts as there can be and not to every pivot.

Scores of what is kept are added up from the first number on, so equal vectors score alike wherever they are. Nearness
is cosine (``l2`` off) or Euclidean distance. Vectors that are null, hold null or are not as long as the query's are no
candidates; under cosine, nor are zero vectors and those with NaN or infinite numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vector
from marlstone.operators.filters import top_per_group

MAX_QUERIES, MAX_BYTES = 10_000, 64 << 20
#: Products are made of so many queries and vectors at a time, and so many pairs are added up: these bound what a task holds beside its input.
QUERY_BLOCK, VECTOR_BLOCK, HITS = 512, 2_048, 16_384
PIVOTS, RINGS, RING_ROWS, BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS, SLACK = 64, 16, 16_384, 65_536, 65_536, 2_048, 1e-9
#: Vectors that pivots are taken from, and the share of them within bounds from which on all are visited.
SAMPLE, EVEN = 2_048, 0.5


def _usable(rows: DataFrame, id_col: str, vector_col: str, by: tuple[str, ...], l2: bool) -> DataFrame:
    """(id, by, v, width). Tests of the width are of the column as given: one of ``v`` would be moved below the division by the length and find that again for each number."""
    named = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), *by, F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("width"))
    if l2:
        return named.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    return vector.only_unit_vectors(named, "v")


def _sums(a: np.ndarray, b: np.ndarray, l2: bool) -> np.ndarray:
    """Cosines or distances of rows, added in the order of the numbers."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2 if l2 else a[:, j] * b[:, j]
    return np.sqrt(out) if l2 else out


def _nearness(q: np.ndarray, v: np.ndarray, l2: bool) -> np.ndarray:
    """Larger is nearer: the cosine, or less the squared distance."""
    near = q @ v.T
    return 2 * near - (q * q).sum(1)[:, None] - (v * v).sum(1)[None, :] if l2 else near


def _rough(v: np.ndarray, l2: bool) -> tuple[np.ndarray, float]:
    """Vectors for finding what may be near, and by how much products of them may be off: unit vectors go in single precision; all that is kept is added up in double."""
    return (v, SLACK) if l2 else (v.astype(np.float32), SLACK + (v.shape[1] + 8) * 2.0**-23)


def pairs_above(q: np.ndarray, v: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of v, cosine) of the pairs of unit vectors of at least ``least``, and of some a little below, at most HITS at a time."""
    rough, off = _rough(v, False)
    mine, _ = _rough(q, False)
    for a in range(0, len(q), QUERY_BLOCK):
        for b in range(0, len(v), VECTOR_BLOCK):
            part = rough[b : b + VECTOR_BLOCK]
            i, j = np.divmod(np.flatnonzero(mine[a : a + QUERY_BLOCK] @ part.T >= least - off), len(part))
            for at in range(0, len(i), HITS):
                x, y = i[at : at + HITS] + a, j[at : at + HITS] + b
                yield x, y, _sums(q[x], v[y], False)


class Best:
    """The k best of each query so far."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, l2: bool, least: float | None, other: bool) -> None:
        self.qid, self.q, self.k, self.l2, self.least, self.other = qid, q, k, l2, least, other
        start = -np.inf if least is None else least
        self.bound = np.full(len(q), start, dtype=float)
        self.rough, _ = _rough(q, l2)
        self.index = pd.Index(qid) if other else None
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        for at in range(0, len(ids), VECTOR_BLOCK):
            self._add(ids[at : at + VECTOR_BLOCK], v[at : at + VECTOR_BLOCK])

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that are a query's own, if these don't count; ids are looked up, not compared with all."""
        if self.index is None:
            return np.zeros(0, int), np.zeros(0, int)
        if not self.index.is_unique:
            same = pd.DataFrame({"id": self.qid, "at": np.arange(len(self.qid))}).merge(pd.DataFrame({"id": ids, "own": np.arange(len(ids))}), on="id")
            return same["at"].to_numpy(), same["own"].to_numpy()
        at = self.index.get_indexer(ids)
        own = np.flatnonzero(at >= 0)
        return at[own], own

    def _add(self, ids: np.ndarray, v: np.ndarray) -> None:
        rough, off = _rough(v, self.l2)
        mine, own = self._own(ids)
        for at in range(0, len(self.q), QUERY_BLOCK):
            part = slice(at, at + QUERY_BLOCK)
            near = _nearness(self.rough[part], rough, self.l2)
            there = (mine >= at) & (mine < at + QUERY_BLOCK)
            near[mine[there] - at, own[there]] = -np.inf
            slack = SLACK * (1 + np.abs(near).max(initial=0, where=np.isfinite(near))) if self.l2 else off
            rows = np.flatnonzero(near.max(1) >= self.bound[part] - slack)  # most queries have nothing new in most blocks
            near, limit = near[rows], (self.bound[part] - slack)[rows].astype(near.dtype)
            hit = (near >= limit[:, None]) & (near > -np.inf)
            if len(ids) > self.k and hit.sum() > 4 * self.k * len(rows):
                worst = np.partition(near, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - near.dtype.type(slack)
                self.bound[part.start + rows] = np.maximum(self.bound[part.start + rows], worst)
                hit = (near >= np.maximum(limit, worst - near.dtype.type(slack))[:, None]) & (near > -np.inf)
            i, j = np.divmod(np.flatnonzero(hit), len(ids))
            for first in range(0, len(i), HITS):
                x, y = rows[i[first : first + HITS]] + at, j[first : first + HITS]
                self.held.append((x, ids[y], _sums(self.q[x], v[y], self.l2)))
                self.size += len(x)
            if self.size > 2 * self.k * len(self.q) + 100_000:
                self.cut()

    def cut(self) -> None:
        """Keeps the k best, of equal ones the smaller ids, and moves the bounds up to the worst of these."""
        i, ids, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if self.least is not None and not self.l2:
            keep = score >= self.least
            i, ids, score = i[keep], ids[keep], score[keep]
        order = np.lexsort((ids, score if self.l2 else -score, i))
        i, ids, score = i[order], ids[order], score[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        last = rank == self.k - 1
        self.bound[i[last]] = np.maximum(self.bound[i[last]], -(score[last] ** 2) if self.l2 else score[last])
        keep = rank < self.k
        self.held, self.size = [(i[keep], ids[keep], score[keep])], int(keep.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.cut()
        i, ids, score = self.held[0]
        return self.qid[i], ids, score


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have vectors of this width, these vectors)."""
    v = batch.column(batch.schema.get_field_index(name))
    fits = np.flatnonzero(v.value_lengths().to_numpy(zero_copy_only=False) == width)
    return fits, v.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _types(known: DataFrame, asked: DataFrame, by: tuple[str, ...]) -> str:
    kinds = dict(known.dtypes)
    return ", ".join([f"query_id {dict(asked.dtypes)['id']}", f"id {kinds['id']}", *(f"`{c}` {kinds[c]}" for c in by), "score double"])


def _scan(known: DataFrame, asked: DataFrame, held: pd.DataFrame, k: int, by: tuple[str, ...], l2: bool, least: float | None, other: bool, within: str | None = None) -> DataFrame:
    apart = held.assign(_width=held["v"].map(len)).groupby(["_width", *([within] if within else [])])
    sets = [(key[0], key[1:], part["id"].to_numpy(), np.stack(part["v"].to_numpy())) for key, part in apart]
    shared = known.sparkSession.sparkContext.broadcast(sets)  # at most MAX_BYTES
    schema = _types(known, asked, by)
    names = ["query_id", "id", *by, "score"]
    arrow = {f.name: f.dataType for f in known.select(*by).schema}
    split = [within] if within else list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best: dict[tuple, Best] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            groups = pd.DataFrame({c: batch.column(n + 1).to_pylist() for n, c in enumerate(split)}) if split else None
            for width, value, qid, q in shared.value:
                fits, v = _matrix(batch, "v", width)
                parts = [((), np.arange(len(fits)))] if not split else [(key if isinstance(key, tuple) else (key,), at) for key, at in groups.iloc[fits].reset_index(drop=True).groupby(split, dropna=False).indices.items()]
                for key, at in parts:
                    if len(at) and (not within or key == value):
                        found = best.get((width, key))
                        if found is None:
                            found = best[width, key] = Best(qid, q, k, l2, least, other)
                        found.add(ids[fits][at], v[at])
        for (_, key), found in best.items():
            qid, ids, score = found.rows()
            fixed = [pa.array([None if pd.isna(x) else x] * len(ids), to_arrow_type(arrow[c])) for x, c in zip(key, by)]
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids), *fixed, pa.array(score)], names)

    return known.select("id", *split, "v").mapInArrow(run, schema)


# ---------------------------------------------------------------- many queries


def met_by_keys(left: DataFrame, right: DataFrame, keys: list[str], meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = RING_ROWS) -> DataFrame:
    """``meet`` of the rows of both sides (with ``id``) that agree in ``keys``, a table of about ``rows`` of each at a time. Where a key has more of one side,
    these are dealt out and the other side's are repeated for each part. The tasks are stated: they are as large as the pairs they make and not as their input.
    """
    from marlstone.operators.strategies import checked_broadcast

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    sizes = checked_broadcast(parts(left, "_lefts").join(parts(right, "_rights"), keys))

    def dealt(side: DataFrame, mine: str, others: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(f"_{mine}s")).cast("int")
        out = side.join(sizes, keys).withColumn(f"_{mine}", part).withColumn(f"_{others}", F.explode(F.sequence(F.lit(0), F.col(f"_{others}s") - 1)))
        return out.select(*(F.col(c).alias(c) for c in [*side.columns, "_left", "_right"]))  # columns of its own, for both sides may come from one table

    at = [*keys, "_left", "_right"]
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.repartition(tasks, *at).groupBy(*at) for side in (dealt(left, "left", "right"), dealt(right, "right", "left")))
    return a.cogroup(b).applyInArrow(meet, schema)


def by_width(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(which rows, their vectors ``v``) of each length of vectors."""
    if not t.num_rows:
        return {}
    batch = t.select(["v"]).combine_chunks().to_batches()[0]
    return {int(w): _matrix(batch, "v", w) for w in np.unique(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))}


def _within(known: DataFrame, asked: DataFrame, k: int, l2: bool, least: float | None, other: bool, within: str) -> DataFrame:
    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        (qid, ids), mine = (t.column("id").combine_chunks() for t in (queries, vectors)), by_width(queries)
        for width, (at, v) in by_width(vectors).items():
            if width in mine:
                best = Best(qid.to_numpy(zero_copy_only=False)[mine[width][0]], mine[width][1], k, l2, least, other)
                best.add(ids.to_numpy(zero_copy_only=False)[at], v)
                a, b, score = best.rows()
                out.append(pa.table({"query_id": pa.array(a, qid.type), "id": pa.array(b, ids.type), "score": pa.array(score, pa.float64())}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], qid.type), "id": pa.array([], ids.type), "score": pa.array([], pa.float64())})

    return met_by_keys(asked, known, [within], meet, _types(known, asked, ()))


def _visited(v: np.ndarray, chosen: np.ndarray, total: int, k: int, reach: float) -> float:
    """The share of a sample that lies in blocks within reach of its rows: what bounds by pivots would leave to visit."""
    d = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (chosen * chosen).sum(1)[None, :] - 2 * v @ chosen.T))
    cell = d.argmin(1)
    far = d[np.arange(len(d)), cell]
    cells = np.unique(cell)
    n, lo, hi = (np.array([f(far[cell == c]) for c in cells]) for f in (len, np.min, np.max))
    shares = []
    for at in d[: SAMPLE // 8, cells]:
        outer = np.argsort(at + hi, kind="stable")
        held = np.searchsorted(np.cumsum(n[outer]) * total / len(v), k)
        radius = min(reach, (at + hi)[outer[held]] if held < len(outer) else np.inf)
        shares.append(n[np.maximum(at - hi, lo - at) <= radius].sum() / len(v))
    return float(np.mean(shares))


def _grid(known: DataFrame, asked: DataFrame, width: int, total: int, k: int, l2: bool, least: float | None, other: bool, block_rows: int, query_rows: int) -> tuple[DataFrame, dict]:
    """(query_id, id, score) of each query's best in each part of the vectors. A task is a part of each side: at least so many that all cores have some, and more where parts would be too large."""
    queries = asked.count()
    parts = int(np.ceil(np.sqrt(4 * int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    lefts, rights = (max(1, -(-n // rows), min(parts, n // LEAST_ROWS)) for n, rows in ((queries, query_rows), (total, block_rows)))
    hashed = F.xxhash64("id")
    a = asked.select(F.col("id").alias("query_id"), "v", F.pmod(hashed, F.lit(lefts)).cast("int").alias("part"))
    b = known.select("id", "v", F.pmod(hashed, F.lit(rights)).cast("int").alias("part"))
    kind_q, kind = dict(a.dtypes)["query_id"], dict(b.dtypes)["id"]
    a = a.select("query_id", F.lit(None).cast(kind).alias("id"), "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rights - 1)), lambda x: F.col("part") * rights + x)).alias("cell"), F.lit(True).alias("asks"))
    b = b.select(F.lit(None).cast(kind_q).alias("query_id"), "id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(lefts - 1)), lambda x: x * rights + F.col("part"))).alias("cell"), F.lit(False).alias("asks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for side, rows in held.items():
                at = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False) == side)
                if len(at):
                    rows.append((batch.column(0 if side else 1).take(pa.array(at)), _matrix(batch, "v", width)[1][at]))
        if held[True] and held[False]:
            qid, q = pa.concat_arrays([x for x, _ in held[True]]), np.concatenate([x for _, x in held.pop(True)])
            best = Best(qid.to_numpy(zero_copy_only=False), q, k, l2, least, other)
            for ids, v in held[False]:
                best.add(ids.to_numpy(zero_copy_only=False), v)
            i, ids_, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(i, qid.type), pa.array(ids_, held[False][0][0].type), pa.array(score, pa.float64())], ["query_id", "id", "score"])

    met = a.unionByName(b).repartitionById(lefts * rights, "cell").select("query_id", "id", "v", "asks")
    return met.mapInArrow(meet, _types(known, asked, ())), {"blocks": rights, "visits": queries * rights, "possible": queries * rights}


def _blocked(known: DataFrame, asked: DataFrame, k: int, l2: bool, least: float | None, other: bool, pivots: int, block_rows: int, query_rows: int) -> tuple[DataFrame, dict]:
    """(query_id, id, score) of each query's best in each block visited, and how many blocks were visited."""
    width = known.groupBy(F.col("width").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return known.sparkSession.createDataFrame([], _types(known, asked, ())), {"blocks": 0, "visits": 0, "possible": 0}
    known, asked = (x.where(F.col("width") == width["n"]).drop("width") for x in (known, asked))
    sample = np.array([r["v"] for r in known.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    chosen = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])][:pivots]
    enough = k + (1 if other else 0)
    reach = np.inf if least is None or l2 else np.sqrt(max(0.0, 2 - 2 * least))
    if _visited(sample, chosen, width["count"], enough, reach) >= EVEN:
        return _grid(known, asked, width["n"], width["count"], k, l2, least, other, block_rows, query_rows)

    def distances(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (chosen * chosen).sum(1)[None, :] - 2 * v @ chosen.T))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_matrix(batch, "v", width["n"])[1])
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "far"])

    kind = dict(known.dtypes)["id"]
    placed = known.select("id", "v").mapInArrow(place, f"id {kind}, v array<double>, cell int, far double")
    steps = [i / RINGS for i in range(1, RINGS)]
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", steps).alias("cuts")).collect()}  # a row a pivot
    cuts = F.create_map(*[x for c, r in cells.items() for x in (F.lit(c), F.array(*[F.lit(float(y)) for y in (r["cuts"] if r["n"] > block_rows else [])]).cast("array<double>"))])
    ring = F.size(F.filter(cuts[F.col("cell")], lambda y: y < F.col("far")))
    ringed = placed.withColumn("ring", ring)
    sizes = {(r["cell"], r["ring"]): -(-r["n"] // block_rows) for r in ringed.groupBy("cell", "ring").agg(F.count("*").alias("n")).collect()}  # RINGS rows a pivot
    salts = F.create_map(*[x for (c, r), n in sizes.items() for x in (F.lit(c * RINGS + r), F.lit(n))])
    ringed = ringed.withColumn("salt", F.pmod(F.xxhash64("id"), salts[F.col("cell") * RINGS + F.col("ring")]).cast("int"))
    stats = ringed.groupBy("cell", "ring", "salt").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("cell", "ring", "salt").toPandas()  # a row a block
    cell, n, lo, hi = (stats[c].to_numpy() for c in ("cell", "n", "lo", "hi"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blocks = [], []
            d = distances(_matrix(batch, "v", width["n"])[1])
            for i in range(len(d)):
                at = d[i, cell]
                outer = np.argsort(at + hi, kind="stable")
                held = np.searchsorted(np.cumsum(n[outer]), enough)
                radius = min(reach, (at + hi)[outer[held]] if held < len(outer) else np.inf)
                near = np.flatnonzero(np.maximum(at - hi, lo - at) <= radius + 1e-6 * (1 + abs(radius) if np.isfinite(radius) else 1))
                rows.append(np.full(len(near), i))
                blocks.append(near)
            at = np.concatenate(rows) if rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array((np.concatenate(blocks) if blocks else at).astype(np.int32))], ["id", "v", "block"])

    kind_q = dict(asked.dtypes)["id"]
    visits = asked.select("id", "v").mapInArrow(visit, f"id {kind_q}, v array<double>, block int")
    per_block = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row a block
    chunks = {b: -(-m // query_rows) for b, m in per_block.items()}
    session = known.sparkSession
    plan = [(int(c), int(r), int(s), b, chunks.get(b, 0)) for b, (c, r, s) in enumerate(stats[["cell", "ring", "salt"]].itertuples(index=False, name=None))]
    table = session.createDataFrame(plan, "cell int, ring int, salt int, block int, chunks int")
    left = ringed.join(table.where("chunks > 0"), ["cell", "ring", "salt"]).select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = visits.join(table.select("block", "chunks"), "block").select("id", "v", "block", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"))

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        v, q = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, width["n"]) for t in (vectors, queries))
        ids, qid = (t.column("id").combine_chunks() for t in (vectors, queries))
        names, asked_ids = (x.to_numpy(zero_copy_only=False) for x in (ids, qid))
        best = Best(asked_ids, q, k, l2, least, other)
        for at in range(0, len(v), 4096):
            best.add(names[at : at + 4096], v[at : at + 4096])
        a, b, score = best.rows()
        return pa.table({"query_id": pa.array(a, qid.type), "id": pa.array(b, ids.type), "score": pa.array(score, pa.float64())})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(meet, _types(known, asked, ()))
    return found, {"blocks": len(stats), "visits": sum(per_block.values()), "possible": len(stats) * asked.count()}


def _few(asked: DataFrame) -> pd.DataFrame | None:
    """The queries, if they are few and small enough for every task."""
    size = asked.limit(MAX_QUERIES + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("numbers")).first()
    return asked.drop("width").toPandas() if size["n"] <= MAX_QUERIES and 8 * size["numbers"] <= MAX_BYTES else None


def nearest(known: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", by: tuple[str, ...] = (), l2: bool = False, least: float | None = None, other: bool = False, blocked: bool | None = None, within: str | None = None, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, id, by, score): the k nearest of each query, of each value of ``by`` if given; ties go to the smaller id.

    score is the cosine, or with ``l2`` the distance. ``least`` is the least cosine; with ``other`` a row is not near itself (its id).
    ``blocked`` forces (True) or forbids (False) the join in blocks. ``within`` names a column of both: only rows of one value are compared.
    """
    if by and within:
        raise ValueError("pools by value and search within one exclude each other")
    column = (within,) if within else ()
    usable, asked = _usable(known, id_col, vector_col, by or column, l2), _usable(queries, query_id, query_vector, column, l2)
    if within:
        usable, asked = (x.where(F.col(within).isNotNull()) for x in (usable, asked))
    held = None if blocked else _few(asked)
    if held is not None:
        found = _scan(usable, asked, held, k, by, l2, least, other, within) if len(held) else known.sparkSession.createDataFrame([], _types(usable, asked, by))
    elif blocked is False:
        raise ValueError(f"more than {MAX_QUERIES} queries or {MAX_BYTES} bytes")
    elif by:
        raise ValueError("pools by value are for requests of few queries")
    elif within:
        found = _within(usable.drop("width"), asked.drop("width"), k, l2, least, other, within)
    else:
        found, _ = _blocked(usable, asked, k, l2, least, other, pivots, block_rows, query_rows)
    return top_per_group(found, ["query_id", *by], [F.asc("score") if l2 else F.desc("score"), F.asc("id")], k)
