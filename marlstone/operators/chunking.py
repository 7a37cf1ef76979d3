"""Stable chunks (``operators.stable``), markdown sections, blocks: per-document algorithms over Arrow batches.

Each document is worked on by itself, so these are map-only stages whatever the
size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from marlstone.operators import stable

_HEADER = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t#]*$", re.M)


def headers(text: str) -> list[tuple[int, int, str]]:
    """(start, level, title) of markdown headers outside fenced blocks."""
    fences = [m.start() for m in re.finditer(r"^(?:```|~~~)", text, re.M)]
    return [(m.start(), len(m[1]), m[2]) for m in _HEADER.finditer(text) if sum(f < m.start() for f in fences) % 2 == 0]


def sections(text: str) -> list[dict]:
    """Flat table of contents in order: seq, parent, level, title, start, end, own text end.

    Text before the first header is a section without title at level 0.
    """
    found = headers(text)
    if not found or found[0][0] > 0 and text[: found[0][0]].strip():
        found = [(0, 0, ""), *found]
    out, stack = [], []
    for i, (start, level, title) in enumerate(found):
        while stack and out[stack[-1]]["level"] >= level:
            stack.pop()
        own_end = found[i + 1][0] if i + 1 < len(found) else len(text)
        out.append({"seq": i, "parent": stack[-1] if stack else None, "level": level, "title": title, "start": start, "own_end": own_end, "end": own_end})
        stack.append(i)
    for s in reversed(out):
        if s["parent"] is not None:
            out[s["parent"]]["end"] = max(out[s["parent"]]["end"], s["end"])
    return out


def thin(tree: list[dict], least: int) -> list[dict]:
    """Drops sections whose own text is at most ``least`` rough tokens; their children move up."""
    parent = {s["seq"]: s["parent"] for s in tree}
    gone = {s["seq"] for s in tree if (s["own_end"] - s["start"]) // 4 <= least}

    def up(k: int | None) -> int | None:
        while k is not None and k in gone:
            k = parent[k]
        return k

    return [{**s, "parent": up(s["parent"])} for s in tree if s["seq"] not in gone]


def subtree_tokens(tree: list[dict]) -> dict[int, int]:
    """Rough tokens of each section with all below it."""
    total = {s["seq"]: (s["own_end"] - s["start"]) // 4 for s in tree}
    for s in sorted(tree, key=lambda s: -s["seq"]):
        if s["parent"] is not None:
            total[s["parent"]] += total[s["seq"]]
    return total


def pack_blocks(costs: list[int], target: int) -> list[int]:
    """Block number of each item: a new block when the target would be passed."""
    out, block, used = [], 0, 0
    for c in costs:
        if used and used + c > target:
            block, used = block + 1, 0
        out.append(block)
        used += c
    return out


def split_batches(costs: list[int], most_cost: int, most_items: int) -> list[int]:
    """Like pack_blocks, with a cap on items too."""
    out, batch, used, n = [], 0, 0, 0
    for c in costs:
        if n and (used + c > most_cost or n >= most_items):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + c, n + 1
    return out


def header_quality(text: str, least: int = 2, coverage: float = 0.5, gap: float = 0.4, tokens: int = 4000) -> bool:
    """Whether headers structure the text: enough of them, covering it, without large gaps or sections."""
    found = headers(text)
    if len(found) < least or not text:
        return False
    starts = [h[0] for h in found] + [len(text)]
    spans = [b - a for a, b in zip(starts, starts[1:])]
    return (len(text) - starts[0]) / len(text) >= coverage and max([starts[0], *spans]) / len(text) <= max(gap, 1.5 / len(found)) and sum(spans) / len(spans) / 4 <= tokens


def union_length(spans: DataFrame, group: list[str]) -> DataFrame:
    """(group, covered): length of the union of each group's intervals (lo, hi)."""
    reach = F.max("hi").over(W.partitionBy(*group).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(reach, F.col("lo"))), F.lit(0))
    return spans.withColumn("_own", own).groupBy(*group).agg(F.sum("_own").cast("long").alias("covered"))


def slice_table(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, a, b): overlapping slices that cover each text; empty texts have none."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), n - overlap) - 1, F.lit(max(1, size - overlap)))
    rows = docs.where(n > 0).select(F.col(id_col).alias("id"), n.alias("n"), F.explode(starts).alias("a"))
    return rows.select("id", F.col("a").cast("long").alias("a"), F.least(F.col("a") + size, F.col("n")).cast("long").alias("b"))


def subtree_totals(tree: DataFrame, group: list[str], value: str = "tokens") -> DataFrame:
    """(group, seq, total) of a table of nodes (group, seq, parent, value): the sum of each node with all
    below it. Sums move up a level a round until none has a parent, so a round shuffles what is left only;
    levels are kept (persisted), so that none is made again for those above it."""
    tree = tree.select(*group, "seq", "parent", value).persist()
    parents = tree.select(*group, F.col("seq").alias("at"), "parent")
    level = tree.select(*group, F.col("seq").alias("at"), F.col(value).alias("total"))
    out = level
    while True:
        level = level.join(parents, [*group, "at"]).where("parent IS NOT NULL").groupBy(*group, F.col("parent").alias("at")).agg(F.sum("total").alias("total")).persist()
        if level.isEmpty():
            return out.groupBy(*group, F.col("at").alias("seq")).agg(F.sum("total").alias("total"))
        out = out.unionByName(level)


def located_headers(docs: DataFrame, id_col: str, text_col: str, titles_col: str, near: int = 10) -> DataFrame:
    """(id, title, start) of the proposed titles (an array) that stand in each text as lines of
    their own; of two within ``near`` characters the first stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, titles in zip(pdf["id"], pdf["text"], pdf["titles"]):
                found = [(match_header(t, text or ""), 0, t) for t in ([] if titles is None else titles) if t]
                rows += [(i, t, at) for at, _, t in merge_headers([f for f in found if f[0] >= 0], near)]
            yield pd.DataFrame(rows, columns=["id", "title", "start"])

    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(titles_col).alias("titles"))
    return narrow.mapInPandas(run, "id long, title string, start long")


def _map_text(docs: DataFrame, id_col: str, text_col: str, make, schema: str, at_once: int = 32, most: int = 2_000) -> DataFrame:
    """Rows made of each text. A worker holds ``at_once`` texts beside Spark's batch and gives rows away from ``most`` on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"id long, {schema}"
    kinds = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for row in make(t) if t else ():
                        rows.append((i, *row))
                        if len(rows) >= most:
                            yield _batch(rows, kinds)
                            rows = []
            if rows:
                yield _batch(rows, kinds)

    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, full)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


def chunk_table(docs: DataFrame, id_col: str, text_col: str = "text", size: int = stable.CHUNK_SIZE, markdown: bool = True, sentences: bool = True) -> DataFrame:
    """(id, seq, text, hash) of each document's stable chunks; null and empty texts have none. ``sentences`` off: chunks by lines cut longer lines by length alone."""
    cut = stable.markdown_chunks if markdown else partial(stable.line_chunks, sentences=sentences)
    rows = _map_text(docs, id_col, text_col, lambda t: enumerate(cut(t, size)), "seq long, text string")
    return rows.withColumn("hash", F.sha2(F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"[ \t]+", " "), 256))


def section_table(docs: DataFrame, id_col: str, text_col: str = "text", least: int = 0) -> DataFrame:
    """(id, seq, parent, level, title, start, end, tokens) of each document's sections."""

    def make(text: str):
        tree = thin(sections(text), least) if least else sections(text)
        tokens = subtree_tokens(tree)
        for s in tree:
            yield s["seq"], s["parent"], s["level"], s["title"], s["start"], s["end"], tokens[s["seq"]]

    def exact(text: str):
        for seq, parent, *rest in make(text):
            yield (seq, -1 if parent is None else parent, *rest)

    rows = _map_text(docs, id_col, text_col, exact, "seq long, parent long, level int, title string, start long, end long, tokens long")
    return rows.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def intervals(sections_: DataFrame, group: list[str], value: str = "tokens", levels: int = 7) -> DataFrame:
    """Adds parent, depth (0 for roots), last and total to a table of contents (group, seq, level, value): ``last`` is the number of the last section
    below, so what is below a section is the range from seq + 1 to last; ``total`` is the sum of the values from seq to last.

    Sections are in order (pre-order), levels are 0 to ``levels`` - 1. The next section of a level as low
    closes a section, and the last one of a lower level that nothing has closed holds it: one window forth and
    one back over each document, without a join for each level.
    """
    ahead = W.partitionBy(*group).orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    back = W.partitionBy(*group).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    level = F.col("level")
    rows = sections_.withColumn("_sum", F.coalesce(F.sum(value).over(back), F.lit(0)))
    end = F.struct((F.max("seq").over(W.partitionBy(*group)) + 1).alias("seq"), F.sum(value).over(W.partitionBy(*group)).alias("_sum"))
    closed, parent, depth = F.lit(None), F.lit(None).cast("long"), F.lit(0)
    for n in range(levels):
        closed = F.when(level == n, F.min(F.when(level <= n, F.struct("seq", "_sum"))).over(ahead)).otherwise(closed)
        parent = F.when(level == n, F.max(F.when(level < n, F.col("seq"))).over(back)).otherwise(parent)
        # The last section of level n is above the current one if it is higher, and no section of a lower level has come since.
        holds = F.max(F.when(level == n, F.col("seq"))).over(back) > F.coalesce(F.max(F.when(level < n, F.col("seq"))).over(back), F.lit(-1))
        depth = depth + F.when((level > n) & F.coalesce(holds, F.lit(False)), 1).otherwise(0)
    rows = rows.select("*", F.coalesce(closed, end).alias("_end"), parent.alias("_parent"), depth.alias("_depth"))
    kept = [c for c in sections_.columns if c not in ("parent", "depth", "last", "total")]
    return rows.select(*kept, F.col("_parent").alias("parent"), F.col("_depth").alias("depth"), (F.col("_end.seq") - 1).cast("long").alias("last"), (F.col("_end._sum") - F.col("_sum")).alias("total"))


def toc_filter(contents: DataFrame, depth: int | None = None, below: DataFrame | None = None, group: tuple[str, ...] = ("id",)) -> DataFrame:
    """Sections of ``intervals`` down to the second step of the tree (depth 0) or all (more, or None). With ``below``
    (group, node) only those below these nodes, steps counted from there; node is added. A node that is not there has nothing below it."""
    if below is None:
        return contents.where("depth <= 1") if depth == 0 else contents
    top = contents.select(*group, F.col("seq").alias("node"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
    asked = top.join(below.select(*group, "node").distinct(), [*group, "node"], "left_semi")
    met = contents.join(asked, list(group)).where((F.col("seq") > F.col("node")) & (F.col("seq") <= F.col("_last")))
    return (met.where(F.col("depth") <= F.col("_depth") + 2) if depth == 0 else met).drop("_last", "_depth")


def merge_spans(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """Joins neighbouring entity spans of one label with at most one character between: (start, end, label, words)."""
    out: list[list] = []
    for a, b, label in sorted(spans):
        if out and out[-1][2] == label and a - out[-1][1] <= 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, label])
    return [(a, b, label, text[a:b].strip()) for a, b, label in out]


def match_header(title: str, text: str, start: int = 0) -> int:
    """Where a header given by its title stands in a text: as a line equal to it regardless
    of case, marks and blanks, from ``start`` on; -1 if nowhere."""

    def bare(s: str) -> str:
        return re.sub(r"[\W_]+", "", s).lower()

    want, at = bare(title), start
    if not want:
        return -1
    for line in text[start:].splitlines(keepends=True):
        if bare(line) == want:
            return at
        at += len(line)
    return -1


def merge_headers(found: list[tuple[int, int, str]], near: int = 10) -> list[tuple[int, int, str]]:
    """Headers (start, level, title) in order; of two within ``near`` characters the first stays."""
    out: list[tuple[int, int, str]] = []
    for h in sorted(found):
        if not out or h[0] - out[-1][0] > near:
            out.append(h)
    return out
