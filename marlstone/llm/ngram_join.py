"""Self-join of texts on the Jaccard similarity of their word n-gram sets.

Similar texts are linked; the result is the component of each document under
links, found without ever making all pairs of a group.

1. Each text becomes a set of n-gram hashes. Equal sets are one class; its least id
   stands for it.
2. Prefix filter: in any order common to all sets, sets that are similar enough share
   one of their first n - ceil(t n) + 1 n-grams. The order is that of the hashes with
   the common n-grams last (``common_grams``), so a passage that many texts share
   brings none of them together. N-grams of the prefixes are counted (combined before
   the shuffle) and those of one class only dropped. Classes meet at each n-gram they
   share. Pairs must fit in length, and the
   parity bitmaps of their sets must not prove too many differences: every bit
   that differs stands for an n-gram in one set only. A meeting emits a spanning
   forest of such pairs, not the pairs. All links lie inside the forests' components.
   Only sets made of common n-grams nearly throughout, such as near copies in their
   thousands, still meet at common ones; ``common_edges`` brings them together in
   ranges of size, then in blocks of at most ``block``, then by a few of each part.
3. Prefix-tree join: the sets of a component (in blocks if it is large, see
   ``exact_components``) are stored in a trie in global order, equal beginnings once. Each set walks the
   trie; the overlap with a path is counted once for all sets below it, and a
   subtree ends the walk when even its whole remaining length, or the walker's,
   could not lift the overlap to the threshold. A subtree whose sets are already
   in the walker's component is passed over. Links are exact: 100 * intersection
   >= percent * union, in whole numbers.
4. Components of those links, extended to the classes' copies.

Defined cases: a text with fewer words than n is one n-gram, its whole sequence;
a text without words, empty or null has an empty set and no links (its component
is itself); a null id has no links and a null component. Repeated rows and equal
texts are one class. A lone very long text is one row with its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.candidates import blocks_between_parts, blocks_of, candidate_components, whole_groups
from marlstone.llm.common import discard, fanout_join, materialise, trimmed
from marlstone.llm.components import UnionFind, components
from marlstone.llm.ngram_sets import sets_of, signatures
from marlstone.operators.filters import top_per_group

N, PERCENT, BLOCK, SETS_BLOCK, SAMPLE = 3, 90, 512, 256, 8

# ---------------------------------------------------------------- prefix tree


class PrefixTree:
    """A trie of ordered sets; every node has a run of elements and the range of sets below it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())  # bytes order as the numbers do
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        shared = [self._common(a, b) for a, b in zip(self.sets, self.sets[1:])]
        # (first set, past the last, depth at which the node's run begins, depth at which it ends, children)
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []
        self.roots = self._build(0, len(self.sets), 0, shared)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def _build(self, lo: int, hi: int, depth: int, shared: list[int]) -> list[int]:
        """Nodes of the sets lo .. hi-1, which share their first ``depth`` elements; with a stack of its own."""
        top: list[int] = []
        todo = [(lo, hi, depth, top)]
        while todo:
            lo, hi, depth, into = todo.pop()
            at = lo
            while at < hi:
                end, low = at + 1, len(self.sets[at])
                while end < hi and shared[end - 1] > depth:
                    low = min(low, shared[end - 1])
                    end += 1
                children: list[int] = []
                self.nodes.append((at, end, depth, low if end > at + 1 else len(self.sets[at]), children))
                into.append(len(self.nodes) - 1)
                if end > at + 1:
                    todo.append((at, end, low, children))
                at = end
        return top

    def links(self, percent: int, label: list | None = None, allowed=lambda i, j: True) -> Iterator[tuple[int, int]]:
        """A spanning forest of the linked pairs (numbers of the caller's sets).

        Sets of one label count as linked already; ``allowed(i, j)`` may rule out pairs.
        """
        found, first = UnionFind(len(self.sets)), {}
        for k, i in enumerate(self.order if label else ()):
            found.union(first.setdefault(label[i], k), k)
        least, most = (np.array([f(self.sizes[lo:hi]) for lo, hi, *_ in self.nodes]) for f in (np.min, np.max))
        whole: list[int] = []
        stale = True
        for i, x in enumerate(self.sets):
            if found.sets == 1:
                return
            if stale:  # for each node the component of all its sets, or -1
                root = np.array([found.find(k) for k in range(len(self.sets))])
                whole = [int(root[lo]) if (root[lo:hi] == root[lo]).all() else -1 for lo, hi, *_ in self.nodes]
                stale = False
            todo = [(node, 0, 0) for node in self.roots]
            while todo:
                node, at, overlap = todo.pop()
                lo, hi, begin, end, children = self.nodes[node]
                if hi <= i + 1 or whole[node] == found.find(i) and whole[node] >= 0:
                    continue
                if 100 * most[node] < percent * len(x) or 100 * len(x) < percent * least[node]:
                    continue
                run = self.sets[lo][begin:end]
                if len(run):
                    place = np.searchsorted(x, run)
                    inside = place < len(x)
                    overlap += int(np.count_nonzero(x[place[inside]] == run[inside]))
                    at = int(np.searchsorted(x, run[-1], side="right"))
                # o >= p/(100+p) (|x|+|y|) is needed; the rest can add no more than the shorter remainder.
                reach = overlap + min(len(x) - at, int(most[node]) - end)
                if (100 + percent) * reach < percent * (len(x) + int(least[node])):
                    continue
                if children:
                    todo += [(c, at, overlap) for c in children]
                else:
                    for j in range(max(lo, i + 1), hi):
                        if 100 * overlap >= percent * (len(x) + len(self.sets[j]) - overlap) and allowed(self.order[i], self.order[j]) and found.union(i, j):
                            stale = True
                            yield self.order[i], self.order[j]


def _exact_links(percent: int):
    """Links of groups (component, pair): not between rows of one label, nor, in a pair of blocks, of one side."""

    def run(batches: Iterator[pd.DataFrame]):
        for rows in whole_groups(batches, ["component", "pair"]):
            out = []
            for _, part in rows.groupby(["component", "pair"], sort=False):
                rep, side, label = part["rep"].tolist(), part["side"].tolist(), part["label"].tolist()
                tree, two = PrefixTree([np.frombuffer(s, np.uint64) for s in part["grams"]]), any(side)
                out += [(rep[i], rep[j]) for i, j in tree.links(percent, label, lambda i, j: not two or side[i] != side[j])]
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _tree_join(rows: DataFrame, percent: int) -> DataFrame:
    dealt = rows.select("component", "pair", "side", "rep", "label", "grams").repartition("component", "pair").sortWithinPartitions("component", "pair")
    return dealt.mapInPandas(trimmed(_exact_links(percent)), "a long, b long")


def exact_components(sets: DataFrame, percent: int, sets_block: int) -> DataFrame:
    """(id, component) of all links inside candidate components; ``sets`` is (rep, component, members, grams).

    Blocks are joined in themselves first, and then a few sets of each part found
    of a component of several blocks. Near copies, however many, are one part by
    then; in components that still fall into parts the blocks of the smaller parts are
    joined with those of all, and there only sets of different parts are compared.
    """
    nb = F.ceil(F.col("members") / sets_block).cast("int")
    alone = sets.withColumns({"pair": F.pmod(F.xxhash64("rep"), nb).cast("int"), "side": F.lit(0), "label": F.col("rep")})
    links = materialise(_tree_join(alone, percent), "set-links")
    large = sets.where(F.col("members") > sets_block)
    if large.isEmpty():
        return components(links)

    def labelled(found: DataFrame) -> DataFrame:
        found = found.join(large.select(F.col("rep").alias("a")), "a", "left_semi")  # links lie inside a component
        parts = components(found).select(F.col("id").alias("rep"), F.col("component").alias("label"))
        return large.join(parts, "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    few = top_per_group(labelled(links), ["component", "label"], [F.asc("rep")], SAMPLE)
    count = few.groupBy("component").agg(F.count("*").alias("n"))
    few = blocks_of(few.join(count, "component"), "n", sets_block, "rep")
    links = materialise(links.unionByName(_tree_join(few, percent)), "set-links")
    left = labelled(links)
    rest = blocks_between_parts(materialise(left, "set-parts"), "component", sets_block)
    return components(links.unionByName(_tree_join(rest, percent)))


# ---------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, block: int = BLOCK, sets_block: int = SETS_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # as text: null ids keep longs exact
    made = narrow.mapInPandas(trimmed(signatures(n, percent)), "id string, n long, key binary, first array<long>, bits array<long>")
    made = materialise(made.withColumn("id", F.col("id").cast("long")), "ngram-sets")
    classes = made.where("id IS NOT NULL AND n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "first", "bits")])
    classes = materialise(classes, "ngram-classes")
    keys = materialise(made.select("id", "n", "key"), "ngram-keys")
    discard(made)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    groups = candidate_components(texts, classes, n, percent, block)

    count = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = fanout_join(groups, count, "component", F.col("id"), "inner").select(F.col("id").alias("rep"), "component", "members")
    sets = sets_of(texts, members, n).where(F.length("grams") > 0)
    linked = exact_components(materialise(sets, "candidate-sets"), percent, sets_block)

    of_class = classes.select("key", "rep", "copies").join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_class = of_class.where("copies > 1 OR component IS NOT NULL").select("key", F.coalesce("component", "rep").alias("component"))
    out = fanout_join(keys, of_class, "key", F.col("id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the least id of each component only; rows with null ids stay.

    Repeated rows of the least id all stay, for they are one document.
    """
    gone = jaccard_components(docs, id_col=id_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_nj_doc")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_nj_doc"), "left_anti")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS rep, any_value(len(s)) AS n, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), ranked AS (
  SELECT rep, n, unnest(s) AS g, generate_subscripts(s, 1) AS k FROM classes
), pre AS (
  SELECT rep, n, g FROM ranked WHERE k <= n - (90 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM pre a JOIN pre b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN classes x ON x.rep = p.a JOIN classes y ON y.rep = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 90 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT rep AS id, rep AS root FROM classes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.root = e.a
), roots AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN roots r ON r.id = c.rep
"""
