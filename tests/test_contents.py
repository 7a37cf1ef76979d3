import random

from marlstone.operators import chunking


def walk(levels):
    """(parent, depth, last, total of seq + 1) by a stack."""
    parents, stack = [], []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parents.append(stack[-1] if stack else None)
        stack.append(i)
    up = lambda i: [] if parents[i] is None else [parents[i], *up(parents[i])]
    below = {i: [j for j in range(len(levels)) if i in up(j)] for i in range(len(levels))}
    return [(p, len(up(i)), max([i, *below[i]]), sum(j + 1 for j in [i, *below[i]])) for i, p in enumerate(parents)], below, up


def test_intervals_and_subtrees_against_a_stack(spark):
    rng = random.Random(3)
    docs = {i: [rng.randrange(0, 7) for _ in range(rng.randrange(1, 40))] for i in range(25)}
    rows = [(i, seq, level, seq + 1) for i, levels in docs.items() for seq, level in enumerate(levels)]
    got = chunking.intervals(spark.createDataFrame(rows, "id long, seq long, level int, tokens long"), ["id"]).persist()
    assert {(r.id, r.seq): (r.parent, r.depth, r.last, r.total) for r in got.collect()} == {(i, s): x for i, levels in docs.items() for s, x in enumerate(walk(levels)[0])}
    asked = [(i, rng.randrange(45)) for i in docs for _ in range(3)] + [(99, 0)]
    nodes = spark.createDataFrame(asked, "id long, node long")
    for depth, most in ((0, 2), (1, 99), (None, 99)):
        want = set()
        for i, node in asked:
            if i in docs and node < len(docs[i]):
                _, below, up = walk(docs[i])
                want |= {(i, node, j) for j in below[node] if len(up(j)) <= len(up(node)) + most}
        found = [(r.id, r.node, r.seq) for r in chunking.toc_filter(got, depth, nodes).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert {(r.id, r.seq) for r in chunking.toc_filter(got, 0).collect()} == {(i, s) for i, levels in docs.items() for s, x in enumerate(walk(levels)[0]) if x[1] <= 1}
    assert chunking.toc_filter(got).count() == len(rows)
    got.unpersist()
