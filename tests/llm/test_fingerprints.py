import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import fingerprints as P


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def hash_text(s):
    return signed(xxhash.xxh64(s.encode(), seed=42).intdigest())


def hash_run(run):
    seed = 42
    for n in run:
        seed = xxhash.xxh64(n.to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return signed(seed)


def anchors(symbols, k, s):
    if len(symbols) < k:
        return [(hash_run(symbols), 0)] if symbols else []
    out = []
    for i in range(len(symbols) - k + 1):
        inner = [hash_run(symbols[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((hash_run(symbols[i : i + k]), i))
    return out


def sketch(found, size):
    first = {}
    for h, at in found:
        h = signed(h << 24 & (1 << 64) - 1) >> 24
        first[h] = min(at, first.get(h, at))
    return [(h, first[h]) for h in sorted(first)[:size]]


def print_of(text, size):
    words = [w for w in re.split(r"[\x09-\x0D ]+", text.lower()) if w]
    by_word = sketch(anchors([hash_text(w) for w in words], 5, 2), size) if len(words) >= 20 else None
    by_char = sketch(anchors([hash_text(c) for c in text.lower()], 12, 5), size) if len(words) < 80 else None
    return by_word, by_char


def like(a, b, size):
    best = 0.0
    for x, y in zip(a, b):
        if x is not None and y is not None:
            if not x and not y:
                best = 1.0
                continue
            x, y = dict(x), dict(y)
            least = sorted(set(x) | set(y))[:size]
            shifts = Counter((x[h] - y[h]) // 16 for h in least if h in x and h in y)
            best = max([best, *((n + shifts[d + 1]) / len(least) for d, n in list(shifts.items()))])
    return best


def shown(p):
    return ";".join(f"{n}:" + "".join(f"{(h << 24 | at) & (1 << 64) - 1:016x}" for h, at in x) for n, x in zip("wc", p) if x is not None)


def brute(docs, size):
    """Every row with its next by a sort of all rows."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), hash_text(r[1])))
    out = []
    for n, (i, t) in enumerate(rows):
        other = rows[(n + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        a, b, c = (print_of(x, size) for x in (t, edited, other))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(like(a, b, size), 9), round(like(a, c, size), 9)))
    return sorted(out, key=str)


def found(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in P.edited_fingerprints(df, **kw).collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(n))


@pytest.mark.parametrize("size", [64, 8])
def test_every_row_against_plain_python(spark, size):
    rng = random.Random(5)
    docs = [(i * 3 - 50, prose(rng, rng.choice([1, 2, 10, 19, 20, 21, 79, 80, 81, 300]))) for i in range(60)]
    long = prose(rng, 400)
    docs += [(500, long), (499, long), (498, "new words first " + long), (497, ""), (496, None), (None, "no id"), (None, None), (3, "repeated"), (3, "repeated"), (3, "repeated"), (3, "the same id"), (7, "A B a b " * 200), (6, "日本語" * 60), (5, "\t\n"), (-(1 << 63), "x 😀 y")]
    assert found(spark, docs, size=size) == brute(docs, size)


def test_copies_are_alike_edits_nearly_and_others_not(spark):
    rng = random.Random(9)
    a, b = prose(rng, 500), prose(rng, 500)
    got = {r.doc_id: r for r in P.edited_fingerprints(spark.createDataFrame([(9, a), (8, a), (7, b), (6, "Some words more. " + b)], "doc_id long, text string")).collect()}
    assert got[9].near_next == 1.0 and got[9].fingerprint == got[8].fingerprint
    assert got[8].near_next < 0.05 and 0.3 < got[8].near_edited < 0.7
    assert got[7].near_next > 0.8  # shifted by three words


def test_anchors_are_free_of_their_surroundings(spark):
    """What is put before or after moves no anchor of the text in between."""
    rng = random.Random(2)
    before, text, after = ([rng.randrange(1 << 40) for _ in range(n)] for n in (37, 200, 11))
    df = spark.createDataFrame([(text, before + text + after)], "a array<long>, b array<long>")
    a, b = df.select(*[P.syncmers(F.col(c), 5, 2) for c in "ab"]).first()
    inside = {(x >> 24, (x & P.LAST_PLACE) + 37) for x in a}
    assert inside == {(x >> 24, x & P.LAST_PLACE) for x in b if 37 <= (x & P.LAST_PLACE) <= 37 + 195} and 60 < len(a) < 140
    assert max(x & P.LAST_PLACE for x in b) > 232 - 8


def test_one_row_no_row_and_more_columns(spark):
    assert found(spark, [(1, "only one")]) == brute([(1, "only one")], 64)
    assert found(spark, []) == []
    df = spark.createDataFrame([(1, "a", "x", 3), (2, "b", "y", 4)], "doc_id long, text string, head string, fp int")
    assert sorted(r.doc_id for r in P.edited_fingerprints(df).collect()) == [1, 2]


def test_no_python_and_each_text_is_shuffled_once(spark):
    plan = P.edited_fingerprints(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
