import random
import re

import pytest

from marlstone.llm import decontam as D

ITEM = "Alice has 12 apples and gives 5 of them to her friend Bob who then eats 3 before the long walk home in the evening"
SWAPPED = "Carol has 40 apples and gives 8 of them to her friend Dave who then eats 2 before the long walk home in the evening"
BROKEN = "Carol has 40 apples and gives 40 of them to her friend Carol who then eats 2 before the long walk home in the evening"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(d, i, **kw).collect()}


def test_verbatim_and_new_parameters_are_caught(spark):
    docs = [(1, f"some words first. {ITEM} and more"), (2, f"another text. {SWAPPED}. the end"), (3, "a clean text about something else entirely, with 5 apples and a walk"), (4, ITEM.upper())]
    got = run(spark, docs, [(7, ITEM)])
    assert set(got) == {(1, 7), (2, 7), (4, 7)}
    assert got[1, 7].verbatim and not got[2, 7].verbatim and got[1, 7].cover == 1.0


def test_slots_must_be_consistent(spark):
    # One value of the document stands for two of the item: no such alignment.
    assert run(spark, [(1, BROKEN)], [(7, ITEM)]) == {}


def test_windows_in_their_own_words_count_beside_an_inconsistent_slot(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    item, doc = words.copy(), words.copy()
    item[5] = item[50] = doc[5] = "2"
    doc[50] = "3"  # 2 stands for 2 and for 3
    got = run(spark, [(1, " ".join(doc)), (2, " ".join(words[:20]))], [(7, " ".join(item))])
    assert set(got) == {(1, 7)}
    assert got[1, 7].matched_windows == 44 and not got[1, 7].verbatim  # 52 less the eight that hold the change
    assert set(run(spark, [(1, " ".join(doc))], [(7, " ".join(item))], broadcast_rows=0)) == {(1, 7)}


def test_questions_full_of_slots_are_caught_by_the_templates_they_have(spark):
    item = "A train covers 120 km in 2 hours 30 minutes"
    docs = [(1, "Here: A train covers 90 km in 1 hour 20 minutes, they said."), (2, f"copied: {item}."), (3, "A train of 3 cars leaves in 2 hours 30 minutes"), (4, "it covers 90 km in 1 hour 20 minutes"), (5, "A bus covers 90 km in 1 hour 20 minutes")]
    got = run(spark, docs, [(7, item)])
    assert set(got) == {(1, 7), (2, 7)} and got[2, 7].cover == 1.0 and not got[1, 7].verbatim and got[1, 7].cover == 0.8
    # Questions whose windows all hold less than four literal words are found as copies only (stated in the README).
    assert set(run(spark, [(1, "Convert 9 miles to meters"), (2, "so convert 5 Miles to kilometers now")], [(7, "Convert 5 miles to kilometers")])) == {(2, 7)}
    # A long item of few templates isn't caught by one of them.
    rich = "a train covers 1 km in 2 km 3 km 4 km 5 km 6 km 7 km 8 km 9 km 10 km"
    assert run(spark, [(1, "a train covers 11 km in 12 km and no more")], [(7, rich)]) == {}


def test_short_items_and_edge_cases(spark):
    items = [(1, "what is the capital of france"), (2, "too short"), (3, None), (4, ""), (None, ITEM), (5, ITEM), (5, ITEM), (6, ITEM)]
    docs = [(1, "so: What is the capital of France? nobody knows"), (2, None), (3, ""), (None, ITEM), (4, ITEM), (4, ITEM)]
    got = run(spark, docs, items)
    assert set(got) == {(1, 1), (4, 5), (4, 6)}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_the_shuffled_join_finds_the_same(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(10, 40)))) for i in range(30)]
    docs = []
    for i in range(120):
        t = [r.choice(words) for _ in range(150)]
        if i % 4 == 0:
            at = r.randrange(100)
            t[at:at] = items[i % 30][1].split()
        docs.append((i, " ".join(t)))
    want = {(i, k) for i, t in docs for k, x in items if x in t}
    assert set(run(spark, docs, items)) == want
    assert set(run(spark, docs, items, broadcast_rows=0, filter_bits=1 << 10)) == want


def test_filter_keeps_clean_rows_and_their_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 1, "x"), (2, "clean text here", 1, "x"), (None, ITEM, 1, "x")], "doc_id long, text string, item_id int, h string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2]


def test_window_hashes_do_not_depend_on_what_surrounds_them():
    chars = D.Characters()
    a, b = D.Texts(["aa bb cc dd ee ff gg hh ii jj kk ll"], chars), D.Texts(["pp qq rr", "xx yy aa bb cc dd ee ff gg hh ii jj kk ll zz", "aa"], chars)
    for size in (1, 3, 5, 8):
        hashes = b.windows(size, 1)
        mine = [h for p, h in zip(hashes[0].tolist(), hashes[1].tolist()) if b.begin[1] <= p < b.begin[2]]
        assert a.windows(size, 1)[1].tolist() == mine[2 : 2 + len(a.h) - size + 1]
        assert all(p + size <= b.begin[k + 1] for p in hashes[0] for k in [b.of[p]])


def by_hand(text):
    """(word, kind) of each token, read one by one."""
    raw = [(t, re.sub(r"^[\W_]+|[\W_]+$", "", t)) for t in text.split()]
    closes, out = [], []
    for t, bare in raw:
        end = t.rstrip("\"')]*").endswith((".", "!", "?", ":"))
        if bare:
            out.append(bare)
            closes.append(end)
        elif out:
            closes[-1] = closes[-1] or end
    small = {w.lower() for w in out if w.islower()}
    kinds = []
    for i, w in enumerate(out):
        low = w.lower()
        number, unit = any(map(str.isdigit, w)) or low in D.NUMBERS, low in D.UNITS
        capital = w[0].isupper() and (len(w) == 1 or not w.isupper()) and not number and not unit
        kinds.append((low, number, unit, capital, i == 0 or closes[i - 1]))
    inner = {k[0] for k in kinds if k[3] and not k[4] and k[0] not in D.GIVEN_NAMES and k[0] not in small}
    return [(low, D.NAME if capital and (low in inner or low in D.GIVEN_NAMES) else D.NUM if number else D.UNIT if unit else 0) for low, number, unit, capital, _ in kinds]


@pytest.mark.parametrize("size", [1 << 16, 300, 40])
def test_tokens_are_those_read_by_hand(size, monkeypatch):
    monkeypatch.setattr(D, "SLICE", size)
    r, chars = random.Random(8), D.Characters()
    words = "the cat Alice bob Bob Zebra zebra Zürich 12 3.5kg km KM five IT It éa ÉA -- ... (x) \"Quoted\" end. End! who? a_b _c_ don't Straße \u4e2d\u6587 I".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(200)]
    t, by_word = D.Texts([*texts, None], chars), {}
    for k, text in enumerate(texts):
        want, mine = by_hand(text), range(t.begin[k], t.begin[k + 1])
        assert [t.word(i) for i in mine] == [w for w, _ in want], text
        assert t.placeholder[mine].tolist() == [kind > 0 for _, kind in want], (text, want)
        for i, (w, kind) in zip(mine, want):
            assert t.h[i] == (chars.place[kind] if kind else t.plain[i])
            assert by_word.setdefault(w, t.plain[i]) == t.plain[i]
    assert len(set(by_word.values())) == len(by_word)


def brute_force(docs, items, window=8, min_literal=4, min_cover=0.5):
    """Every window of every document against every window of every item, token by token."""

    def cut(text, size):
        tokens = by_hand(text)
        for p in range(len(tokens) - size + 1):
            part = tokens[p : p + size]
            words, typed = [w for w, _ in part], [kind or w for w, kind in part]
            slots = [w for w, kind in part if kind]
            forms = {("own", *words)} if slots else set()
            if size - len(slots) >= min(min_literal, size):
                forms |= {("typed", *typed) if slots else ("own", *words)}
            if forms:
                yield p, forms, slots

    out = {}
    for item, text in items:
        n = len(by_hand(text))
        size = min(window, n)
        if n < 4:
            continue
        mine = list(cut(text, size))
        for doc, other in docs:
            aligned = {}
            for p, forms, slots in mine:
                for q, theirs, found in cut(other, size):
                    if forms & theirs:
                        aligned.setdefault(q - p, []).append((p, slots, found))
            covered = set()
            for hits in aligned.values():
                pairs = {x for _, a, b in hits for x in zip(a, b)}
                good = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
                covered |= {p for p, a, b in hits if good or a == b}
            templates = [p for p, _, slots in mine if size - len(slots) >= min(min_literal, size)]
            tokens = {t for p in covered for t in range(p, p + size)}
            if mine and (len(covered) >= min_cover * len(mine) or templates and len(covered) >= min_cover * len(templates) and len(tokens) >= min_cover * n):
                out[doc, item] = len(covered)
    return out


def test_templates_against_brute_force(spark):
    r = random.Random(12)
    names, units = ["Alice", "Bob", "Carol", "Dave", "Emma"], ["miles", "meters", "hours"]
    frame = "{n} has {a} apples and walks {b} {u} to the house of {m} before {n} eats {a} of them with {m} in the {w} light of day {c}".split()

    def fill(consistent=True):
        v = {"n": r.choice(names), "m": r.choice(names), "a": str(r.randint(1, 9)), "b": str(r.randint(1, 9)), "c": str(r.randint(1, 9)), "u": r.choice(units), "w": r.choice(["early", "late"])}
        out = []
        for t in frame[r.randint(0, 3) :]:
            key = t.strip("{}")
            if t.startswith("{") and not consistent and r.random() < 0.3:
                v[key] = r.choice(names) if key in "nm" else str(r.randint(1, 9)) if key in "abc" else v[key]
            out.append(v[key] if t.startswith("{") else t)
        return " ".join(out)

    items = [(i, fill()) for i in range(12)]
    items += [(20 + i, f"the cart of {r.choice(names)} takes {i + 1} {r.choice(units)} with {i + 2} {r.choice(units)} {i + 3}") for i in range(6)]
    frames = [f"so the cart of {r.choice(names)} takes {r.randint(1, 9)} {r.choice(units)} with {r.randint(1, 9)} {r.choice(units)} {r.randint(1, 9)} more" for _ in range(20)]
    docs = [(100 + i, t) for i, t in enumerate(frames)] + [(i, "so it was said that " + fill(i % 2 == 0) + " and so on. " + (fill(False) if i % 5 == 0 else "")) for i in range(50)]
    want = brute_force(docs, items)
    got = run(spark, docs, items)
    assert {k: v.matched_windows for k, v in got.items()} == want and 0 < len(want) < 600


def test_rows_of_one_id_are_one_document(spark):
    half = ITEM.split()
    got = run(spark, [(1, " ".join(half[:16])), (1, ITEM), (1, ITEM)], [(7, ITEM)])
    assert got[1, 7].cover == 1.0
