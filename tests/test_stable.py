import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators import chunking, stable

MARKS = ["plain words here. ", "# Head\n", "- item\n", "  - inner item\n", "1. one\n", "```\n", "~~~~\n", "\n", "Dr. Who went. Then more!\n", "   \n", "end?", "x" * 90, "---\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(MARKS), max_size=60), st.integers(20, 200))
def test_chunks_join_to_the_text(parts, size):
    text = "".join(parts)
    for cut in (stable.markdown_chunks, stable.line_chunks):
        chunks = cut(text, size)
        assert "".join(chunks) == text and all(chunks)


def plain_lines(text, size, hard):
    """The rules, a line at a time, over numbered lines; kept apart from the code under test."""
    number, held, out = 0, "", {}
    for line in text.splitlines(keepends=True):
        if not line.strip():
            held += line
        elif len(held) + len(line) > hard:
            if held:
                out[number], number = held, number + 1
            held = line
        else:
            held += line
            if len(held) > size or len(held) > size // 4 and stable.falls_on(line, size):
                out[number], number, held = held, number + 1, ""
    if held:
        out[number] = held
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("seed", range(10))
def test_line_chunks_against_the_rules(seed):
    r = random.Random(seed)
    text = "".join("".join(r.choices("abc d", k=r.randrange(50))) + "\n" for _ in range(300))
    got = stable.line_chunks(text, 200, 260)
    assert got == plain_lines(text, 200, 260) and len(got) > 20
    assert all(len(c) <= 260 or not c.strip("\n").count("\n") or c.endswith("\n\n") or " \n" in c for c in got)


def test_a_quarter_is_not_enough_and_the_hard_limit_flushes_before():
    size = 80  # divisor 2
    word = next(w for w in map(str, range(1000)) if len(w) == 3 and stable.falls_on(w, size))
    line = word + "\n"
    assert stable.line_chunks(line * 5, size) == [line * 5]  # 20 characters are a quarter, and no more
    assert stable.line_chunks(line * 6, size) == [line * 6] and stable.line_chunks(line * 7, size) == [line * 6, line]
    never = next(w for w in ("a" * n for n in range(30, 90)) if not stable.falls_on(w, size)) + "\n"
    assert stable.line_chunks(never * 3, size, len(never) + 5) == [never] * 3
    assert stable.line_chunks("One. Two three" + "x" * 20, 10, 16) == ["One.", " Two threexxxxxx", "x" * 14]


def test_zones_stay_whole_and_long_ones_split():
    fence = "```py\n" + "code line\n" * 30 + "```\n"
    text = "word one\n" * 3 + fence + "after\n"
    chunks = stable.markdown_chunks(text, 100, 1000)
    assert any(fence in c for c in chunks)
    long = "```\n" + ("code line\n" * 9 + "\n") * 8 + "```\n"
    chunks = stable.markdown_chunks(long, 100, 300)
    assert len(chunks) > 3 and all(c[0] in "c\n" for c in chunks[1:-1]) and "".join(chunks) == long
    items = "".join(f"- item {i} of the list\n  - inner {i}\n" for i in range(20))
    chunks = stable.markdown_chunks(items, 100, 1000)
    assert len(chunks) > 3 and stable.markdown_chunks(items, 10_000, 30_000) == [items]
    inside, splits = stable.zones(["- a\n", "\n", "- b\n", "text\n", "~~~\n", "- no item\n", "```\n", "~~~~\n", "1. c\n"], 1, 1)
    assert inside == [True, True, True, False, True, True, True, True, True] and splits == {2}


def test_front_matter_and_sentences():
    front = "---\ntitle: x\n---\n"
    assert stable.markdown_chunks(front) == [front] and stable.markdown_chunks(front + "body\n") == [front + "body\n"]
    chunks = stable.markdown_chunks(front + "some words. \n" * 40, 100)
    assert chunks[0].startswith(front + "some") and len(chunks) > 3
    text = "by Dr. Who e.g. this. Then"
    assert [i for i, c in enumerate(text) if c == "." and stable.ends_sentence(text, i)] == [20]
    assert stable.sentence_end(text, 0, 10) == 0 and stable.sentence_end(text, 0, 30) == 21
    assert stable.ends_sentence("end.", 3) and stable.ends_sentence("end.\nlow", 3) and not stable.ends_sentence("3.5", 1) and stable.ends_sentence("no. ", 2)


@pytest.mark.parametrize("cut", [stable.markdown_chunks, stable.line_chunks])
def test_an_edit_moves_few_borders(cut):
    r = random.Random(1)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(400)]
    kept = []
    for at in (0, 57, 200, 399):
        for edited in ([*lines[:at], "new line", *lines[at:]], [*lines[:at], *lines[at + 1 :]], [*lines[:at], lines[at] + "x", *lines[at + 1 :]]):
            a, b = cut("\n".join(lines), 1000), cut("\n".join(edited), 1000)
            kept.append(len(set(a) & set(b)) / len(a))
    assert sum(kept) / len(kept) > 0.85 and min(kept) > 0.6


def test_table_of_chunks(spark):
    docs = spark.createDataFrame([(1, "a b\n" * 900, 0), (2, "", 1), (3, None, 2), (None, "x", 3), (1, "again", 4)], "doc_id long, text string, seq long")
    got = sorted(map(tuple, chunking.chunk_table(docs, "doc_id").collect()))
    assert sum(len(r[2]) for r in got) == 3605 and {r[0] for r in got} == {1} and all(r[3] == stable.digest(r[2]) for r in got)


def test_long_lines_cut_by_length_alone():
    line = "One two. Three four. " * 3
    got = stable.line_chunks("head\n" + line + "\nend\n", 10, 16, sentences=False)
    assert got == ["head\n", *[(line + "\n")[at : at + 16] for at in range(0, 64, 16)], "end\n"]
    assert stable.line_chunks(line, 10, 16)[0] == "One two."
