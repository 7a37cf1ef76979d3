import random

import duckdb
import pytest

from marlstone.llm import line_dedup as L

A, B, C = ("a " * 60).strip(), " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))


def run(spark, data, schema="doc_id long, text string", **kw):
    return {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(data, schema), counts=True, **kw).collect()}


def test_later_passages_go_and_short_ones_stay(spark):
    got = run(spark, [(1, f"x\n{A}\ny"), (2, f"{A}\nshort"), (3, f"q\n{B}\n{C}\nr"), (4, f"z\n{B}\n{C}"), (5, f"{B}\nother"), (6, "short\nshort")])
    assert [got[i].text for i in range(1, 7)] == [f"x\n{A}\ny", "short", f"q\n{B}\n{C}\nr", "z", f"{B}\nother", "short\nshort"]
    assert [got[i].n_lines_removed for i in range(1, 7)] == [0, 1, 0, 2, 0, 0]


def test_repeats_in_one_document_and_self_overlap(spark):
    line = " ".join(f"w{i}" for i in range(20))
    got = run(spark, [(1, f"{A}\nm\n{A}"), (2, "\n".join([line] * 8))])
    assert got[1].text == f"{A}\nm"
    assert got[2].text == "\n".join([line] * 3)  # the first stretch of 50 words stays


def test_blank_lines_nulls_repeated_rows_empty_table(spark):
    got = run(spark, [(1, f"{B}\n\n{C}"), (2, f"{B}\n \n{C}\n\nend"), (3, None), (4, "")])
    assert got[2].text == "\nend" and got[3].text is None and got[4].text == ""
    df = spark.createDataFrame([(1, A), (1, A), (None, A), (2, A)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in L.dedup_lines(df).collect()) == [(0, A), (1, A), (1, A), (2, "")]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_emptied_documents_may_go(spark):
    got = run(spark, [(1, A), (2, f"{A}\n \n"), (3, f"{A}\nmore"), (4, ""), (5, None), (6, " ")], drop_emptied=True)
    assert {i: r.text for i, r in got.items()} == {1: A, 3: "more", 4: "", 5: None, 6: " "}


def test_clashing_columns_and_n_chars(spark):
    got = run(spark, [(1, A, 3, 9, "k", 1), (2, A, 3, 9, "k", 1)], "doc_id long, text string, pos int, n_chars int, line string, doc int")
    assert got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(A) and got[2].pos == 3


def test_against_sql_over_every_stretch(spark):
    r = random.Random(9)
    pool = [" ".join(r.choice("abcdef") * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 12, 26, 55]))) for _ in range(25)]
    data = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(150)]
    got = run(spark, data)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    want = {x[0]: x[1] for x in con.execute(f"SELECT doc_id, text FROM ({L.ORACLE})").fetchall()}
    assert {i: x.text for i, x in got.items()} == want
    assert any(x.n_lines_removed for x in got.values())


def test_settings_that_would_miss_repeats_are_refused(spark):
    with pytest.raises(ValueError):
        L.repeated_intervals(spark.createDataFrame([(1, "x")], "doc_id long, text string"), min_words=20)


def test_runs_go_to_their_last_line(spark):
    got = run(spark, [(1, f"x\n{A}\n{B}\ny"), (2, f"{A}\n{B}\nother"), (3, f"{C}\n{B}"), (4, f"{A}\n{B}")])
    assert [got[i].text for i in range(1, 5)] == [f"x\n{A}\n{B}\ny", "other", f"{C}\n{B}", ""]
    assert [got[i].n_lines_removed for i in range(1, 5)] == [0, 2, 0, 2]


def all_runs(data, min_words=50):
    """The lines with words left after comparing every run of lines that holds enough words."""
    first, gone = {}, {}
    for doc, text in data:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()]
        gone[doc] = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= min_words:
                    at, end = first.setdefault(run, ((doc, a), lines[b][0]))
                    if at != (doc, a):
                        gone[doc] |= set(range(max(lines[a][0], end + 1) if at[0] == doc else lines[a][0], lines[b][0] + 1))
    return {doc: [x for i, x in enumerate(text.split("\n")) if x.split() and i not in gone[doc]] for doc, text in data}


def test_runs_against_every_run(spark):
    r = random.Random(10)
    pool = [" ".join(r.choice("abcdef") * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 12, 26, 30, 55, 60]))) for _ in range(20)]
    data = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(150)]
    data += [(150 + i, "\n".join(data[i][1].split("\n")[1:] + pool[:2])) for i in range(40)]
    left = {i: [x for x in row.text.split("\n") if x.split()] for i, row in run(spark, data).items()}
    assert left == all_runs(data)
