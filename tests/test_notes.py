import uuid

from pyspark.sql import functions as F

from marlstone.operators import notes


def test_uuids(spark):
    names = ["a", "7:click", "é:ü", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", notes.uuid_of(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_either_counts_a_row_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, h string")
    assert sorted(r.id for r in notes.either(rows, F.col("h") == "a", F.col("id") < 3).collect()) == [1, 2]
    assert sorted(r.id for r in notes.either(rows, F.col("h") == "a", F.col("id") == 3).collect()) == [1, 3]


def test_deltas(spark):
    texts = {"ok": True, "": False, "  ": False, "a\0b": False, "---\nx": False, "é" * 100_001: False, "é" * 100_000: True, None: False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in df.select("t", notes.valid_delta(F.col("t")).alias("ok")).collect()} == texts


def test_rerank_puts_the_rest_below(spark):
    rows = spark.createDataFrame([(1, i, float(-i)) for i in range(5)], "query_id long, id long, score double")
    got = {r.id: r.reranked for r in notes.rerank(rows, F.col("id") - 1.0, top=3).collect()}
    assert got[2] > got[1] > got[0] > got[3] > got[4]
