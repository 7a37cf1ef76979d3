import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.sources import readers, sinks
from marlstone.streaming import streams


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


def test_formats_round_trip(spark, base):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        df.write.format(kind).option("header", "true").save(f"{base}/{kind}")
        got = readers.read(spark, f"{base}/{kind}", kind, "id long, s string", header="true")
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        readers.read(spark, base, "other")
    assert readers.exists(spark, f"{base}/orc") and not readers.exists(spark, f"{base}/none")


def test_note_folder(spark, tmp_path, base):
    for name, text in {"a/README.md": "# R\n![[pic.png|100]] ![x](y.jpg)", "a/NOTE.md": "---\ntitle: T\n---\nbody", "b/x.md": "---\nskip: true\n---\nno", "c/z.md": "zed", "drafts/d.md": "d", "a/other.txt": "t"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    notes = readers.notes_in_folder(spark, base, exclude=["%/drafts/%"])
    got = {r.path.rsplit("/", 1)[1]: r for r in notes.collect()}
    assert set(got) == {"README.md", "NOTE.md", "z.md"}
    assert got["README.md"].assets == ["pic.png", "y.jpg"] and got["NOTE.md"].front == "title: T" and got["NOTE.md"].body == "body"
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.folder_notes(notes).collect()) == ["NOTE.md", "z.md"]


def test_changes(spark):
    now = spark.createDataFrame([("a", 1), ("b", 5), ("c", 1), ("e", 1)], "path string, modified long")
    state = spark.createDataFrame([("b", 4, False), ("c", 1, False), ("d", 1, False), ("e", 1, True), ("f", 1, True)], "path string, seen long, archived boolean")
    assert {r.path: r.change for r in readers.changes(now, state).collect()} == {"a": "new", "b": "changed", "d": "deleted", "e": "returning"}


def test_pages_and_converters(spark):
    pages = spark.createDataFrame([("http://h/x", "<title> T </title><p>b"), ("bad", None)], "url string, html string")
    got = {r.url: r for r in readers.pages_as_notes(pages, lambda h: h[-1]).collect()}
    assert (got["http://h/x"].host, got["http://h/x"].title, got["http://h/x"].text) == ("h", "T", "b") and got["bad"].text == ""
    with pytest.raises(ValueError):
        readers.converted(pages)
    blobs = spark.createDataFrame([("p", bytearray(b"xyz"))], "path string, content binary")
    assert readers.converted(blobs, lambda b: bytes(b).decode().upper()).first().text == "XYZ"


def test_sinks(spark, base):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    sinks.write_ndjson(df, f"{base}/nd")
    assert spark.read.json(f"{base}/nd").first().s == "a"
    assert sinks.read_version(spark, f"{base}/t") is None
    for s in "xyb":
        sinks.replace(df.withColumn("s", F.lit(s)) if s == "x" else sinks.read_version(spark, f"{base}/t").withColumn("s", F.lit(s)), f"{base}/t")
    assert [r.s for r in sinks.read_version(spark, f"{base}/t").collect()] == ["b"]
    assert sinks.versions(spark, f"{base}/t") == [2, 3]
    for _ in range(2):
        sinks.append_once(df.unionByName(df), f"{base}/once", "id")
    assert spark.read.parquet(f"{base}/once").count() == 1
    assert [r.id for r in sinks.stream_rows(df)] == [1]


def run_all(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None


def test_a_crash_while_a_version_is_written_keeps_the_one_before(spark, base):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    sinks.replace(df, f"{base}/crash")
    df.withColumn("s", F.lit("half")).write.parquet(f"{base}/crash/version-2")
    os.remove(f"{base}/crash/version-2/_SUCCESS".removeprefix("file://"))  # what a crash before the commit leaves
    assert sinks.read_version(spark, f"{base}/crash").first().s == "a"
    sinks.replace(df.withColumn("s", F.lit("b")), f"{base}/crash")
    assert [r.s for r in sinks.read_version(spark, f"{base}/crash").collect()] == ["b"]


def test_queue_stream_folds_batches_once(spark, base):
    schema = "key long, kind string, at long"
    entities = spark.createDataFrame([(1, 100, 9), (2, 1, 0), (3, 1, 0)], "key long, mention_count long, retrieval_count long")
    spark.createDataFrame([(1, "extraction", 1), (1, "extraction", 2)], schema).write.parquet(f"{base}/in/0")
    source = streams.file_stream(spark, f"{base}/in/*", schema)

    def run():
        run_all(streams.queue_writer(source, f"{base}/state", entities, f"{base}/cp"))

    run()
    spark.createDataFrame([(1, "retrieval", 3), (2, "deletion", 4), (3, "retrieval", 5)], schema).write.parquet(f"{base}/in/1")
    run()
    run()

    def state():
        queue = {r.key: (r.evidence, r.status, r.priority) for r in sinks.read_version(spark, f"{base}/state/queue").collect()}
        return queue, {r.key: r.retrieval_count for r in sinks.read_version(spark, f"{base}/state/entities").collect()}

    want = {1: (2, "pending", 1.7), 2: (0, "pending", 1.0)}, {1: 10, 2: 0, 3: 1}
    assert state() == want
    # Killed between its two tables, the last batch is run again: it starts from the version before.
    last = max(sinks.versions(spark, f"{base}/state/queue"))
    local = base.removeprefix("file://")
    os.remove(f"{local}/state/entities/version-{last}/_SUCCESS")
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{local}/cp/commits/{name}")
    run()
    assert state() == want


def test_windows_and_duplicates(spark, base):
    rows = [(i, datetime(2024, 1, 1, 0, i)) for i in range(5)] + [(0, datetime(2024, 1, 1, 0, 1)), (9, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "id long, ts timestamp").write.parquet(f"{base}/ev/0")
    source = streams.file_stream(spark, f"{base}/ev/*", "id long, ts timestamp")
    run_all(streams.windowed_counts(source, "ts", []).writeStream.format("memory").queryName("w").outputMode("complete"))
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 6]
    run_all(streams.append_writer(source, f"{base}/kept", "id", f"{base}/cp2"))
    assert spark.read.parquet(f"{base}/kept").count() == 6
    run_all(streams.once(source, "id", "ts").writeStream.format("memory").queryName("o").outputMode("append"))
    assert spark.table("o").count() == 6
    run_all(streams.sessions(source, "ts", "id").writeStream.format("memory").queryName("s").outputMode("complete"))
    assert spark.table("s").count() == 6
