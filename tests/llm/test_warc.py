import gzip
import hashlib
import io
import json

import pytest

from marlstone.llm import warc as W


def folder(tmp_path):
    return f"file://{tmp_path}/warc"


def pages(spark, data, extra=""):
    return spark.createDataFrame(data, "page_id long, url string, html string" + extra)


def test_round_trip_and_revisits(spark, tmp_path):
    long = "<p>é" + "x" * 120
    data = [(5, "http://a", long), (3, "http://b\r\nX: y", long), (9, None, long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", "")]
    got = {r.page_id: r for r in W.round_trip(pages(spark, data), folder(tmp_path)).collect()}
    assert len(got) == 7
    for page_id, _, html in data:
        payload = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None),
    }


def test_archives_are_monolithic_and_then_a_member_a_record(spark, tmp_path):
    data = [(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(20)]
    raw = W.write_archives(W.mark_revisits(pages(spark, data)), folder(tmp_path) + "/raw")
    index = W.normalise(raw, folder(tmp_path) + "/members")
    for r in raw.collect():
        blob = open(r.archive.removeprefix("file://"), "rb").read()
        one = W.zlib.decompressobj(31)
        one.decompress(blob)
        assert one.eof and not one.unused_data
    for r in index.select("archive").distinct().collect():
        path = r.archive.removeprefix("file://")
        blob, lines = open(path, "rb").read(), [json.loads(x) for x in open(path + ".idx")]
        assert sum(x["length"] for x in lines) == len(blob)
        for x in lines:
            text = gzip.decompress(blob[x["offset"] : x["offset"] + x["length"]])
            assert text.startswith(b"WARC/1.1\r\n") and x["id"].encode() in text
    assert sorted(r.page_id for r in W.read_records(index).collect()) == list(range(20))


def test_streams_survive_any_chunking_and_reject_cut_files():
    records = b"".join(W.record_bytes(i, "u", b"\r\n\r\nWARC/1.1 " * i, "d", None) for i in range(5))
    for size in (1, 7, 1000):
        chunks = iter([records[i : i + size] for i in range(0, len(records), size)])
        stream, found = W.RecordStream(chunks), []
        while head := stream.head():
            found.append(b"".join(stream.block())[len(W.HTTP_HEAD) :])
        assert found == [b"\r\n\r\nWARC/1.1 " * i for i in range(5)]
    stream = W.RecordStream(iter([records[:-40]]))
    with pytest.raises(ValueError):
        while stream.head():
            pass
    packed = gzip.compress(records) + gzip.compress(records)
    assert b"".join(W.inflate(io.BytesIO(packed))) == records * 2


def test_edge_cases(spark, tmp_path):
    same = "z" * 200
    data = [(None, None, same), (1, "u", same), (1, "u", same), (2**60, "u", "big id")]
    got = W.round_trip(pages(spark, data), folder(tmp_path)).collect()
    assert sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to or 0) for r in got) == [(-1, "revisit", 1), (1, "response", 0), (1, "response", 0), (2**60, "response", 0)]
    assert W.round_trip(pages(spark, []), folder(tmp_path)).count() == 0
    clash = pages(spark, [(1, "u", "x", "d", "p", 3, 5)], ", digest string, payload string, first int, n int")
    assert W.round_trip(clash, folder(tmp_path)).count() == 1
