"""WARC archives: writing, normalising monolithic gzip, reading by offset.

``write_archives`` turns rows into WARC records inside one gzip stream a file,
as bulk exporters often do; such a file can only be read from its start.
``normalise`` inflates each stream once, writes every record as a gzip member
of its own and beside the archive an index of (offset, length, record id, type),
after which ``read_records`` fetches any record by its offset.

All three work on streams with bounded memory, whatever a record's or a file's
size. Files get a new name in every attempt of a task and are found only through
the rows of the attempt that succeeded, so retried or speculative tasks leave
unused files but never wrong ones. Files are opened through Arrow's file systems
(local and shared folders, S3, GCS, HDFS).

Defined cases: a null html is an empty payload; a null url leaves the target out;
a null page_id leaves the id out and comes back null. Of equal payloads of at
least ``min_revisit`` bytes, rows with the smallest page_id are responses (all of
them, if that row is repeated; all rows, if none has an id), others revisits.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fanout_join, fresh_path, materialise

MIN_REVISIT, FILE_BYTES, CHUNK, MAX_TASKS = 100, 256 << 20, 1 << 20, 10_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


# ---------------------------------------------------------------- records


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _clean(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": PROFILE if revisit else None,
        "X-Page-Id": page_id,
        "X-Payload-Length": len(payload),
        "X-Refers-To-Page": refers_to,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class RecordStream:
    """Records of a WARC byte stream: ``head()`` gives the next header and its
    bytes, then ``block()`` its block in chunks."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.buffer, self.left = chunks, b"", 0

    def _more(self) -> bool:
        chunk = next(self.chunks, b"")
        self.buffer += chunk
        return bool(chunk)

    def head(self) -> tuple[dict[str, str], bytes] | None:
        for _ in self.block():  # what the caller has left
            pass
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            at = self.buffer.find(b"\r\n\r\n")
            if at >= 0:
                break
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends inside a record header")
                return None
        raw, self.buffer = self.buffer[: at + 4], self.buffer[at + 4 :]
        version, *lines = raw.decode("utf-8", "replace").strip().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = dict(map(str.strip, x.split(":", 1)) for x in lines)
        self.left = int(head["Content-Length"])
        return head, raw

    def block(self) -> Iterator[bytes]:
        while self.left:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends inside a record")
            part, self.buffer = self.buffer[: self.left], self.buffer[self.left :]
            self.left -= len(part)
            yield part


def inflate(source: IO[bytes], size: int | None = None) -> Iterator[bytes]:
    """Chunks of a gzip file of one or many members, at most ``size`` compressed bytes of it."""
    inflater, left = zlib.decompressobj(31), size
    while data := source.read(CHUNK if left is None else min(CHUNK, left)):
        left = None if left is None else left - len(data)
        while data:
            out = inflater.decompress(data, CHUNK)
            if out:
                yield out
            data = inflater.unconsumed_tail
            if inflater.eof:
                data, inflater = inflater.unused_data, zlib.decompressobj(31)
    if tail := inflater.flush():
        yield tail


def _fs(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


def _new_file(folder: str, suffix: str) -> str:
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


# ---------------------------------------------------------------- operators


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    equal = rows.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    marked = fanout_join(rows, equal.where("n > 1").select("digest", "first"), "digest", F.struct("page_id", "url"))
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return marked.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes monolithic gzip archives; a row (archive, records) a file."""

    def write(batches):
        out, path, packer, n, size = None, "", None, 0, 0
        for pdf in batches:
            for page_id, url, payload, digest, refers in zip(*(pdf[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    path, packer, n, size = _new_file(folder, ".warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    fs, at = _fs(path)
                    out = fs.open_output_stream(at, compression=None)
                data = record_bytes(None if pd.isna(page_id) else int(page_id), url, payload, digest, None if pd.isna(refers) else int(refers))
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [path], "records": [n]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pd.DataFrame({"archive": [path], "records": [n]})

    # A nullable long must not pass through pandas as a float: ids stay exact as text.
    exact = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(exact.mapInPandas(write, "archive string, records long"), "warc-manifest")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a gzip member a record; returns and writes the index.

    The sidecar of ``x.warc.gz`` is ``x.warc.gz.idx``: a JSON line a record.
    """

    def rewrite(batches):
        for pdf in batches:
            for archive in pdf["archive"]:
                path = _new_file(folder, ".warc.gz")
                fs, at = _fs(archive)
                to, to_at = _fs(path)
                offset = 0
                with fs.open_input_stream(at, compression=None) as source, to.open_output_stream(to_at, compression=None) as out, to.open_output_stream(to_at + ".idx", compression=None) as side:
                    records, rows = RecordStream(inflate(source)), []
                    while found := records.head():
                        head, raw = found
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        length = out.write(packer.compress(raw))
                        for part in records.block():
                            length += out.write(packer.compress(part))
                        length += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        row = (path, offset, length, head.get("WARC-Record-ID"), head.get("WARC-Type"))
                        side.write((json.dumps(dict(zip(("offset", "length", "id", "type"), row[1:]))) + "\n").encode())
                        offset += length
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id", "record_type"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id", "record_type"])

    # A number of its own keeps the planner from putting these few, small rows into one task.
    spread = archives.select("archive").repartition(max(1, min(archives.count(), MAX_TASKS)), "archive")
    return materialise(spread.mapInPandas(rewrite, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """A row for each indexed record, from the archives' own bytes."""

    def read(batches):
        open_at, source = None, None
        for pdf in batches:
            rows = []
            for archive, offset, length in zip(pdf["archive"], pdf["offset"], pdf["length"]):
                if archive != open_at:
                    fs, at = _fs(archive)
                    open_at, source = archive, fs.open_input_file(at)
                source.seek(offset)
                records = RecordStream(inflate(source, length))
                head, _ = records.head()
                kind, digest, n, skip = head["WARC-Type"], hashlib.sha256(), 0, len(HTTP_HEAD)
                for part in records.block():
                    part, skip = part[skip:], max(0, skip - len(part))
                    digest.update(part)
                    n += len(part)
                if kind == "revisit":
                    n, hexed = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].split(":")[1]
                else:
                    hexed = digest.hexdigest()
                rows.append((head.get("X-Page-Id"), n, hexed, kind, head.get("X-Refers-To-Page"), head.get("WARC-Target-URI")))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
            for c in ("page_id", "refers_to"):
                out[c] = pd.array([None if v is None else int(v) for v in out[c]], dtype="Int64")
            yield out

    return index.select("archive", "offset", "length").mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives, normalises them and reads every record back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    written = write_archives(mark_revisits(pages), f"{folder}/raw")
    return read_records(normalise(written, f"{folder}/members"))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), d AS (
  SELECT page_id, payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""
