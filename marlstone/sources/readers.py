"""Sources: tables, text formats, note folders, pages, and change detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.operators.filters import top_per_group

FORMATS = ("parquet", "orc", "csv", "json", "text", "xml", "binaryFile")
NOTE_FILES = ("NOTE.md", "README.md", "index.md")


def read(spark: SparkSession, path: str | list[str], kind: str = "parquet", schema=None, **options: str) -> DataFrame:
    """Any Hadoop path (file, s3a, gs, hdfs, viewfs) in one of FORMATS; give a schema for csv and json in production."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def files(spark: SparkSession, path: str, pattern: str = "*", contents: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) below a folder."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return out if contents else out.drop("content")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def front_matter(text: Column) -> Column:
    """What stands between leading --- lines, or null."""
    found = F.regexp_extract(text, r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    return F.when(found != "", found)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def asset_links(text: Column) -> Column:
    """Targets of embedded wiki links and images, each once."""
    wiki = F.regexp_extract_all(text, F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    images = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    return F.array_distinct(F.concat(wiki, images))


def notes_in_folder(spark: SparkSession, path: str, exclude: list[str] | None = None, skip_marker: str = "skip: true") -> DataFrame:
    """(path, text, front, body, assets, modified) of markdown files; files whose front matter holds the marker are left out.

    ``exclude``: SQL LIKE patterns of paths.
    """
    rows = files(spark, path, "*.md").select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    for like in exclude or []:
        rows = rows.where(~F.col("path").like(like))
    rows = rows.withColumns({"front": front_matter(F.col("text")), "body": body(F.col("text"))}).withColumn("assets", asset_links(F.col("body")))
    return rows.where(~F.coalesce(F.contains(F.col("front"), F.lit(skip_marker)), F.lit(False)))


def folder_notes(notes: DataFrame) -> DataFrame:
    """One note a folder: NOTE.md before README.md before index.md, else the first by name."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/[^/]*$", "")
    rank = F.coalesce(*[F.when(name == n, F.lit(i)) for i, n in enumerate(NOTE_FILES)], F.lit(len(NOTE_FILES)))
    return top_per_group(notes.withColumns({"folder": folder, "_rank": rank}), ["folder"], [F.asc("_rank"), F.asc("path")], 1).drop("_rank")


def changes(current: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change) of a scan (path, modified) against a state (path, seen, archived):
    new, changed (newer), returning (archived and there again), deleted; others are left out."""
    both = current.select("path", "modified").join(state.select("path", "seen", "archived"), "path", "full")
    change = (
        F.when(F.col("modified").isNull(), F.when(~F.coalesce("archived", F.lit(False)), "deleted"))
        .when(F.col("seen").isNull(), "new")
        .when(F.col("archived"), "returning")
        .when(F.col("modified") > F.col("seen"), "changed")
    )
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def change_log(listings: DataFrame, last: Column | None = None) -> DataFrame:
    """(path, scan, change) of all scans of a folder at once, from (path, modified, scan) with scans numbered one by one: new, changed (later than
    what was there since it came), returning and deleted, each with the scan that shows it. ``last`` is the newest scan's number, if not all scans list files.

    Stretches of scans that list a path without a gap are found by windows over its rows alone, so nothing is compared scan by scan.
    Rows with a null are left out; of a path listed twice in a scan the latest time counts.
    """
    one = listings.where("path IS NOT NULL AND modified IS NOT NULL AND scan IS NOT NULL").groupBy("path", "scan").agg(F.max("modified").alias("modified"))
    order = W.partitionBy("path").orderBy("scan")
    before, after = F.lag("scan").over(order), F.lead("scan").over(order)
    starts = F.coalesce(before < F.col("scan") - 1, F.lit(True))
    rows = one.withColumns({"_starts": starts, "_first": before.isNull(), "_ends": F.coalesce(after > F.col("scan") + 1, F.lit(True))})
    rows = rows.withColumn("_stretch", F.sum(F.col("_starts").cast("int")).over(order))
    highest = F.max("modified").over(W.partitionBy("path", "_stretch").orderBy("scan").rowsBetween(W.unboundedPreceding, -1))
    there = F.when(F.col("_first"), "new").when(F.col("_starts"), "returning").when(F.col("modified") > highest, "changed")
    told = rows.withColumn("change", there)
    newest = one.agg((F.max("scan") if last is None else F.greatest(F.max("scan"), last)).alias("_newest"))
    gone = rows.where("_ends").join(F.broadcast(newest), F.col("scan") < F.col("_newest"))  # one row is broadcast
    return told.where("change IS NOT NULL").select("path", "scan", "change").unionByName(gone.select("path", F.expr("scan + 1").alias("scan"), F.lit("deleted").alias("change")))


def pages_as_notes(pages: DataFrame, extract) -> DataFrame:
    """(url, host, title, text) of raw pages; ``extract`` is a function from html to text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "html": pdf["html"], "text": [extract(h) if h else "" for h in pdf["html"]]})

    rows = pages.select("url", "html").mapInPandas(run, "url string, html string, text string")
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return rows.select("url", F.parse_url("url", F.lit("HOST")).alias("host"), title.alias("title"), "text")


def converted(rows: DataFrame, converter=None) -> DataFrame:
    """Binary files to text by an optional converter (PDF and office libraries are not part of this package)."""
    if converter is None:
        raise ValueError("give a function from bytes to text; no converter for office files is built in")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [converter(c) for c in pdf["content"]]})

    return rows.select("path", "content").mapInPandas(run, "path string, text string")
