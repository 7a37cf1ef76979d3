"""From raw documents to packed bins, in five stages over whole tables.

Each stage takes all its predecessor kept and, but for the last, returns the
columns of documents. Between stages the rows are written to the shared folder
and read again, so a lost executor never reaches back beyond the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import quality
from marlstone.llm.common import materialise, release, table
from marlstone.llm.decontam import decontaminate
from marlstone.llm.line_dedup import dedup_lines
from marlstone.llm.ngram_join import keep_one
from marlstone.llm.packing import best_fit_pack


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score_col="_q_score", predicted_col="_q_kept").where("_q_kept = 1").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of whole runs of 50 words and more, and documents that have no words left."""
    return dedup_lines(docs, drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 or more."""
    return keep_one(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark item contaminates."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row a piece."""
    return best_fit_pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. They are read from tables in the shared folder, which stay until ``release``; see ``write``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Runs the pipeline into a Parquet folder and then deletes the tables between its stages."""
    try:
        run(spark, sf_dir).write.parquet(path)
    finally:
        release(spark)
