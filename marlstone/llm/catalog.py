"""The subpackage's queries, each over its whole table with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import fingerprints, line_dedup, ngram_join, phrases, quality, ranked_search, toxicity, warc
from marlstone.llm.ann import nearest
from marlstone.llm.common import crc_held_out, table
from marlstone.llm.decontam import contaminated
from marlstone.llm.html_text import extract_text
from marlstone.llm.licenses import scan_licenses
from marlstone.llm.packing import best_fit_pack


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC archives and back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _scores(spark: SparkSession, sf_dir: str, kind) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = kind.fit(docs, labels)
    return kind.scored(docs.select("doc_id", "text"), model).select("doc_id", crc_held_out().alias("held_out"), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, quality)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents under three-word Jaccard similarity of 0.9."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_chars", "n_lines_removed")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, toxicity)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edits."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    made = (op1_best_fit_packing, op2_warc, op3_decontamination, op4_quality_classifier, op5_license_scan, op6_ngram_jaccard_join, op7_html_text, op8_ann, op9_line_dedup, op10_toxicity, op11_phrases, op12_ranked_search, op13_fingerprints)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict:
    return {"op2_warc": warc.ORACLE, "op6_ngram_jaccard_join": ngram_join.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_phrases": phrases.ORACLE, "op12_ranked_search": ranked_search.ORACLE}
