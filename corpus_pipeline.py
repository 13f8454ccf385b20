"""From documents to encoded training text: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm import decontamination, jaccard, line_dedup, quality
from planwright.llm.queries import encoded
from planwright.llm.text import SPACED_WORD, fingerprint, where_computed
from planwright.session import materialize
from planwright.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject; lines above the limits leave those that stay."""
    columns = docs.columns
    return where_computed(quality.quality_rules(docs, keep_text=True), F.col("kept")).select(*columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each line to the smallest doc_id that holds it; documents left without a word go."""
    out = where_computed(line_dedup.dedup_lines(docs), (F.col("n_dropped") == 0) | F.col("kept_text").rlike(SPACED_WORD))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return out.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def _by_text(docs: DataFrame) -> DataFrame:
    """`docs` with (doc_id, fingerprint of the text) for doc_id: rows with one id, null included, and different texts stay apart."""
    return docs.withColumn("doc_id", F.struct("doc_id", fingerprint(F.col("text")).alias("fp")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 similarity on five-word shingles connect, the one with the smallest doc_id stays.

    Rows with one doc_id, null included, and different texts are documents of their own, the smallest fingerprint first;
    of rows equal in both doc_id and text one stays.
    """
    keyed = _by_text(docs)
    found = jaccard.near_duplicates(keyed, size=5, percent=80)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    chosen = keyed.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return chosen.dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id.doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any window of a benchmark item; others with the same or a null doc_id stay."""
    keyed = _by_text(docs)
    found = decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"))
    leaks = found.where("contaminated").select(F.col("doc_id").alias("_leak")).distinct()
    return keyed.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti").withColumn("doc_id", F.col("doc_id.doc_id"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, checked by decoding them."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: The last stage is no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
