"""A training-data pipeline over ``documents``, each stage one of the operators in ``quire.llm``.

Every stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, lines, near, packing
from quire.llm.common import join_small, materialize

MIN_SCORE = 0.4


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    new = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long"))
    return new.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those of no letter, or whose words have a mean confidence below 0.4, go.

    A word's confidence is the share of its own best label, so that a text of several languages stays. Where
    nothing could be learned, every document with a letter stays.
    """
    crf = langid.fit(docs.select("doc_id", "text", "lang"))
    if not crf.languages:
        return docs.where(F.rlike("text", F.lit("\\p{L}")))
    found = langid.predict(docs, crf, confidence="confidence")
    return found.where((F.col("lang_pred") != "und") & (F.col("confidence") >= MIN_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document holds first are cut; a document of which nothing but white space stays goes."""
    found = lines.dedup_lines(docs)
    blank = (F.col("n_dropped") > 0) & ~F.rlike("kept_text", F.lit("[^\\x20\\x09-\\x0D]"))
    return _with_text(found.where(~blank), docs.columns, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash near-dedup links at 0.8 similarity of five-word shingles, one row stays.

    It is that of the smallest doc_id, null last; of rows that repeat the doc_id, that of the least shingle
    signature, then the first row.
    """
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    group = materialize(near.near_groups(rows.select("row", "doc_id", "text")), "groups")
    least = group.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "sig", "row"))["row"].alias("least"))
    gone = group.join(least, "component").where(F.col("row") != F.col("least"))
    return join_small(rows, materialize(gone.select("row"), "copies"), "row", "left_anti").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents of which they make up more than half go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = found.where(F.col("clean_text").isNotNull() | ~F.col("contaminated"))
    return _with_text(kept, docs.columns, "clean_text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all kept documents, with their ids and their places in sequences of 1024."""
    return packing.pack(docs, max_words=600_000, keep_words=False)  # workers of other stages stay idle beside these for a while


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
