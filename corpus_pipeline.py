"""The corpus pipeline: what a raw corpus goes through on its way to training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents. A clean document, that no rule names, leaves every stage as it came.

Rows of different texts are different documents, whatever their ids: rows that share an id are told apart by their texts, and rows
without one come last where the smallest id stays. Null texts count as empty, and an empty table stays empty. Further columns, whatever their names, come through as they are
(packing returns none of them); very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import bounded_batches, fresh_path, numbered, table
from factmill.llm.exact_dedup import exact_groups
from factmill.llm.packing import pack
from factmill.llm.quality import fit, measured, scores
from factmill.llm.simhash import near_duplicates
from factmill.llm.substring_dedup import drop_repeated_windows

#: A document goes if its calibrated score is lower.
LEAST_QUALITY = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that no column of docs begins with, whatever the case."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, fitted on all labelled documents of this corpus, doesn't reject. Rows without an id stay
    if their score says so; an unlabelled corpus stays whole (every score is then 0.5)."""
    bounded_batches(spark)
    row = _free(docs, "_row")
    rows = numbered(docs, row)
    stats = measured(rows, row)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    known = rows.select(F.col(row).alias("id"), "doc_id").join(labels, "doc_id").select("id", "y")
    rejected = scores(stats, fit(stats, known)).filter(F.col("score") < LEAST_QUALITY).select(F.col("id").alias(row)).distinct()
    return rows.join(rejected.hint("shuffle_hash"), row, "left_anti").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space keep one row: the longest text, then the smallest id. Of rows that repeat an id and a
    text, one stays too."""
    bounded_batches(spark)
    row = _free(docs, "_row")
    rows = numbered(docs, row)
    gone = exact_groups(rows.select(row, "text"), row).filter(~F.col("kept")).select(row).distinct()
    return rows.join(gone.hint("shuffle_hash"), row, "left_anti").dropDuplicates([row]).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more, linked through one another) keep the
    document with the smallest id."""
    bounded_batches(spark)
    row = _free(docs, "_row")
    rows = numbered(docs, row)
    gone = near_duplicates(rows.select(row, "text"), row).filter(F.col(row) != F.col("root")).select(row)
    return rows.join(gone.hint("shuffle_hash"), row, "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the words of passages of 50 words or more that a document with a smaller id has too; a document of which
    nothing stays goes. n_chars follows the text."""
    bounded_batches(spark)
    row, words, removed, kept = (_free(docs, c) for c in ("_row", "_words", "_removed", "_kept"))
    rows = numbered(docs, row)
    cut = drop_repeated_windows(rows.select(row, "text"), row, with_text=True).filter("n_removed > 0")
    changed = cut.select(row, F.col("n_words").alias(words), F.col("n_removed").alias(removed), F.col("kept").alias(kept)).dropDuplicates([row])
    joined = rows.join(changed.hint("shuffle_hash"), row, "left")
    return joined.filter(F.col(removed).isNull() | (F.col(removed) < F.col(words))).select(
        *(
            F.coalesce(kept, "text").alias(c)
            if c == "text"
            else F.when(F.col(kept).isNotNull(), F.char_length(kept).cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(c)
            for c in docs.columns
        )
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 2048."""
    bounded_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packing)]

#: The stages can't be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
