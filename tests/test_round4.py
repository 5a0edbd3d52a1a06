"""Results that differed from their SQL on larger tables or odd texts, and memory of executors."""

from __future__ import annotations

from pyspark.sql import functions as F

from factmill.llm import token_alignment

from .llm.test_rules_runs_alignment import PATHS
from .test_round3 import equal


def test_long_sections_of_one_part_are_split(spark, tmp_path):
    """Separators that follow each other are left out, so a text over the limit may give one part."""
    texts = [(mark * 1000)[:n] + "end" for mark in ("ab  ", "ab. . ", "ab\n\n\n\n") for n in range(1840, 2000, 2)]
    documents = spark.createDataFrame([(i, t, "en", "s1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = equal(spark, tmp_path, "k1_chunks", documents=documents, labels=spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert {r.split for r in rows} == {True, False}


def test_records_that_share_an_id_keep_their_chunks(spark, tmp_path):
    documents = spark.createDataFrame([(i % 7, f"text {i} " * (i * 20), "en", "s1") for i in range(1, 22)], "doc_id long, text string, lang string, source string")
    rows = equal(spark, tmp_path, "k1_chunks", documents=documents, labels=spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int"))
    assert len(rows) == 24


def test_blanks_before_a_last_line_end_beyond_ascii_stay(spark, tmp_path):
    texts = ["ab \u0085", "ab  ", " \n ab \n", "ab\r\n  "]
    documents = spark.createDataFrame([(i, texts[i // 5], "en", "s1") for i in range(20)], "doc_id long, text string, lang string, source string")
    equal(spark, tmp_path, "k1_chunks", documents=documents, labels=spark.createDataFrame([(0, 1)], "doc_id long, quality int"))


def test_aligned_slices_are_written_as_small_rows(spark, tmp_path, monkeypatch):
    """A slice's texts and pairs are rows of their own, so that readers and writers, which hold many rows, hold few slices."""
    monkeypatch.setattr(token_alignment, "fresh_path", lambda *_: f"file://{tmp_path}/slices")
    texts = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one text of"), "id", F.lit("words")).alias("text"))
    assert token_alignment.token_alignment(texts, *PATHS).count() == 300
    rows = spark.read.parquet(f"{tmp_path}/slices").collect()
    lists = [v for r in rows for v in r if isinstance(v, list)]
    assert len(rows) > 300 and len(lists) == 600 and max(map(len, lists)) < 50
