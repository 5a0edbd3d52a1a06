"""The registered queries opN_<name> with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import bounded_batches, fresh_path, table
from .exact_dedup import exact_groups
from .lm_scoring import lm_scores, training_rows
from .packing import pack
from .periodic_runs import periodic_runs
from .quality import quality_scores
from .quality_rules import COUNTS, quality_rules
from .simhash import simhash_components
from .substring_dedup import drop_repeated_windows
from .suffix_dedup import drop_repeated_bytes
from .token_alignment import token_alignment
from .topk_search import top_k
from .warc import archive, read_bundles


def op6_exact_dedup(spark, sf_dir):
    bounded_batches(spark)
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    bounded_batches(spark, 12 << 20)
    return lm_scores(table(spark, sf_dir, "documents"), training_rows())


def op1_suffix_dedup(spark, sf_dir):
    bounded_batches(spark)
    return drop_repeated_bytes(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    bounded_batches(spark)
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark, sf_dir):
    bounded_batches(spark)
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    bounded_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_topk_search(spark, sf_dir):
    bounded_batches(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc(spark, sf_dir):
    bounded_batches(spark)
    folder = fresh_path(spark, "warc")
    return read_bundles(spark, folder, archive(table(spark, sf_dir, "pages"), folder))


def op8_substring_dedup(spark, sf_dir):
    bounded_batches(spark)
    return drop_repeated_windows(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    bounded_batches(spark, 8 << 20)  # the transducer's states take most of a worker's memory
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def rewritten(doc_id, n: int):
    """The places of the words that a document's n words are taken from, or None where it stays as it is (as one without an id does)."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    moved = np.arange(n)
    moved[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return moved


def op11_periodic_runs(spark, sf_dir):
    bounded_batches(spark)
    found = periodic_runs(table(spark, sf_dir, "documents"), arrange=rewritten)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark, sf_dir):
    bounded_batches(spark)
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def op13_token_alignment(spark, sf_dir):
    bounded_batches(spark, 8 << 20)
    return token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality, op3_simhash, op4_packing, op5_topk_search, op6_exact_dedup, op7_warc, op8_substring_dedup, op9_byte_bpe, op10_lm_scoring,
        op11_periodic_runs, op12_quality_rules, op13_token_alignment,
    )
}

ORACLE = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
q AS (
  SELECT page_id, size AS payload_bytes, sha1(payload) AS payload_digest,
         CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to FROM q""",
    "op5_topk_search": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op6_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
}
