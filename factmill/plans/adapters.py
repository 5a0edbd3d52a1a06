"""Record, source and evidence views over the driver's tables, for the registered queries; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("policy_rule", "program", "merit_list", "faculty_profile", "university_info")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """documents (the table's, unless given, as for a stream of them) left join labels as record versions."""
    d = table(spark, sf_dir, "documents") if documents is None else documents
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    choose = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    return d.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("d"), i).alias("record_version_id"),
        F.concat(F.lit("r"), i % 400).alias("record_id"),
        choose(5, TYPES).alias("record_type"),
        F.concat(F.lit("https://"), "source", F.lit(".example.edu/"), "lang").alias("source_url"),
        (1 + i % 5).cast("int").alias("tier"),
        F.concat_ws(":", "source", "lang").alias("scope"),
        F.sha2("text", 256).alias("dedupe_key"),
        F.sha2(F.lower("text"), 256).alias("effective_hash"),
        choose(2, ("fall-2024", "spring-2025")).alias("cycle_label"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("unknown").alias("year_confidence"),
        F.timestamp_add("MINUTE", i.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("fetched_at"),
        F.when(i % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int"))).alias("effective_from"),
        F.when(i % 6 == 0, F.lit("2024-06-30").cast("date")).alias("effective_to"),
        F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("verification"),
        F.when(i % 7 == 0, "stale").otherwise("current").alias("freshness"),
        choose(3, ("eligible", "pending_index", "ineligible")).alias("serving"),
        ((F.col("quality") == 1) & (i % 7 != 0)).alias("authoritative"),
        "text",
        "lang",
        "source",
    )


RECORDS_SQL = """rec AS (
  SELECT d.doc_id, 'd' || d.doc_id AS record_version_id, 'r' || (d.doc_id % 400) AS record_id,
    ['policy_rule', 'program', 'merit_list', 'faculty_profile', 'university_info'][d.doc_id % 5 + 1] AS record_type,
    'https://' || source || '.example.edu/' || lang AS source_url, CAST(1 + d.doc_id % 5 AS INTEGER) AS tier,
    source || ':' || lang AS scope, sha256(text) AS dedupe_key, sha256(lower(text)) AS effective_hash,
    ['fall-2024', 'spring-2025'][d.doc_id % 2 + 1] AS cycle_label,
    CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'unknown' END AS year_confidence,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS fetched_at,
    CASE WHEN d.doc_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(d.doc_id % 300 AS INTEGER) END AS effective_from,
    CASE WHEN d.doc_id % 6 = 0 THEN DATE '2024-06-30' END AS effective_to,
    CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' ELSE 'pending' END AS verification,
    CASE WHEN d.doc_id % 7 = 0 THEN 'stale' ELSE 'current' END AS freshness,
    ['eligible', 'pending_index', 'ineligible'][d.doc_id % 3 + 1] AS serving,
    quality = 1 AND d.doc_id % 7 <> 0 AS authoritative, text, lang, source
  FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct source URLs of records with a class and a legal status."""
    d = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return d.select("source", "lang").distinct().select(
        F.concat(F.lit("https://"), "source", F.lit(".example.edu/"), "lang").alias("source_url"),
        F.when(number % 7 == 0, "blocked").when(number % 5 == 0, F.lit(None)).otherwise("allowed").alias("legal_status"),
        F.when(number % 4 == 0, "policy").when(number % 4 == 1, "admissions_cycle").when(number % 4 == 2, "faculty").otherwise("document_asset").alias("source_class"),
        (number % 6 != 5).alias("is_active"),
    )


SOURCES_SQL = """src AS (
  SELECT 'https://' || source || '.example.edu/' || lang AS source_url,
    CASE WHEN n % 7 = 0 THEN 'blocked' WHEN n % 5 = 0 THEN NULL ELSE 'allowed' END AS legal_status,
    CASE n % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'admissions_cycle' WHEN 2 THEN 'faculty' ELSE 'document_asset' END AS source_class,
    n % 6 <> 5 AS is_active
  FROM (SELECT DISTINCT source, lang, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS n FROM documents))"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as visits of sources."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 200).alias("source_id"), F.col("ts"), (F.col("event_type") != "error").alias("ok"), "event_id"
    )


VISITS_SQL = "vis AS (SELECT 's' || (user_id % 200) AS source_id, ts, event_type <> 'error' AS ok, event_id FROM events)"
