"""Checks that decide whether a query may be answered from its evidence, and answers made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import has_contradiction
from .filters import drop_uncertain, expects_numeric

# Fixed values.
RISKY_TYPES = ("program_fee_schedule", "admissions_cycle", "scholarship", "merit_list")
RISKY_CLASSES = ("policy", "admissions_cycle", "scholarship", "merit_list")


def answer_gates(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, status, clean (rows kept): the first gate that fails names the status, else answerable.

    In order: no evidence, all uncertain, a numeric question without a number, an incomplete citation, a contradiction."""
    clean = drop_uncertain(evidence)
    kept = F.col("reason").isNull()
    facts = clean.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.count_if(kept).alias("clean"), F.bool_or(kept & F.col("text").rlike("[0-9]")).alias("number"),
        F.bool_and(~kept | (F.coalesce("source_url", F.lit("")) != "")).alias("cited"),
    )
    torn = has_contradiction(clean.filter(kept))
    joined = queries.join(facts, "query_id", "left").join(torn, "query_id", "left")
    status = (
        F.when(F.col("rows").isNull(), "no_evidence").when(F.col("clean") == 0, "uncertain")
        .when(expects_numeric(F.col("query_text")) & ~F.coalesce("number", F.lit(False)), "no_number")
        .when(~F.col("cited"), "uncited").when(F.coalesce("contradictory", F.lit(False)), "contradictory").otherwise("answerable")
    )
    return joined.select("query_id", status.alias("status"), F.coalesce("clean", F.lit(0)).alias("clean"))


def _numbered(evidence: DataFrame, order: list[Column]) -> DataFrame:
    from pyspark.sql import Window

    return evidence.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def number_citations(evidence: DataFrame, order: list[Column]) -> DataFrame:
    """Evidence that can be cited, with its number n among all of its query's rows: rows without a URL or a locator are left out, and leave a gap."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return _numbered(evidence, order).filter(some("source_url") & some("locator"))


def answer_extractive(evidence: DataFrame, order: list[Column]) -> DataFrame:
    """One answer of a query: each row as a claim with its number, in order. Evidence is what retrieval selected, a few rows a query."""
    lines = _numbered(evidence, order).select("query_id", "n", F.concat(F.col("text"), F.lit(" ["), F.col("n"), F.lit("]")).alias("line"))
    return lines.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("answer"), F.max("n").alias("citations")
    )


def validate_citations(claims: DataFrame) -> DataFrame:
    """claims (query_id, cited array, known array) -> status and the unknown ids."""
    unknown = F.array_except("cited", "known")
    status = F.when(F.size("cited") == 0, "missing").when(F.size(unknown) > 0, "unknown").otherwise("valid")
    return claims.select("query_id", status.alias("status"), F.array_sort(unknown).alias("unknown"))


def grounding_score(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    """claims (query_id, supported, has_evidence): supported share, 1 without claims; a claim without evidence isn't supported."""
    ok = F.when(F.col("supported").isNull(), None).otherwise((F.col("supported") & F.col("has_evidence")).cast("int"))
    out = claims.groupBy("query_id").agg(F.round(F.coalesce(F.avg(ok), F.lit(1.0)), 6).alias("score"))
    return out.withColumn("passed", F.col("score") >= threshold)


def grounding_mode(evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """full if any row is of a risky type or source class or scores under the limit, else skip."""
    risky = F.coalesce(F.col("record_type").isin(*RISKY_TYPES), F.lit(False)) | F.coalesce(F.col("source_class").isin(*RISKY_CLASSES), F.lit(False))
    return evidence.groupBy("query_id").agg(F.when(F.bool_or(risky) | (F.min("score") < least), "full").otherwise("skip").alias("mode"))


def finalize_answers(gates: DataFrame, citations: DataFrame, grounding: DataFrame) -> DataFrame:
    """Final status of each query: the gate's, else an invalid citation, else a failed grounding check, else answered."""
    c, g = citations.select("query_id", F.col("status").alias("cited")), grounding.select("query_id", "passed", "mode")
    joined = gates.join(c, "query_id", "left").join(g, "query_id", "left")
    status = (
        F.when(F.col("status") != "answerable", F.col("status")).when(F.coalesce("cited", F.lit("missing")) != "valid", "invalid_citation")
        .when((F.col("mode") == "full") & ~F.coalesce("passed", F.lit(True)), "ungrounded").otherwise("answered")
    )
    return joined.select("query_id", status.alias("status"))


def mixed_levels(fees: DataFrame) -> DataFrame:
    """query_id, levels: degree prefixes of fee rows (slug) whose programme occurs with several; needs two rows."""
    prefix = F.regexp_extract("slug", r"^(bs|ms|phd|mba|emba|be|me)[-_]", 1)
    base = F.regexp_replace("slug", r"^(bs|ms|phd|mba|emba|be|me)[-_]", "")
    rows = fees.withColumn("p", prefix).withColumn("b", base).filter("p <> ''")
    per = rows.groupBy("query_id", "b").agg(F.collect_set("p").alias("ps")).filter(F.size("ps") > 1)
    return per.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("ps", F.upper))))).alias("levels"))


def audit_rendering(records: DataFrame, fields: list[str], rendered: str = "rendered") -> DataFrame:
    """Rows with the fields whose text isn't in the rendering, without regard to case."""
    missing = F.array_compact(F.array(*(F.when((F.coalesce(f, F.lit("")) != "") & ~F.contains(F.lower(rendered), F.lower(f)), F.lit(f)) for f in fields)))
    return records.withColumn("missing", missing).filter(F.size("missing") > 0)
