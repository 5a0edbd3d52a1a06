"""Duplicate facts: primaries, links between copies, conflicts, and authority by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import can_serve


def resolve_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Primaries (dedupe_key, record_version_id), links (primary, supporting) and conflicts (dedupe_key, conflict_ids).

    Over rows that can serve: the least tier of a key decides; with one effective hash in it the smallest version id is primary
    and every other servable row of that hash supports it; with several the key is in conflict. Aggregates only, so a key
    with very many copies is combined before it is shuffled."""
    rows = df.filter(can_serve())
    per = rows.groupBy("dedupe_key", "tier").agg(
        F.min("effective_hash").alias("low"), F.max("effective_hash").alias("high"), F.min("record_version_id").alias("first")
    )
    top = per.groupBy("dedupe_key").agg(F.min_by(F.struct("tier", "low", "high", "first"), "tier").alias("t")).select("dedupe_key", "t.*")
    single = top.filter("low = high")
    primaries = single.select("dedupe_key", F.col("first").alias("record_version_id"))
    links = (
        rows.select("dedupe_key", F.col("effective_hash").alias("low"), F.col("record_version_id").alias("supporting"))
        .join(single.select("dedupe_key", "low", F.col("first").alias("primary")), ["dedupe_key", "low"])
        .filter("supporting <> primary")
        .select("primary", "supporting")
    )
    torn = top.filter("low <> high").select("dedupe_key", "tier")
    conflicts = rows.join(torn, ["dedupe_key", "tier"]).groupBy("dedupe_key").agg(F.array_sort(F.collect_set("record_version_id")).alias("conflict_ids"))
    return primaries, links, conflicts


def resolve_authority(df: DataFrame, scope: str = "scope") -> DataFrame:
    """Per scope: insufficient without a current verified row, contradictory if its least tier holds several values, else the
    primary (smallest version id) and how many rows of the same dedupe key support it."""
    good = df.filter("verification = 'verified' and freshness = 'current'")
    per = good.groupBy(scope, "tier").agg(
        F.min("effective_hash").alias("low"), F.max("effective_hash").alias("high"), F.min(F.struct("record_version_id", "dedupe_key")).alias("first"),
        F.array_sort(F.collect_set("record_version_id")).alias("ids"),
    )
    top = per.groupBy(scope).agg(F.min_by(F.struct("low", "high", "first", "ids"), "tier").alias("t")).select(scope, "t.*")
    copies = good.groupBy(scope, F.col("dedupe_key").alias("k")).agg(F.count("*").alias("n"))
    joined = (
        df.select(scope).distinct().join(top, scope, "left").withColumn("k", F.col("first.dedupe_key")).join(copies, [scope, "k"], "left")
    )
    torn = F.col("low") != F.col("high")
    return joined.select(
        scope,
        F.when(F.col("low").isNull(), "insufficient").when(torn, "contradictory").otherwise("resolved").alias("status"),
        F.when(~torn, F.col("first.record_version_id")).alias("primary_id"),
        F.when(torn, F.size("ids")).alias("contenders"),
        F.when(~torn, F.col("n") - 1).alias("supporting"),
    )


def contradictory_scopes(df: DataFrame) -> DataFrame:
    """Scopes whose least tier holds several hashes, over all rows."""
    per = df.groupBy("scope", "tier").agg(F.count_distinct("effective_hash").alias("hashes"))
    return per.groupBy("scope").agg(F.min_by("hashes", "tier").alias("hashes"), F.min("tier").alias("tier")).filter("hashes > 1")


def duplicate_violations(df: DataFrame) -> DataFrame:
    """Dedupe keys that several active versions hold."""
    return df.filter("authoritative").groupBy("dedupe_key").agg(F.count_distinct("record_version_id").alias("versions")).filter("versions > 1")


def select_primary_hits(evidence: DataFrame) -> DataFrame:
    """Per query and dedupe key: rows of the least tier; all of them if it holds several values, else those of the best record
    (greatest score, then smallest id)."""
    key = ["query_id", "dedupe_key"]
    per = evidence.groupBy(*key, "tier").agg(
        F.min("effective_hash").alias("low"), F.max("effective_hash").alias("high"),
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("record_version_id").alias("id"))).alias("best"),
    )
    top = per.groupBy(*key).agg(F.min_by(F.struct("tier", "low", "high", "best"), "tier").alias("t")).select(*key, "t.*")
    return evidence.join(top, [*key, "tier"]).filter("low <> high or record_version_id = best.id").drop("low", "high", "best")


def has_contradiction(evidence: DataFrame) -> DataFrame:
    """query_id, contradictory: some (scope, dedupe key) whose least tier holds several values."""
    per = evidence.groupBy("query_id", "scope", "dedupe_key", "tier").agg(F.count_distinct("effective_hash").alias("n"))
    top = per.groupBy("query_id", "scope", "dedupe_key").agg(F.min_by("n", "tier").alias("n"))
    return top.groupBy("query_id").agg(F.bool_or(F.col("n") > 1).alias("contradictory"))
