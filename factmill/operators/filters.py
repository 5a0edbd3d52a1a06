"""Predicates and row checks on records, sources and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.urls import HIGH_RISK

# Fixed values.
SERVABLE = ("eligible", "pending_index", "indexed_active")
BLOCKING = ("blocked", "restricted")
CYCLE_TYPES = ("admissions_cycle", "program_fee_schedule", "merit_list")
REQUIRED = ("record_id", "record_type", "source_url", "source_section_id", "source_section_label", "source_locator", "conflict_scope_id", "dedupe_key", "source_authority_tier")
REFRESH_HOURS = {"weekly": 168, "weekly_or_monthly_based_on_change_rate": 168}
GRACE_HOURS = {
    "admissions_cycle": 24, "program_fee_schedule": 24, "merit_list": 12, "news_event": 48, "scholarship": 168, "program": 168, "faculty": 168,
    "policy": 336, "research_main": 336, "research_subdomain": 336, "student_service": 336, "university_info": 336, "org_unit": 336,
}
NUMERIC_QUESTION = (
    r"\b(rate|percentage|ratio|number of|average|median|total number)\b"
    r"|\bhow much\b.*\b(fees?|tuition|costs?|charges?|prices?)\b|\b(fees?|tuition|costs?|charges?|prices?)\b.*\bhow much\b"
)


def is_queryable() -> Column:
    return (F.col("verification") == "verified") & (F.col("freshness") == "current") & F.col("authoritative") & F.col("serving").isin(*SERVABLE)


def can_serve() -> Column:
    return (F.col("verification") == "verified") & (F.col("freshness") == "current") & F.col("authoritative") & (F.col("serving") == "eligible")


def source_allowed(status: Column) -> Column:
    """A source without a status is allowed."""
    return ~F.coalesce(status, F.lit("allowed")).isin(*BLOCKING)


def source_class_matches(kind: Column, hint: Column) -> Column:
    """No hint takes all; the policy hint takes document assets too."""
    return hint.isNull() | (kind == hint) | ((hint == "policy") & (kind == "document_asset"))


def record_type_matches(kind: Column, hint: Column) -> Column:
    return hint.isNull() | (kind == hint)


def validate_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows; invalid rows with `missing` (names of absent required fields, and of a tier that isn't an integer).

    payload is a map<string, variant> of what the row holds; presence of the key counts, its value may be null."""
    have = lambda k: F.map_contains_key("payload", k)
    tier = F.schema_of_variant(F.element_at("payload", "source_authority_tier"))
    wrong = [F.when(~have(k), F.lit(k)) for k in REQUIRED] + [
        F.when(have("source_authority_tier") & ~F.coalesce(tier == "BIGINT", F.lit(False)), F.lit("source_authority_tier is not an integer"))
    ]
    checked = df.withColumn("missing", F.array_compact(F.array(*wrong)))
    return checked.filter(F.size("missing") == 0).drop("missing"), checked.filter(F.size("missing") > 0)


def constraint_report(df: DataFrame) -> DataFrame:
    """One row per table rule with the number of rows that break it; a null breaks none."""
    rules = {
        "verification_enum": F.col("verification").isin("pending", "verified", "rejected"),
        "freshness_enum": F.col("freshness").isin("current", "stale", "contradictory", "unknown", "removed", "restricted"),
        "serving_enum": F.col("serving").isin("ineligible", "eligible", "pending_index", "indexed_active", "pending_deindex", "deindexed"),
        "tier_range": F.col("tier").between(1, 5),
        "year_confidence_enum": F.col("year_confidence").isin("high", "medium", "low", "unknown"),
        "authoritative_needs_verified": ~F.col("authoritative") | (F.col("verification") == "verified"),
        "authoritative_needs_current": ~F.col("authoritative") | (F.col("freshness") == "current"),
        "interval_order": F.col("effective_from") <= F.col("effective_to"),
    }
    one = df.agg(*(F.sum(F.when(~ok, 1).otherwise(0)).alias(name) for name, ok in rules.items()))
    return one.unpivot([], list(rules), "rule", "violations")


def drop_uncertain(evidence: DataFrame) -> DataFrame:
    """Adds `reason`: why the row is uncertain, null for rows to keep."""
    return evidence.withColumn(
        "reason",
        F.when(F.col("freshness") != "current", "not_current").when(
            F.col("record_type").isin(*CYCLE_TYPES) & F.col("year_confidence").isin("low", "unknown"), "ambiguous_year"
        ),
    )


def is_crawlable() -> Column:
    return (
        F.col("is_active")
        & source_allowed(F.col("legal_status"))
        & ((F.col("source_class") != "research_subdomain") | F.coalesce(F.col("crawl_status").isin("unverified", "verified_live"), F.lit(False)))
    )


def refresh_hours(policy: Column, kind: Column, now: Column) -> Column:
    """Hours between visits: null never, 0 always. April to September is the season of high-risk classes."""
    season = kind.isin(*HIGH_RISK) & F.month(now).between(4, 9)
    out = F.when(policy == "manual_only", None)
    out = out.when(policy == "every_6_hours_while_active_daily_otherwise", F.when(season, 6).otherwise(24))
    out = out.when(policy == "daily_during_season_weekly_otherwise", F.when(season, 24).otherwise(168))
    for name, hours in REFRESH_HOURS.items():
        out = out.when(policy == name, hours)
    return out.otherwise(0)


def _hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3.6e9


def is_refresh_due(policy: Column, kind: Column, last: Column, now: Column) -> Column:
    hours = refresh_hours(policy, kind, now)
    return hours.isNotNull() & (last.isNull() | (_hours(now, last) >= hours))


def within_grace(kind: Column, policy: Column, last_success: Column, now: Column) -> Column:
    """Age of the last success within the class's window, else twice the refresh interval, else 14 days; never succeeded: false."""
    window = F.lit(None).cast("int")
    for name, hours in GRACE_HOURS.items():
        window = F.when(kind == name, hours).otherwise(window)
    twice = F.nullif(refresh_hours(policy, kind, now) * 2, F.lit(0))
    return F.coalesce(_hours(now, last_success) <= F.coalesce(window, twice, F.lit(336)), F.lit(False))


def expects_numeric(query: Column) -> Column:
    return F.lower(query).rlike(NUMERIC_QUESTION)


def source_restricted(access: Column, automation: Column) -> Column:
    return (access != "allowed") | ~automation


def is_expired(until: Column, as_of: Column) -> Column:
    return F.coalesce(until < as_of, F.lit(False))


def rewrite_gate(original: Column, rewritten: Column) -> Column:
    """The rewriting if it is one non-empty line of 0.3 to 3 times the length, else the original."""
    r = F.trim(rewritten)
    ratio = F.length(r) / F.greatest(F.length(original), F.lit(1))
    return F.when((r != "") & ~F.contains(r, F.lit("\n")) & ratio.between(0.3, 3.0), r).otherwise(original)


def citations_complete(evidence: DataFrame) -> DataFrame:
    """query_id, complete: every row has a URL and a locator."""
    ok = (F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("locator", F.lit("")) != "")
    return evidence.groupBy("query_id").agg(F.bool_and(ok).alias("complete"))


def resolve_locator_match(requests: DataFrame, links: DataFrame, key) -> DataFrame:
    """requests (request_id, url) with the one link (link_id, url) of the same identity; none where several match."""
    grouped = links.groupBy(key(F.col("url")).alias("k")).agg(F.count("*").alias("n"), F.min("link_id").alias("link_id")).filter("n = 1")
    return requests.withColumn("k", key(F.col("url"))).join(grouped.drop("n"), "k", "left").drop("k")
