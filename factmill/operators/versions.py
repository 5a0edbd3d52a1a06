"""Which version of a record is current: duplicates, conflicts, cycles, parents, decisions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import CYCLE_TYPES, can_serve

PARENT_TYPES = ("faculty_publication", "faculty_award", "faculty_affiliation")
VERSION_TYPES = ("faculty_profile", "policy_rule")
LATEST_ONLY = ("faculty_profile",)


def combine_scopes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows of every touched scope and the incoming rows; a version on both sides is the incoming one."""
    touched = existing.join(incoming.select("scope").distinct(), "scope", "left_semi")
    both = touched.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy("record_version_id").orderBy(F.desc("side"))
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def _newest(*last: str):
    """Orders versions, the newest greatest: (effective_from, null first; fetched_at; least tier; ids)."""
    return F.struct(F.coalesce("effective_from", F.lit("0001-01-01").cast("date")).alias("e"), F.col("fetched_at").alias("f"), (-F.col("tier")).alias("t"), *last)


def latest_version(df: DataFrame, keys=("scope", "record_type")) -> DataFrame:
    """Adds is_latest and reason: the newest by (effective_from, fetched_at, -tier, version id); an older row of the winner's
    hash is a duplicate. A null effective_from is the oldest. Winners are aggregates, joined back, so a hot scope is combined first."""
    top = df.groupBy(*keys).agg(F.max_by(F.struct("record_version_id", "effective_hash"), _newest("record_version_id")).alias("_top"))
    first = F.col("record_version_id") == F.col("_top.record_version_id")
    same = F.col("effective_hash") == F.col("_top.effective_hash")
    out = df.join(top, list(keys)).withColumns({"is_latest": first, "reason": F.when(first, "latest").when(same, "newer_duplicate").otherwise("newer_exists")})
    return out.select(*df.columns, "is_latest", "reason")


def latest_cycle(df: DataFrame) -> DataFrame:
    """Winner of each (scope, type) among cycle rows of a certain year; the version id is the last key, so there is one winner.
    Rows of an ambiguous year are pending."""
    rows, ambiguous = df.filter(F.col("record_type").isin(*CYCLE_TYPES)), F.col("year_confidence").isin("low", "unknown")
    top = rows.filter(~ambiguous).groupBy("scope", "record_type").agg(F.max_by("record_version_id", _newest("record_id", "record_version_id")).alias("_top"))
    first = F.col("record_version_id") == F.col("_top")
    out = rows.join(top, ["scope", "record_type"], "left").withColumn("outcome", F.when(ambiguous, "pending").when(first, "current").otherwise("stale"))
    return out.select(*df.columns, "outcome")


CONFLICT_KEYS = ["scope", "tier", "record_type"]


def _others(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Of each group its value of the greatest rank, and the greatest rank of any other value."""
    per = rows.groupBy(*keys, F.col("effective_hash").alias("h")).agg(F.max("_rank").alias("r"))
    best = per.groupBy(*keys).agg(F.max(F.struct("r", "h")).alias(f"{name}_best"))
    second = per.join(best, keys).filter(F.col("h") != F.col(f"{name}_best.h")).groupBy(*keys).agg(F.max("r").alias(f"{name}_second"))
    return best.join(second, keys, "left")


def _contradicted(df: DataFrame) -> DataFrame:
    """Rows that another version contradicts: same scope, tier and type, another effective hash. Cycle rows of two known cycles don't;
    one without a cycle contradicts those of all. Latest-only types never do. A milestone stands against its contradictions if it is
    above them all by (specificity of its URL, effective_from, fetched_at). Aggregates only: rows join what is known of their group."""
    from factmill.functions.urls import source_specificity

    rank = F.struct(source_specificity(F.col("source_url")).alias("s"), F.coalesce("effective_from", F.lit("0001-01-01").cast("date")).alias("e"), F.col("fetched_at").alias("f"))
    cycle = F.when(F.col("record_type").isin(*CYCLE_TYPES), F.col("cycle_label"))
    rows = df.filter(~F.col("record_type").isin(*LATEST_ONLY)).withColumns({"_cycle": cycle, "_rank": rank})
    bare = F.col("_cycle").isNull()
    known = rows.join(_others(rows, CONFLICT_KEYS, "_whole"), CONFLICT_KEYS)
    known = known.join(_others(rows.filter(bare), CONFLICT_KEYS, "_bare"), CONFLICT_KEYS, "left")
    known = known.join(_others(rows.filter(~bare), [*CONFLICT_KEYS, "_cycle"], "_own"), [*CONFLICT_KEYS, "_cycle"], "left")
    other = lambda n: F.when(F.col(f"{n}_best.h") != F.col("effective_hash"), F.col(f"{n}_best.r")).otherwise(F.col(f"{n}_second"))
    highest = F.when(bare, other("_whole")).otherwise(F.greatest(other("_bare"), other("_own")))
    out = known.withColumn("_other", highest).filter(F.col("_other").isNotNull())
    return out.filter((F.col("record_type") != "admissions_cycle") | (F.col("_rank") <= F.col("_other"))).select(*df.columns, "_cycle")


def same_tier_conflicts(df: DataFrame) -> DataFrame:
    """scope, tier, record_type, cycle, effective_hash, ids: of each group with contradictions, the contradicted versions by value. A
    version is contradicted by the ids of other values in its group; so many ids as versions, never their pairs."""
    rows = _contradicted(df)
    return rows.groupBy(*CONFLICT_KEYS, F.col("_cycle").alias("cycle"), "effective_hash").agg(F.array_sort(F.collect_list("record_version_id")).alias("ids"))


def best_parent_state(df: DataFrame, key: str) -> DataFrame:
    """State of each parent key: the greatest of (authoritative, verified, current, servable, fetched, version)."""
    rank = F.struct(
        F.col("authoritative").alias("a"), (F.col("verification") == "verified").alias("v"), (F.col("freshness") == "current").alias("c"),
        can_serve().alias("s"), "fetched_at", "record_version_id",
    )
    top = F.max(rank)
    return df.groupBy(key).agg(
        top["a"].alias("parent_authoritative"), top["v"].alias("parent_verified"), top["c"].alias("parent_current"), top["record_version_id"].alias("parent_version_id")
    )


def parent_state(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds the parent's state: by parent_record_id where set (absent: unresolved), else by parent_url, else null."""
    by_id = best_parent_state(candidates, "record_id").withColumnRenamed("record_id", "parent_record_id")
    by_url = best_parent_state(candidates, "source_url").withColumnRenamed("source_url", "parent_url")
    names = ("parent_authoritative", "parent_verified", "parent_current", "parent_version_id")
    a = by_id.select("parent_record_id", *(F.col(n).alias(f"i_{n}") for n in names))
    b = by_url.select("parent_url", *(F.col(n).alias(f"u_{n}") for n in names))
    joined = df.join(a, "parent_record_id", "left").join(b, "parent_url", "left")
    pick = lambda n: F.when(F.col("parent_record_id").isNotNull(), F.col(f"i_{n}")).otherwise(F.col(f"u_{n}"))
    out = joined.withColumns({n: pick(n) for n in names})
    return out.withColumn("parent_resolved", F.col("parent_version_id").isNotNull()).drop(*(f"{p}_{n}" for p in "iu" for n in names))


def corroborated(df: DataFrame) -> DataFrame:
    """Rows with another version of the same effective hash from another URL, or one whose year is certain."""
    facts = df.groupBy("effective_hash").agg(
        F.count_distinct("source_url").alias("urls"), F.count_if(F.col("year_confidence") == "high").alias("certain"), F.count("*").alias("n")
    )
    mine = F.when(F.col("year_confidence") == "high", 1).otherwise(0)
    return df.join(facts, "effective_hash").filter((F.col("n") > 1) & ((F.col("urls") > 1) | (F.col("certain") - mine > 0))).drop("urls", "certain", "n")


def link_superseded(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Serving rows of a scope and the newest authoritative incoming version that supersedes them, with their new status."""
    rank = F.struct("effective_from", (-F.col("tier")).alias("minus"), "record_version_id")
    newest = incoming.filter("authoritative").groupBy("scope").agg(F.max(rank)["record_version_id"].alias("superseded_by"))
    rows = existing.filter("authoritative or serving = 'indexed_active'").join(newest, "scope").filter("record_version_id <> superseded_by")
    status = F.when(F.col("serving").isin("indexed_active", "pending_index"), "pending_deindex").otherwise("ineligible")
    return rows.select("record_version_id", "superseded_by", status.alias("new_serving"))


class Context(NamedTuple):
    """What guards may ask for besides the row's own columns and is_latest, outcome (of its cycle) and conflict, which decide() adds."""

    as_of: Column
    blocked: Column


class Rule(NamedTuple):
    """A decision and when it is taken."""

    decision: str
    guard: Callable[[Context], Column]


class State(NamedTuple):
    """What a decision makes of a version; review is why somebody must look at it, or None."""

    verification: str
    freshness: str
    wins: bool
    review: str | None


RESTRICTED = Rule("restricted", lambda c: c.blocked)
EXPIRED = Rule("expired", lambda c: F.col("effective_to") < c.as_of)
CONFLICT = Rule("conflict", lambda c: F.col("conflict"))
AMBIGUOUS = Rule("ambiguous", lambda c: F.col("outcome") == "pending")
OLDER_CYCLE = Rule("older", lambda c: F.col("outcome") == "stale")
OLDER_VERSION = Rule("older", lambda c: ~F.col("is_latest"))
#: The rules of each type in order; a version that none applies to wins. The empty name stands for all other types.
RULES: dict[str, tuple[Rule, ...]] = {
    **dict.fromkeys(CYCLE_TYPES, (RESTRICTED, EXPIRED, CONFLICT, AMBIGUOUS, OLDER_CYCLE)), **dict.fromkeys(VERSION_TYPES, (RESTRICTED, EXPIRED, OLDER_VERSION)),
    "": (RESTRICTED, EXPIRED, CONFLICT, OLDER_VERSION),
}
STATES: dict[str, State] = {
    "restricted": State("rejected", "restricted", False, None), "expired": State("verified", "stale", False, None), "conflict": State("pending", "contradictory", False, "same_tier_conflict"),
    "ambiguous": State("pending", "unknown", False, "ambiguous_date"), "older": State("verified", "stale", False, None), "winner": State("verified", "current", True, None),
}


def _decision(rules: dict[str, tuple[Rule, ...]], context: Context) -> Column:
    """One expression of all types; types with the same rules share a branch."""

    def chain(of):
        out = F.lit("winner")
        for rule in of[::-1]:
            out = F.when(F.coalesce(rule.guard(context), F.lit(False)), rule.decision).otherwise(out)
        return out

    kinds: dict[tuple[Rule, ...], list[str]] = {}
    for kind, of in rules.items():
        kinds.setdefault(of, []).append(kind)
    out = chain(rules[""])
    for of, names in kinds.items():
        if of != rules[""]:
            out = F.when(F.col("record_type").isin(*names), chain(of)).otherwise(out)
    return out


def decide(df: DataFrame, as_of, blocked: Column | None = None, rules: dict[str, tuple[Rule, ...]] = RULES, states: dict[str, State] = STATES) -> DataFrame:
    """Decision of each version by the rules of its type: restricted, expired, conflict, ambiguous year, then the newest cycle or version. Adds
    decision, and by its state new_verification, new_freshness, new_serving, new_authoritative and review. Other rules, types and states are
    given as data."""
    latest = latest_version(df).select("record_version_id", "is_latest")
    cycle = latest_cycle(df).select("record_version_id", "outcome")
    conflicts = _contradicted(df).select("record_version_id", F.lit(True).alias("conflict"))
    all_ = df.join(latest, "record_version_id").join(cycle, "record_version_id", "left").join(conflicts, "record_version_id", "left")
    decided = all_.withColumn("decision", _decision(rules, Context(as_of, blocked if blocked is not None else F.lit(False))))
    entries = {name: F.struct(F.lit(s.verification).alias("v"), F.lit(s.freshness).alias("f"), F.lit(s.wins).alias("w"), F.lit(s.review).cast("string").alias("r")) for name, s in states.items()}
    state = F.element_at(F.create_map(*(x for name, e in entries.items() for x in (F.lit(name), e))), F.col("decision"))
    return decided.withColumns(
        {
            "new_verification": state["v"], "new_freshness": state["f"], "new_serving": F.when(state["w"], "eligible").otherwise("ineligible"),
            "new_authoritative": state["w"], "review": state["r"],
        }
    ).drop("is_latest", "outcome", "conflict")


def upsert_records(existing: DataFrame, incoming: DataFrame, as_of) -> DataFrame:
    """Decide all rows of the touched scopes again, and fail closed: where an incoming row needs review, no row of its scope stays
    eligible. Rows of other scopes are returned as they are, without a decision."""
    both = combine_scopes(existing, incoming)
    decided = decide(both, as_of)
    closed = decided.filter("side = 1 and review is not null").select("scope").distinct().withColumn("closed", F.lit(True))
    out = decided.join(closed, "scope", "left").withColumn(
        "new_serving",
        F.when(F.col("closed") & F.col("serving").isin("pending_index", "indexed_active"), "pending_deindex")
        .when(F.coalesce("closed", F.lit(False)), "ineligible")
        .otherwise(F.col("new_serving")),
    )
    others = existing.join(incoming.select("scope").distinct(), "scope", "left_anti").withColumn("new_serving", F.col("serving"))
    return out.drop("closed").unionByName(others, allowMissingColumns=True)


def decide_two_pass(df: DataFrame, as_of) -> DataFrame:
    """Independent rows first; their outcome is the parents' state for dependent rows, which win only under an authoritative parent."""
    dependent = F.col("record_type").isin(*PARENT_TYPES)
    first = decide(df.filter(~dependent), as_of)
    keys = first.select(
        "record_id", "source_url", "fetched_at", "record_version_id", F.col("new_authoritative").alias("authoritative"), F.col("new_verification").alias("verification"),
        F.col("new_freshness").alias("freshness"), F.col("new_serving").alias("serving"),
    )
    second = parent_state(df.filter(dependent), keys)
    ok = F.coalesce("parent_authoritative", F.lit(False))
    outcome = F.when(~F.col("parent_resolved"), "parent_unresolved").when(~ok, "parent_not_authoritative").otherwise("winner")
    return first.select("record_version_id", "decision").unionByName(second.select("record_version_id", outcome.alias("decision")))
