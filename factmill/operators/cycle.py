"""One update of the whole store: sources, visits, records, removals, links, chunks and their audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lifecycle, versions


@dataclass
class Update:
    """What a cycle makes; every table is lazy but records, which the later steps share."""

    sources: DataFrame
    visits: DataFrame
    records: DataFrame
    links: DataFrame
    chunks: DataFrame
    audit: DataFrame


def _applied(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records with new_freshness and new_serving (either may be absent) of changes in place of their own; what is no longer current isn't
    authoritative and leaves the index."""
    for c in ("freshness", "serving"):
        if f"new_{c}" not in changes.columns:
            changes = changes.withColumn(f"new_{c}", F.lit(None).cast("string"))
    mine = changes.groupBy("record_version_id").agg(F.max("new_freshness").alias("_f"), F.max("new_serving").alias("_s"), F.lit(True).alias("_hit"))
    out = records.join(mine, "record_version_id", "left")
    gone = F.coalesce("_hit", F.lit(False))
    leaves = F.when(F.col("serving").isin("indexed_active", "pending_index"), "pending_deindex").otherwise("ineligible")
    return out.withColumns(
        {
            "freshness": F.coalesce("_f", "freshness"), "authoritative": F.col("authoritative") & ~gone,
            "serving": F.when(gone, F.coalesce(F.col("_s"), leaves)).otherwise(F.col("serving")),
        }
    ).drop("_f", "_s", "_hit")


def update_cycle(
    records: DataFrame, sources: DataFrame, incoming: DataFrame, new_sources: DataFrame, visits: DataFrame, children: DataFrame, crawled: DataFrame, seen: DataFrame, as_of: Column, now: Column
) -> Update:
    """Sources are replaced or added and visits summed; touched scopes are decided again with the incoming rows; then records of children
    that crawled parents no longer show are removed, those of failing sources expire (records and visits by source_id), contradicted copies are marked, and what may serve becomes chunks."""
    all_sources = lifecycle.upsert_sources(sources, new_sources, "source_url")
    states = lifecycle.apply_visits(visits)
    decided = versions.upsert_records(records, incoming, as_of)
    fresh = F.coalesce("new_freshness", "freshness")
    kept = decided.select(
        *(c for c in records.columns if c not in ("freshness", "serving", "verification", "authoritative")), fresh.alias("freshness"), F.coalesce("new_serving", "serving").alias("serving"),
        F.coalesce("new_verification", "verification").alias("verification"), F.coalesce("new_authoritative", "authoritative", F.lit(False)).alias("authoritative"),
    )
    lifecycle.ensure_checkpoints(records.sparkSession)
    kept = kept.checkpoint()
    kept = _applied(kept, lifecycle.remove_disappeared(kept, lifecycle.disappeared_children(children, crawled, seen)))
    kept = _applied(kept, lifecycle.expire_failed_sources(states, kept, now)).checkpoint()
    marked, links = lifecycle.persist_links(kept)
    torn = marked.filter("new_freshness <> freshness").select("record_version_id", "new_freshness")
    final = _applied(kept, torn).checkpoint()
    return Update(all_sources, states, final, links, lifecycle.build_generation(final), lifecycle.run_audit(final, all_sources, "eligible"))
