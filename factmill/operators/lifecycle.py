"""Lifecycle of sources and records: visits, expiry, removal, audits, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions.urls import HIGH_RISK, canonicalize_url, classify_source

from .dedupe import contradictory_scopes, duplicate_violations, resolve_duplicates
from .filters import can_serve, is_crawlable, is_refresh_due

REMOVABLE = ("faculty_profile", "faculty_publication", "faculty_award", "faculty_affiliation", "merit_list", "document_asset")


def ensure_checkpoints(spark) -> None:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on a local master, an error on a cluster, whose executors
    wouldn't share it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def with_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Class and legal status of each record's source; without a source the class is general. The planner broadcasts sources
    only while they are under its size limit."""
    return records.join(sources, "source_url", "left").withColumn("source_class", F.coalesce("source_class", F.lit("general")))


def persist_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with new_freshness (contradictory where a dedupe key is in conflict), and the links between copies."""
    _, links, conflicts = resolve_duplicates(records)
    torn = conflicts.select(F.explode("conflict_ids").alias("record_version_id")).distinct().withColumn("torn", F.lit(True))
    out = records.join(torn, "record_version_id", "left")
    return out.withColumn("new_freshness", F.when(F.col("torn"), "contradictory").otherwise(F.col("freshness"))).drop("torn"), links


def apply_visits(visits: DataFrame) -> DataFrame:
    """Per source: last success, last visit, failures and the status after its last visit."""
    last = F.max_by("ok", F.struct("ts", "event_id"))
    return visits.groupBy("source_id").agg(
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_at"), F.max("ts").alias("last_seen_at"), F.count_if(~F.col("ok")).alias("failures"),
        F.when(last, "verified_live").otherwise("failed:error").alias("crawl_status"),
    )


def expire_failed_sources(states: DataFrame, records: DataFrame, now: Column, hours: int = 336) -> DataFrame:
    """Current records of sources whose last visit failed and whose last success is older than the grace become unknown."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_success_at").cast("timestamp"))) / 3.6e9
    bad = states.filter(F.col("crawl_status").startswith("failed") & F.coalesce(age > hours, F.lit(True))).select("source_id")
    status = F.when(F.col("serving").isin("indexed_active", "pending_index"), "pending_deindex").otherwise("ineligible")
    return records.filter("freshness = 'current'").join(bad, "source_id", "left_semi").select(
        "record_version_id", F.lit("unknown").alias("new_freshness"), status.alias("new_serving")
    )


def disappeared_children(sources: DataFrame, crawled: DataFrame, seen: DataFrame) -> DataFrame:
    """Children (source_url, parent) of crawled parents that were not seen again."""
    return sources.join(crawled.select("parent").distinct(), "parent", "left_semi").join(seen.select("source_url").distinct(), "source_url", "left_anti")


def remove_disappeared(records: DataFrame, gone: DataFrame) -> DataFrame:
    rows = records.filter(F.col("freshness").isin("current", "unknown") & F.col("record_type").isin(*REMOVABLE))
    return rows.join(gone.select("source_url").distinct(), "source_url", "left_semi").select("record_version_id", F.lit("removed").alias("new_freshness"))


def run_audit(records: DataFrame, sources: DataFrame, active_status: str = "indexed_active") -> DataFrame:
    """One row of counts; raising on a difference is the caller's choice."""
    ok = can_serve()
    main = with_source(records, sources).agg(
        F.count_if(F.col("serving") == active_status).alias("active"), F.count_if(ok).alias("eligible"),
        F.count_if(ok & (F.col("legal_status") == "blocked")).alias("blocked"), F.count_if(ok & ~F.col("is_active")).alias("inactive"),
    )
    torn = contradictory_scopes(records).agg(F.count("*").alias("contradictory"))
    twice = duplicate_violations(records).agg(F.count("*").alias("duplicates"))
    key = F.lit(1).alias("one")
    return main.select("*", key).join(torn.select("*", key), "one").join(twice.select("*", key), "one").drop("one")


def generation_diff(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Versions to take out of the index and to put into it."""
    key = previous.columns
    out = previous.join(new, key, "left_anti").withColumn("operation", F.lit("deindex"))
    return out.union(new.join(previous, key, "left_anti").withColumn("operation", F.lit("index")))


def upsert_sources(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """By key; a null in the new row doesn't overwrite."""
    rest = [c for c in old.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in rest))
    return old.join(n, key, "full").select(key, *(F.coalesce(f"_n_{c}", c).alias(c) for c in rest))


def rebind_urls(sources: DataFrame, moved: DataFrame) -> DataFrame:
    """Rename URLs by moved (old_url, new_url), all at once and one step far; moves of unknown URLs, to null or to the same URL do nothing.

    Rows that meet at a URL become one: the row that was there before, else that of the smallest old URL. It takes the newest of each
    timestamp, is active if any was, and keeps its link text unless that is empty: then the next row's. Children of a moved row
    follow it. A row that was moved or met is classified anew by its URL. Columns but source_url may be missing."""
    known = sources.select(F.col("source_url").alias("old_url")).distinct()
    moves = moved.filter("old_url <> new_url").groupBy("old_url").agg(F.min("new_url").alias("new_url")).join(known, "old_url", "left_semi")
    first = F.struct(F.col("new_url").isNotNull(), "source_url")
    named = sources.join(moves, sources.source_url == moves.old_url, "left").drop("old_url")
    if "parent_source_url" in sources.columns:
        parents = moves.select(F.col("old_url").alias("parent_source_url"), F.col("new_url").alias("_parent"))
        named = named.join(parents, "parent_source_url", "left").withColumn("parent_source_url", F.coalesce("_parent", "parent_source_url")).drop("_parent")

    def merged(c: str) -> Column:
        if c in ("last_crawled_at", "last_seen_at", "last_successful_crawl_at"):
            return F.max(c)
        if c == "is_active":
            return F.bool_or(c)
        if c == "link_text":
            return F.coalesce(F.min_by(c, F.when(F.col(c) != "", first)), F.min_by(c, first))
        return F.min_by(F.struct(c), first)[c]

    rest = [c for c in sources.columns if c != "source_url"]
    out = named.groupBy(F.coalesce("new_url", "source_url").alias("_url")).agg(*(merged(c).alias(c) for c in rest), F.bool_or(F.col("new_url").isNotNull()).alias("_moved"))
    anew = {"source_class": classify_source, "canonical_url": canonicalize_url}
    kept = (F.when(F.col("_moved"), anew[c](F.col("_url"))).otherwise(F.col(c)).alias(c) if c in anew else F.col(c) for c in rest)
    return out.select(F.col("_url").alias("source_url"), *kept)


def rebind_records(records: DataFrame, moved: DataFrame) -> DataFrame:
    """Records (or snapshots) of moved sources carry the new URL."""
    moves = moved.filter("old_url <> new_url").groupBy("old_url").agg(F.min("new_url").alias("_url"))
    named = records.join(moves, records.source_url == moves.old_url, "left").drop("old_url")
    anew = {"source_url": F.coalesce("_url", "source_url")}
    if "canonical_url" in records.columns:
        anew["canonical_url"] = F.coalesce(canonicalize_url(F.col("_url")), "canonical_url")
    return named.select(*(anew[c].alias(c) if c in anew else F.col(c) for c in records.columns))


def affected_closure(records: DataFrame, keys: list[str], anchor: Column, most_rounds: int = 50) -> DataFrame:
    """Records linked with the anchor through any of the keys, over any number of steps. Each round joins only the new rows'
    keys and is cut by a checkpoint."""
    edges = records.select("record_version_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys))).alias("e"))
    edges = edges.select("record_version_id", "e.kind", "e.value").filter("value is not null")
    seen = fresh = records.filter(anchor).select("record_version_id").checkpoint()
    for _ in range(most_rounds):
        touched = edges.join(fresh, "record_version_id", "left_semi").select("kind", "value").distinct()
        fresh = edges.join(touched, ["kind", "value"], "left_semi").select("record_version_id").distinct().join(seen, "record_version_id", "left_anti").checkpoint()
        if fresh.isEmpty():
            return records.join(seen, "record_version_id", "left_semi")
        seen = seen.union(fresh).checkpoint()
    raise RuntimeError(f"closure did not settle in {most_rounds} rounds")


def index_changes(records: DataFrame, batch: int) -> DataFrame:
    """Changes of the index that are open, the oldest `batch` of them claimed (running): versions that are eligible or wait for the index,
    and those that wait to leave it. The claimed ones are a bounded top-k, so no global order of all changes is made."""
    open_ = records.filter(F.col("serving").isin("eligible", "pending_index", "pending_deindex")).select(
        "record_version_id", F.when(F.col("serving") == "pending_deindex", "deindex").otherwise("index").alias("operation"), "fetched_at"
    )
    claimed = open_.orderBy("fetched_at", "record_version_id").limit(batch).select("record_version_id", F.lit("running").alias("status"))
    return open_.drop("fetched_at").join(claimed, "record_version_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def finish_changes(changes: DataFrame, succeeded: bool, error: str | None = None) -> DataFrame:
    """Claimed changes end with the build of the generation: all succeed or all fail with its error; the others still wait."""
    running = F.col("status") == "running"
    done = F.when(running, "succeeded" if succeeded else "failed").otherwise(F.col("status"))
    return changes.withColumn("error", F.when(running, F.lit(None if succeeded else error).cast("string"))).withColumn("status", done)


def reset_serving(records: DataFrame) -> DataFrame:
    """Before the index is built anew: versions in it are eligible again, those that wait to leave it are ineligible."""
    serving = F.col("serving")
    return records.withColumn("new_serving", F.when(serving == "indexed_active", "eligible").otherwise(serving))


def select_due_sources(sources: DataFrame, now: Column, limit: int | None = None, force: bool = False, watch: DataFrame | None = None) -> DataFrame:
    """Sources to visit: crawlable, and due by their policy unless forced. First classes of high risk, those of the watch list
    (source_url, place) in its order, then the others; then research subdomains; then the rest; by URL where they tie.
    Adds rank and place (null off the list). With a limit this is a bounded top-k."""
    due = sources.filter(is_crawlable() if force else is_crawlable() & is_refresh_due(F.col("refresh_policy"), F.col("source_class"), F.col("last_crawled_at"), now))
    rank = F.when(F.col("source_class").isin(*HIGH_RISK), 0).when(F.col("source_class") == "research_subdomain", 1).otherwise(2)
    ranked = due.withColumn("rank", rank)
    if watch is None:
        listed = ranked.withColumn("place", F.lit(None).cast("int"))
    else:
        places = watch.groupBy("source_url").agg(F.min("place").alias("place"))
        listed = ranked.join(places, "source_url", "left").withColumn("place", F.when(F.col("rank") == 0, F.col("place")))
    ordered = listed.orderBy("rank", F.asc_nulls_last("place"), "source_url")
    return ordered if limit is None else ordered.limit(limit)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("source_id").agg(F.max_by("snapshot_id", F.struct("fetched_at", "snapshot_id")).alias("snapshot_id"))


#: What the queue shows of an event and of its record, if the tables have it.
QUEUE_EVENT = ("event_id", "record_version_id", "reason", "conflicting_record_ids", "notes", "created_at")
QUEUE_RECORD = ("record_id", "record_type", "source_url", "source_locator", "freshness", "verification", "serving")


def review_queue(events: DataFrame, records: DataFrame) -> DataFrame:
    """Pending manual reviews with what is known of their record, in the order of versions, then of events; events of unknown versions
    are left out."""
    pending = events.filter("event_type = 'manual_review_required' and status = 'pending'").select(*(c for c in QUEUE_EVENT if c in events.columns))
    shown = records.select("record_version_id", *(c for c in QUEUE_RECORD if c in records.columns))
    return pending.join(shown, "record_version_id").orderBy("record_version_id", *(c for c in ("event_id",) if c in pending.columns))


def mark_indexed(records: DataFrame, indexed: DataFrame) -> DataFrame:
    """indexed_active for versions in the new generation, deindexed for those that leave it."""
    flag = indexed.select("record_version_id").distinct().withColumn("_in", F.lit(True))
    out = records.join(flag, "record_version_id", "left")
    status = F.when(F.col("_in"), "indexed_active").when(F.col("serving").isin("indexed_active", "pending_deindex"), "deindexed").otherwise(F.col("serving"))
    return out.withColumn("new_serving", status).drop("_in")


def recompute(records: DataFrame, keys: list[str], anchor: Column, as_of) -> DataFrame:
    """Decide again everything linked with the anchor, rejected rows left out: they stay rejected."""
    from .versions import decide

    linked = affected_closure(records, keys, anchor)
    decided = decide(linked.filter("verification <> 'rejected'"), as_of).select("record_version_id", "decision")
    rejected = linked.filter("verification = 'rejected'").select("record_version_id", F.lit("rejected").alias("decision"))
    return decided.unionByName(rejected)


def build_generation(records: DataFrame, only_current: bool = True) -> DataFrame:
    """Chunks of the records to serve: primaries of their dedupe keys, or with only_current=False every record. Records with a payload (and
    lists) are cut by the sections that it renders to, the others by their text."""
    from .chunks import build_chunks

    rows = records
    if only_current:
        rows = records.join(resolve_duplicates(records)[0].select("record_version_id"), "record_version_id", "left_semi")
    payload, lists = (F.col(c) if c in records.columns else None for c in ("payload", "lists"))
    return build_chunks(rows, payload=payload, lists=lists).join(records.select("record_version_id", "record_type"), "record_version_id")
