"""Registered streaming queries: each drains the driver's table as a stream and returns what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factmill.operators.lifecycle import ensure_checkpoints
from factmill.streaming import health, upsert

from . import adapters as A
from .adapters import RECORDS_SQL as REC
from .catalog import Catalog
from .records import DECIDE

query = Catalog()
QUERIES, ORACLE = query.queries, query.oracle


def _shared(spark) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see."""
    ensure_checkpoints(spark)
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{place.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _as_stream(spark, sf_dir, name):
    """The table as a file stream; a table that is a single file is picked by name from its folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(
    "k13_stream_health",
    """
SELECT 's' || (user_id % 200) AS source_id, date_trunc('day', ts) AS day, max(ts) FILTER (WHERE event_type <> 'error') AS last_success_at, max(ts) AS last_seen_at,
  count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY ALL""",
)
def stream_health(spark, sf_dir):
    events = _as_stream(spark, sf_dir, "events")
    visits = events.select(F.concat(F.lit("s"), F.col("user_id") % 200).alias("source_id"), "ts", (F.col("event_type") != "error").alias("ok"))
    folder = _shared(spark)
    out = health.stream_source_health(visits, late="40 days")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = out.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
    run.awaitTermination()
    state = F.max_by(F.struct("last_success_at", "last_seen_at", "failures"), "batch").alias("s")  # each batch has what it changed
    ntz = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    result = spark.read.parquet(f"{folder}/out").groupBy("source_id", "day").agg(state)
    return result.select("source_id", ntz("day", "day"), ntz("s.last_success_at", "last_success_at"), ntz("s.last_seen_at", "last_seen_at"), "s.failures")


@query(
    "k12_stream_ingest",
    """
SELECT 'd' || doc_id AS record_version_id, source || ':' || lang AS scope FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1""",
)
def stream_ingest(spark, sf_dir):
    d = _as_stream(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select(
        F.concat(F.lit("d"), i).alias("record_version_id"), F.concat_ws(":", "source", "lang").alias("scope"), F.lit("policy_rule").alias("record_type"),
        F.lit(None).cast("date").alias("effective_from"), F.timestamp_add("MINUTE", i.cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"),
        F.lit(1).alias("tier"), F.sha2("text", 256).alias("effective_hash"),
    )
    folder = _shared(spark)
    health.stream_ingest(rows, f"{folder}/out", f"{folder}/state", late="3650 days").trigger(availableNow=True).start().awaitTermination()
    return health.current_versions(spark, f"{folder}/out").select("record_version_id", "scope")



@query("k12_stream_upsert", f"WITH {REC}, base AS (SELECT * FROM rec), {DECIDE} SELECT record_version_id, decision FROM decided")
def stream_upsert(spark, sf_dir):
    """Documents arrive as a stream of record versions; what the store holds in the end is one decision over all of them."""
    folder = _shared(spark)
    rows = A.records(spark, sf_dir, _as_stream(spark, sf_dir, "documents"))
    upsert.stream_upsert(rows, f"{folder}/out", f"{folder}/state", F.lit("2024-07-01").cast("date")).trigger(availableNow=True).start().awaitTermination()
    return upsert.read_store(spark, f"{folder}/out").select("record_version_id", "decision")


@query(
    "k13_source_grace",
    """
WITH v AS (SELECT 's' || (user_id % 200) AS source_id, epoch_us(ts) // 1000 AS t, event_type <> 'error' AS ok, [1, 6, 24, 72][user_id % 4 + 1] * 3600000 AS grace FROM events),
s AS (SELECT source_id, max(t) FILTER (WHERE ok) AS good, arg_max(ok, (t, ok)) AS ok, count(*) FILTER (WHERE NOT ok) AS failures, any_value(grace) AS grace FROM v GROUP BY source_id)
SELECT source_id, CASE WHEN good IS NULL OR (SELECT max(t) FROM v) - 21600000 > good + grace THEN 'expired' WHEN ok THEN 'healthy' ELSE 'failing' END AS status, make_timestamp_ms(good) AS last_success_at, failures FROM s""",
)
def source_grace(spark, sf_dir):
    """Every source's health after the last event: a source whose successes stopped has expired by its timer."""
    folder, user = _shared(spark), F.col("user_id")
    visits = _as_stream(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), user % 200).alias("source_id"), "ts", (F.col("event_type") != "error").alias("ok"),
        F.element_at(F.array(*map(F.lit, (1, 6, 24, 72))), (user % 4 + 1).cast("int")).alias("grace_hours"),
    )

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = health.stream_grace(visits).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("source_id").agg(F.max_by(F.struct("status", "last_success_at", "failures"), F.struct("batch", "at")).alias("s"))
    return last.select("source_id", "s.status", F.col("s.last_success_at").cast("timestamp_ntz").alias("last_success_at"), "s.failures")
