"""Incremental input: new record files, and the health of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from factmill.operators.versions import latest_version


def stream_source_health(visits: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Per source and window: last success, last visit, failures. Visits that come later than `late` behind the newest are dropped, so
    state stays bounded by the sources of open windows."""
    timed = visits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "source_id").agg(
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_at"), F.max("ts").alias("last_seen_at"), F.count_if(~F.col("ok")).alias("failures")
    ).select("source_id", F.col("window.start").alias("day"), "last_success_at", "last_seen_at", "failures")


def stream_ingest(stream: DataFrame, root: str, checkpoint: str, late: str = "7 days") -> DataStreamWriter:
    """Append each micro-batch of record versions to root, repeats of a version id left out. The target partition is the batch's number and
    is overwritten, so a batch that runs twice leaves one copy. Winners come from `current_versions`, whatever the arrival order."""
    once = stream.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["record_version_id"])

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def current_versions(spark, root: str) -> DataFrame:
    """Latest versions over all ingested batches."""
    return latest_version(spark.read.parquet(root)).filter("is_latest")


HEALTH = "source_id string, status string, at timestamp, last_success_at timestamp, last_seen_at timestamp, failures long"
_STATE = "success long, seen long, ok boolean, failures long, grace long"


def stream_grace(visits: DataFrame, late: str = "6 hours", retain_hours: int = 24 * 90) -> DataFrame:
    """visits (source_id, ts, ok, grace_hours) -> the health of each source whenever it changes: healthy, failing (its last visit failed), or
    expired: no success within its grace window, which ends by a timer of event time, without any visit of its own.

    A timer fires when the watermark, `late` behind the newest visit of any source, passes the last success and the grace window. A source that
    never succeeded is expired. `retain_hours` after its last visit a source's state ends by the same timer."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    hour = 3_600_000

    def step(key, frames, state):
        success, seen, ok, failures, grace = state.get if state.exists else (-1, -1, True, 0, 0)
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            if mark >= seen + retain_hours * hour:
                state.remove()
                return
        for pdf in frames if not state.hasTimedOut else ():
            ts = pdf["ts"].astype("int64") // 10 ** {"s": 0, "ms": 3, "us": 6, "ns": 9}[pdf["ts"].dt.unit] * 1000 + pdf["ts"].dt.microsecond // 1000
            good = ts[pdf["ok"]]
            success = max(success, int(good.max())) if len(good) else success
            failures += int((~pdf["ok"]).sum())
            last = max(range(len(ts)), key=lambda i: (ts.iloc[i], pdf["ok"].iloc[i]))
            if ts.iloc[last] >= seen:
                seen, ok = int(ts.iloc[last]), bool(pdf["ok"].iloc[last])
            grace = int(pdf["grace_hours"].iloc[last])
        due = success + grace * hour
        expired = success < 0 or mark > due
        state.update((success, seen, ok, failures, grace))
        state.setTimeoutTimestamp(max(seen + retain_hours * hour if expired else due, mark) + 1)
        at = mark if expired and success >= 0 and mark > seen else seen
        moment = lambda ms: pd.Timestamp(ms, unit="ms", tz="UTC") if ms >= 0 else pd.NaT
        status = "expired" if expired else "healthy" if ok else "failing"
        yield pd.DataFrame({"source_id": [key[0]], "status": [status], "at": [moment(at)], "last_success_at": [moment(success)], "last_seen_at": [moment(seen)], "failures": [failures]})

    timed = visits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("source_id", "ts", "ok", "grace_hours")
    return timed.groupBy("source_id").applyInPandasWithState(step, HEALTH, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
