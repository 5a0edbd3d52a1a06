"""Record versions that arrive as a stream: validated, repeats left out, decided together with all versions of their scope.

The store is a table in buckets of scopes. A micro-batch reads and rewrites the buckets that it touches, into a folder of its own number; a
log says which batch wrote each bucket last. A batch that runs twice sees the same store as the first time, for it reads only
what smaller numbers wrote, and overwrites its own folder. Readers follow the log, and so never see half a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from factmill.operators.filters import can_serve
from factmill.operators.versions import upsert_records

#: Names that a decision adds to a version.
DECIDED = ("decision", "new_verification", "new_freshness", "new_serving", "new_authoritative", "review", "side")
NEEDED = ("record_version_id", "record_id", "record_type", "scope", "source_url", "effective_hash", "fetched_at", "tier")


def defects() -> Column:
    """What keeps a version out of the store: fields that are missing, a tier out of range; an empty array if nothing does."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in NEEDED]
    return F.array_compact(F.array(*missing, F.when(~F.col("tier").between(1, 5), F.lit("tier is out of range"))))


def _latest(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """bucket -> the batch that wrote it last; at most as many rows as there are buckets."""
    log = spark.read.schema("bucket int, written long, batch long").parquet(f"{root}/log")
    log = log if before is None else log.filter(F.col("written") < before)
    return {r.bucket: r.last for r in log.groupBy("bucket").agg(F.max("written").alias("last")).collect()}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_store(spark: SparkSession, root: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """All versions with their decisions; None as long as nothing has been written."""
    if not _exists(spark, f"{root}/log"):
        return None
    paths = [f"{root}/store/batch={n}/bucket={b}" for b, n in _latest(spark, root, before).items() if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def stream_upsert(stream: DataFrame, root: str, checkpoint: str, as_of: Column, buckets: int = 64) -> DataStreamWriter:
    """Validate, quarantine and upsert each micro-batch.

    Bad rows go to root/quarantine with their defects. Good ones replace versions of their id, and every version of a touched scope is decided
    again, so that the store ends as one decision over all rows would, whatever the order and the cut into batches. Where an incoming row needs
    review, no row of its scope stays in service (upsert_records). Scopes that nothing touches are neither read nor written."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        checked = batch.withColumn("defects", defects())
        checked.filter(F.size("defects") > 0).write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
        newest = F.max_by(F.struct(*batch.columns), F.struct("fetched_at", "effective_hash"))  # repeats of an id within the batch
        good = checked.filter(F.size("defects") == 0).groupBy("record_version_id").agg(newest.alias("r")).select("r.*")
        bucket = F.pmod(F.xxhash64("scope"), F.lit(buckets)).cast("int")
        touched = [r.b for r in good.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = read_store(spark, root, number, touched)
        if old is None:
            known = good.limit(0)
        else:
            served = old.withColumns({c: F.col(f"new_{c}") for c in ("verification", "freshness", "serving", "authoritative")})
            known = served.drop(*DECIDED).join(good.select("record_version_id"), "record_version_id", "left_anti")
        out = upsert_records(known, good, as_of)
        if old is not None:  # scopes of the bucket that nothing touched stay as they were decided
            out = out.filter("decision is not null").unionByName(old.join(good.select("scope").distinct(), "scope", "left_anti"), allowMissingColumns=True)
        out.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/store/batch={number}")
        spark.createDataFrame([(b, number) for b in touched], "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def servable(store: DataFrame) -> DataFrame:
    """Versions of the store that may be served after their decision."""
    return store.withColumns({c: F.col(f"new_{c}") for c in ("verification", "freshness", "serving", "authoritative")}).filter(can_serve())
