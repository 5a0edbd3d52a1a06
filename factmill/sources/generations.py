"""Search generations as immutable Parquet directories, and the manifest that says which is active.

The manifest is a folder of numbered entries, which are created only if they are absent. A writer reads the last number, and writes the next
one; of two that do so at once, one finds its number taken, and nothing of what it meant has happened. What a generation is (staged,
active, retired, failed) follows from the entries in order. The store must create files atomically unless they exist, as HDFS and
local disks do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "n long, event string, label string, at string"


class Conflict(RuntimeError):
    """Another writer has written the manifest entry; read the manifest again and decide anew."""


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last_entry(spark: SparkSession, root: str) -> int:
    p, fs = _files(spark, f"{root}/_manifest")
    return max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")), default=0) if fs.exists(p) else 0


def commit(spark: SparkSession, root: str, event: str, label: str, at, after: int | None = None) -> int:
    """Write the entry after `after` (the last one that the caller has seen; now's last one, if None). Conflict if it exists."""
    n = (last_entry(spark, root) if after is None else after) + 1
    p, fs = _files(spark, f"{root}/_manifest/{n:012d}.json")
    body = json.dumps({"n": n, "event": event, "label": label, "at": str(at)}) + "\n"
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"manifest entry {n} is there already") from e
        raise
    out.write(bytearray(body.encode()))
    out.close()
    return n


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All entries; none where there is no manifest yet."""
    p, fs = _files(spark, f"{root}/_manifest")
    return spark.read.schema(ENTRY).json(f"{root}/_manifest/*.json") if fs.exists(p) else spark.createDataFrame([], ENTRY)


def write_generation(chunks: DataFrame, label: str, root: str, vectors: DataFrame | None = None, at="") -> None:
    """Write a generation's chunks, with their vectors (chunk_id, embedding) if given, then its entry as staged; fails if it exists. A crash
    between files and entry leaves files that nobody reads, which recover() marks."""
    rows = chunks if vectors is None else chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    rows.write.mode("errorifexists").partitionBy("record_type").parquet(f"{root}/{label}")
    commit(chunks.sparkSession, root, "staged", label, at)


def states(spark: SparkSession, root: str) -> DataFrame:
    """label, status, at: each generation of the manifest by its entries; the last activation is the active one, earlier ones are retired."""
    log = manifest(spark, root)
    active = log.filter("event = 'activated'").agg(F.max_by("label", "n")).first()[0]
    last = log.groupBy("label").agg(F.max_by(F.struct("event", "at"), "n").alias("e"), F.bool_or(F.col("event") == "activated").alias("was"))
    status = F.when(F.col("label") == active if active else F.lit(False), "active").when(F.col("e.event") == "failed", "failed").when(F.col("was"), "retired").otherwise("staged")
    return last.select("label", status.alias("status"), F.col("e.at").alias("at"))


def activate(spark: SparkSession, root: str, label: str, at, after: int | None = None) -> int:
    """Make a staged or retired generation the active one. Of two activations that saw the same manifest (after), one fails with a Conflict."""
    seen = last_entry(spark, root) if after is None else after
    status = {r.status for r in states(spark, root).filter(F.col("label") == label).collect()}
    if not status & {"staged", "retired", "active"}:
        raise ValueError(f"generation {label} is {next(iter(status), 'unknown')}, not staged")
    return commit(spark, root, "activated", label, at, seen)


def active_label(spark: SparkSession, root: str) -> str:
    return manifest(spark, root).filter("event = 'activated'").agg(F.max_by("label", "n")).first()[0]


def read_generation(spark: SparkSession, root: str, label: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{label or active_label(spark, root)}")


def generation_states(spark: SparkSession, root: str, labels: DataFrame) -> DataFrame:
    """labels (label) with status: as the manifest has it; one that isn't in it is staged."""
    return labels.join(states(spark, root), "label", "left").select("label", F.coalesce("status", F.lit("staged")).alias("status"))


def recover(states: DataFrame) -> DataFrame:
    """After a crash: generations that were never activated have failed; the manifest's last activation stays the active one."""
    return states.withColumn("status", F.when(F.col("status") == "staged", "failed").otherwise(F.col("status")))


def sweep(spark: SparkSession, root: str, at="") -> list[str]:
    """After a crash: entries of failure for directories without any entry, and for staged generations that a crashed build left behind."""
    p, fs = _files(spark, root)
    there = {f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and not f.getPath().getName().startswith("_")} if fs.exists(p) else set()
    known = {r.label: r.status for r in states(spark, root).collect()}
    bad = sorted(label for label in there if known.get(label, "staged") == "staged")
    for label in bad:
        commit(spark, root, "failed", label, at)
    return bad


def delete_points(df: DataFrame, ids: DataFrame | None = None, equal: dict | None = None) -> DataFrame:
    """The rows that stay after deleting by chunk id, or by equality of columns; no filter deletes nothing."""
    if ids is not None:
        return df.join(ids.select("chunk_id"), "chunk_id", "left_anti")
    if not equal:
        return df
    hit = F.lit(True)
    for column, value in equal.items():
        hit = hit & F.coalesce(F.col(column) == value, F.lit(False))
    return df.filter(~hit)
