"""What the training-data operators share: reading, checkpoints, Arrow batches, and blocks of numbers that cross a shuffle."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python; together they bound what a task holds.
BATCH_ROWS, BATCH_BYTES = 5000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes too, so that very long texts don't pile up in a Python worker; let workers import this package."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not place:
        place = sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place if ":/" in place else "file://" + os.path.abspath(place)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and checkpoints of finished steps; it waits for the driver's garbage collector, which
    a driver with little to do hardly runs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one more column, a long that tells apart rows of different ids or texts, and sorts as they do by id.

    It is the id itself where no id is missing or repeated. Else rows without an id come last, rows that share one are sorted by a 64-bit
    hash of their texts, and rows that repeat an id and a text have one number.
    """
    some = df.select(F.col(id_col).alias("id"))
    if some.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").isEmpty():
        return df.withColumn(name, F.col(id_col).cast("long"))
    keys = [f"{name}_null", f"{name}_id", f"{name}_tag"]
    parts = [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    keyed = df.withColumns(dict(zip(keys, parts)))
    # sorted by ranges, so that numbers grow with the partitions
    order = cut(keyed.select(keys).distinct().orderBy(keys).withColumn(name, F.monotonically_increasing_id()))
    return keyed.join(order.hint("shuffle_hash"), keys).drop(*keys)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows; one scan of that column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def buckets_for(total_bytes: int, per_bucket: int) -> int:
    """So many buckets that each holds about per_bucket bytes; grows with the input."""
    return max(8, -(-total_bytes // per_bucket))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its offsets (rows + 1); null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind, (_, offsets, data) = (np.int64 if wide else np.int32), array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def sliced(body: np.ndarray, offsets: np.ndarray, most: int):
    """(first text, body, offsets) of runs of whole texts of about `most` bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def word_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and the first word of each text (rows + 1)."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((body == 32) | ((body >= 9) & (body <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(body)]
    first[inner] = solid[inner]  # a word never crosses into the next text
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def merged_spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + length) over sorted starts as maximal runs."""
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + length
    at = np.flatnonzero(new)
    return starts[at], starts[np.append(at[1:], len(starts)) - 1] + length
