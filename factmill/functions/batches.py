"""Bounds of the Arrow batches that go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch; together they bound what a task holds, whatever the table's size.
ROWS, BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches by bytes too, so that long texts or whole blocks don't pile up in a Python worker. A longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
