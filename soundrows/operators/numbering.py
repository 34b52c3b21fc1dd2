"""Consecutive numbers in a global order, without one big window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.session import durable

ROWS_PER_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def numbered(frame: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add 1, 2, 3, ... in ``order``, which must be unique.

    The frame is range-sorted and materialised; the number is the row's place in its
    partition plus the rows of the partitions before it (one number per partition).
    """
    ordered = durable(frame.orderBy(*order))
    places = ordered.select(
        "*",
        F.spark_partition_id().alias("_partition"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_PER_PARTITION)).alias("_place"),
    )
    sizes = places.groupBy("_partition").count().collect()
    before, starts = 0, []
    for partition, rows in sorted((r["_partition"], r["count"]) for r in sizes):
        starts.append((partition, before))
        before += rows
    spark = frame.sparkSession
    offsets = spark.createDataFrame(starts, "_partition int, _before bigint")
    return (
        places.join(F.broadcast(offsets), "_partition")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_partition", "_place", "_before")
    )
