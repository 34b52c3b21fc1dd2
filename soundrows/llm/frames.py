"""Frames with neutral column names, and results written once to the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.operators.cells import named

#: Bytes handed to a Python worker at once (or one longer row).  Spark's own 64 MB would be
#: held several times over on both sides of the pipe.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """Hand at most ``BATCH_BYTES`` to a Python worker at once, from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Renamed:
    """A frame whose columns are called ``c0, c1, ...`` so that helper columns cannot clash.

    ``back`` drops the helper columns and restores the names.
    """

    def __init__(self, frame: DataFrame):
        self.columns = frame.columns
        self.frame = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])

    def name(self, column: str) -> str:
        return f"c{self.columns.index(column)}"

    def column(self, column: str) -> Column:
        return F.col(self.name(column))

    def back(self, frame: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
        own = [F.col(f"c{i}").alias(c) for i, c in enumerate(self.columns)]
        return frame.select(*own, *extra)


def narrowed(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the needed columns, under the operator's own names.

    ``narrowed(docs, doc_id="id", text="body")`` gives the columns doc_id and text.
    """
    return frame.select(*[named(theirs).alias(ours) for ours, theirs in columns.items()])
