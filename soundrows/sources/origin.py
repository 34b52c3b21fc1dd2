"""Where a row comes from: file, block and sequence inside the block.

Rows are tagged only when something asks for row order.  File metadata is not pruned
from scans, so readers do not carry it along.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "_src_file"
BLOCK = "_src_block"
SEQUENCE = "_src_seq"
ORIGIN = (FILE, BLOCK, SEQUENCE)


def _tagged(frame: DataFrame, file: Column, block: Column, sequence: Column) -> DataFrame:
    return frame.select(
        "*",
        file.alias(FILE),
        block.cast("bigint").alias(BLOCK),
        sequence.cast("bigint").alias(SEQUENCE),
    )


def file_metadata(frame: DataFrame) -> list[str] | None:
    """What is known of the file of each row; None when the frame is no file scan."""
    # A frame without file metadata is an ordinary answer here, not an error to log.
    query_log = logging.getLogger("DataFrameQueryContextLogger")
    was_off, query_log.disabled = query_log.disabled, True
    try:
        return frame.select("_metadata").schema[0].dataType.names
    except AnalysisException:
        return None
    finally:
        query_log.disabled = was_off


def knows_row_index(frame: DataFrame) -> bool:
    """Does the place of a row in its file come with the row?"""
    return FILE not in frame.columns and "row_index" in (file_metadata(frame) or ())


def with_file_origin(frame: DataFrame) -> DataFrame | None:
    """Tag the rows of a file scan; None when the frame is not one.

    Parquet knows each row's index in its file.  Other formats number the rows of
    each block (split) in reading order.
    """
    known = file_metadata(frame)
    if known is None:
        return None
    path = F.col("_metadata.file_path")
    if "row_index" in known:
        return _tagged(frame, path, F.lit(0), F.col("_metadata.row_index"))
    return _tagged(
        frame, path, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )


def with_origin(frame: DataFrame) -> DataFrame:
    """Tag rows by file position, or by partition where there is no file."""
    if FILE in frame.columns:
        return frame
    tagged = with_file_origin(frame)
    if tagged is not None:
        return tagged
    return _tagged(
        frame, F.lit(""), F.spark_partition_id(), F.monotonically_increasing_id()
    )
