"""History of report summaries: an append-only Parquet table, never row data."""

from __future__ import annotations

import datetime as dt
import logging
import os
import time
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundrows.fixed_values import HISTORY_LIMIT, HISTORY_OFF_TOKENS, TREND_LIMIT
from soundrows.sources.tables import path_exists

SCHEMA = (
    "id bigint, created_at timestamp, dataset string, source string, variant string, "
    "row_count bigint, score double, grade string, errors bigint, warnings bigint, "
    "rules_failed bigint"
)
TREND_COLUMNS = ("created_at", "score", "errors", "warnings", "row_count")
SWITCH = "SOUNDROWS_HISTORY"

log = logging.getLogger(__name__)


class History:
    """Summaries under ``path``, one folder per dataset so that filters prune."""

    def __init__(self, spark: SparkSession, path: str, enabled: bool | None = None):
        self.spark = spark
        self.path = path
        if enabled is None:
            enabled = os.getenv(SWITCH, "on").lower() not in HISTORY_OFF_TOKENS
        self.enabled = enabled
        self._last_id = 0

    # -- writing -----------------------------------------------------------------
    def append(self, summaries: DataFrame, source: str, variant: str | None = None) -> None:
        """Append one row per summary straight from a summary frame."""
        if not self.enabled:
            return
        stamp = now()
        order = F.row_number().over(_by_dataset()) - 1
        first = self._reserved_ids(summaries.count())
        rows = summaries.select(
            (F.lit(first) + order).cast("bigint").alias("id"),
            F.lit(stamp).cast("timestamp").alias("created_at"),
            "dataset",
            F.lit(source).alias("source"),
            F.lit(variant).cast("string").alias("variant"),
            "row_count", "score", "grade", "errors", "warnings", "rules_failed",
        )
        self._write(rows)

    def save(self, reports: Iterable[Mapping[str, Any]], source: str) -> int:
        """Append the summaries of finished reports; returns how many were saved."""
        if not self.enabled:
            return 0
        stamp = now()
        rows = [
            (
                self._reserved_ids(1), stamp, r.get("dataset", "unknown"), source, r.get("variant"),
                int(r.get("row_count", 0)), float(r.get("summary", {}).get("score", 0.0)),
                str(r.get("summary", {}).get("grade", "")),
                *(int(r.get("summary", {}).get(f, 0))
                  for f in ("errors", "warnings", "rules_failed")),
            )
            for r in reports
        ]
        if rows:
            self._write(self.spark.createDataFrame(rows, SCHEMA).coalesce(1))
        return len(rows)

    def save_quietly(self, reports: Iterable[Mapping[str, Any]], source: str) -> int:
        """Like ``save``; a failed history write never fails a check."""
        try:
            return self.save(reports, source)
        except Exception:
            log.warning("history not written to %s", self.path, exc_info=True)
            return 0

    def clear(self) -> None:
        if path_exists(self.spark, self.path):
            empty = self.spark.createDataFrame([], SCHEMA)
            empty.write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).partitionBy("dataset").parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("dataset").parquet(self.path)

    def _reserved_ids(self, count: int) -> int:
        """The first of ``count`` ids of our own.

        Ids grow with time; the last one is kept so that a burst stays in order.
        """
        first = max(self._last_id + 1, time.time_ns() // 1000)
        self._last_id = first + max(count, 1) - 1
        return first

    # -- reading -----------------------------------------------------------------
    def records(self) -> DataFrame:
        if not self.enabled or not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).select(
            *[field.split()[0] for field in SCHEMA.split(", ")]
        )

    def recent(self, dataset: str | None = None, limit: int = 50) -> DataFrame:
        return recent(self.records(), dataset, limit)

    def trend(self, dataset: str, limit: int = 30) -> DataFrame:
        return trend(self.records(), dataset, limit)

    def datasets(self) -> DataFrame:
        return datasets(self.records())

    def overview(self, dataset: str | None = None, limit: int = 50) -> dict[str, Any]:
        return {
            "enabled": self.enabled,
            "datasets": [r["dataset"] for r in self.datasets().collect()],
            "records": [r.asDict() for r in self.recent(dataset, limit).collect()],
        }

    def trend_points(self, dataset: str, limit: int = 30) -> dict[str, Any]:
        if not self.enabled:
            return {"dataset": dataset, "points": [], "enabled": False}
        points = [r.asDict() for r in self.trend(dataset, limit).collect()]
        return {"dataset": dataset, "enabled": True, "count": len(points), "points": points}


def now() -> dt.datetime:
    """This second, with its time zone: Spark would read a bare time as local time."""
    return dt.datetime.now(dt.timezone.utc).replace(microsecond=0)


def _by_dataset():
    from pyspark.sql import Window

    # Summaries: one row per audited table.
    return Window.orderBy("dataset")


def _clamped(limit: int, most: int) -> int:
    return max(1, min(int(limit), most))


def recent(records: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first."""
    if dataset:
        records = records.filter(F.col("dataset") == dataset)
    return records.orderBy(F.desc("id")).limit(_clamped(limit, HISTORY_LIMIT))


def trend(records: DataFrame, dataset: str, limit: int = 30) -> DataFrame:
    """The last points of one dataset, oldest first."""
    newest = (
        records.filter(F.col("dataset") == dataset)
        .orderBy(F.desc("id"))
        .limit(_clamped(limit, TREND_LIMIT))
    )
    return newest.orderBy("id").select(*TREND_COLUMNS)


def datasets(records: DataFrame) -> DataFrame:
    return records.select("dataset").distinct().orderBy("dataset")
