"""History reads over runs derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.queries.register import query, table
from soundrows.sources import history

RUNS = """
    runs AS (
        SELECT date_diff('day', DATE '1970-01-01', ts::DATE) * 10 + length(event_type) AS id,
               ts::DATE::TIMESTAMP AS created_at, event_type AS dataset,
               CAST(count(*) AS BIGINT) AS row_count,
               CAST(count(*) FILTER (WHERE value < 10) AS BIGINT) AS errors,
               CAST(count(*) FILTER (WHERE value >= 90) AS BIGINT) AS warnings,
               round_even(100.0 * (1.0 - (count(*) FILTER (WHERE value < 10))::DOUBLE
                                         / count(*)), 1) AS score
        FROM events GROUP BY ts::DATE, event_type)"""


def runs(spark, folder) -> DataFrame:
    """One run per day and event type, as if each day's events had been checked."""
    day = F.to_date("ts").alias("day")
    counts = table(spark, folder, "events").groupBy(day, "event_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("value") < 10).cast("bigint").alias("errors"),
        F.count_if(F.col("value") >= 90).cast("bigint").alias("warnings"),
    )
    score = F.lit(100.0) * (F.lit(1.0) - F.col("errors") / F.col("row_count"))
    return counts.select(
        (F.unix_date("day") * 10 + F.length("event_type")).cast("bigint").alias("id"),
        F.col("day").cast("timestamp_ntz").alias("created_at"),
        F.col("event_type").alias("dataset"),
        "row_count", "errors", "warnings",
        F.bround(score, 1).alias("score"),
    )


@query("history_recent", f"""
    WITH {RUNS} SELECT id, dataset, row_count, errors, warnings, score
    FROM runs WHERE dataset = 'purchase' ORDER BY id DESC LIMIT 20""")
def history_recent(spark, folder):
    return history.recent(runs(spark, folder), "purchase", 20).select(
        "id", "dataset", "row_count", "errors", "warnings", "score"
    )


@query("history_trend", f"""
    WITH {RUNS} SELECT * FROM (
        SELECT created_at, score, errors, warnings, row_count FROM runs
        WHERE dataset = 'signup' ORDER BY id DESC LIMIT 14) ORDER BY created_at""")
def history_trend(spark, folder):
    return history.trend(runs(spark, folder), "signup", 14)


@query("history_datasets", f"WITH {RUNS} SELECT DISTINCT dataset FROM runs ORDER BY dataset")
def history_datasets(spark, folder):
    return history.datasets(runs(spark, folder))
