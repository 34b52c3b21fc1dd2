"""Quality gates: stop a job, or split a table into accepted and quarantined rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.errors import GateFailed
from soundrows.operators.evaluation import Evaluation
from soundrows.session import durable


def gate(report: dict[str, Any], max_errors: int = 0) -> dict[str, Any]:
    """Return a report, or an audit, that has few enough errors; raise otherwise."""
    errors = report.get("summary", report.get("aggregate"))["errors"]
    if errors > max_errors:
        raise GateFailed(f"{errors} errors found, {max_errors} allowed")
    return report


def split(evaluation: Evaluation) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (no error-level failure) and quarantined rows with their rule ids.

    The rules are evaluated once: the flagged rows are written to the shared folder, and both
    sides read them, in row order.
    """
    routed = durable(evaluation.flagged())
    accepted = routed.filter(~F.col("has_error")).drop("has_error", "failed_rules")
    return accepted, routed.filter("has_error").drop("has_error")
