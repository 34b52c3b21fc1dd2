"""Reports: the figures of one evaluation as a driver-side object or a document."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.fixed_values import (
    DIMENSIONS,
    ERROR,
    GRADES,
    IMPERFECT_CEILING,
    LOWEST_GRADE,
    SEVERITY_WEIGHTS,
    WARNING,
)
from soundrows.operators.evaluation import (
    TABLE_ROW,
    Evaluation,
    combined,
    dimensions_of,
    results_of,
    summary_of,
)

STATUSES = ("failed", "passed", "skipped")


def letter_grade(score: float) -> str:
    return next((letter for cutoff, letter in GRADES if score >= cutoff), LOWEST_GRADE)


def percent(checked: float, failed: float) -> float:
    score = round(100.0 * (1 - failed / checked), 1)
    return IMPERFECT_CEILING if failed > 0 and score >= 100.0 else score


class Report:
    """Collected counts of one table: one small row per rule, never table rows."""

    def __init__(self, evaluation: Evaluation, samples: bool = True):
        self.evaluation = evaluation
        profile = evaluation.profile
        self.generated_at = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        counts = {
            row["rule_index"]: row for row in combined(evaluation.measures()).collect()
        }
        self.row_count = counts[TABLE_ROW]["checked"]
        self.rows_with_errors = counts[TABLE_ROW]["failed"]
        shown: dict[int, list[dict[str, Any]]] = {}
        broken = any(row["failed"] for i, row in counts.items() if i != TABLE_ROW)
        if samples and broken:
            # At most a handful of rows per rule.
            for row in evaluation.samples().orderBy("rule_index", "rank").collect():
                rule = profile.rules[row["rule_index"]]
                cells = {c: row["row"][c] for c in rule.sample_columns(evaluation.columns)}
                shown.setdefault(row["rule_index"], []).append(
                    {"_line": row["_line"], **cells}
                )
        self.results = []
        for index in range(len(profile.rules)):
            row = counts[index]
            skipped = row["skip_reason"] is not None
            checked, failed = row["checked"], row["failed"]
            self.results.append(
                {
                    "rule_id": row["rule_id"],
                    "title": row["title"],
                    "category": row["category"],
                    "severity": row["severity"],
                    "column": row["column"],
                    "status": "skipped" if skipped else "failed" if failed else "passed",
                    "checked": checked,
                    "failed": failed,
                    "pass_rate": round(1.0 - failed / checked, 4) if checked else 1.0,
                    "message": row["message"],
                    "sample": shown.get(index, []),
                    "skip_reason": row["skip_reason"],
                }
            )

    @property
    def active(self) -> list[dict[str, Any]]:
        return [r for r in self.results if r["status"] != "skipped"]

    def _total(self, field: str, **match: str) -> int:
        return sum(
            r[field] for r in self.active if all(r[k] == v for k, v in match.items())
        )

    @property
    def score(self) -> float:
        checked, failed = (
            sum(weight * self._total(field, severity=severity)
                for severity, weight in SEVERITY_WEIGHTS.items())
            for field in ("checked", "failed")
        )
        return percent(checked, failed) if checked else 100.0

    def dimensions(self) -> dict[str, dict[str, Any]]:
        listed = {}
        for dimension in DIMENSIONS:
            checked = self._total("checked", category=dimension)
            failed = self._total("failed", category=dimension)
            listed[dimension] = {
                "rules": sum(r["category"] == dimension for r in self.active),
                "checked": checked,
                "failed": failed,
                "score": percent(checked, failed) if checked else None,
            }
        return listed

    def summary(self) -> dict[str, Any]:
        errors = self._total("failed", severity=ERROR)
        warnings = self._total("failed", severity=WARNING)
        clean = self.row_count - self.rows_with_errors
        status = [r["status"] for r in self.results]
        return {
            "score": self.score,
            "grade": letter_grade(self.score),
            "total_issues": errors + warnings,
            "errors": errors,
            "warnings": warnings,
            "rules_total": len(status),
            "rules_run": len(self.active),
            "rules_passed": status.count("passed"),
            "rules_failed": status.count("failed"),
            "rules_skipped": status.count("skipped"),
            "rows_with_errors": self.rows_with_errors,
            "clean_rows": clean,
            "clean_row_pct": round(100.0 * clean / self.row_count, 1)
            if self.row_count else 100.0,
        }

    def to_dict(self) -> dict[str, Any]:
        profile, columns = self.evaluation.profile, self.evaluation.columns
        return {
            "dataset": profile.key,
            "dataset_title": profile.title,
            "generated_at": self.generated_at,
            "row_count": self.row_count,
            "column_count": len(columns),
            "columns": columns,
            "summary": self.summary(),
            "dimensions": self.dimensions(),
            "results": self.results,
        }


# -- findings ----------------------------------------------------------------------
def findings(results: DataFrame, status: str | None = None) -> DataFrame:
    """Results of one status, or all of them."""
    return results if status is None else results.filter(F.col("status") == status)


def findings_by_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("findings"))


def _status_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))


def sorted_findings(results: DataFrame) -> DataFrame:
    """Failed, passed, skipped; errors first; most failures first."""
    return results.orderBy(
        _status_rank(), F.col("severity") != ERROR, F.desc("failed"), "rule_index"
    )


def failed_findings(results: DataFrame) -> DataFrame:
    """Failed rules only; errors first; most failures first."""
    return findings(results, "failed").orderBy(
        F.col("severity") != ERROR, F.desc("failed"), "rule_index"
    )


# -- documents ---------------------------------------------------------------------
def report_document(evaluation: Evaluation, samples: bool = True) -> DataFrame:
    """One row per table: dataset, summary, dimensions and results, nested.

    Write it with ``.write.json`` or turn it into text with ``to_json``.
    """
    measures = evaluation.measures()

    def nested(rows: DataFrame, order: str, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != "dataset"]
        entry = F.struct(order, *[c for c in fields if c != order])
        # One entry per rule or dimension of a profile.
        return rows.groupBy("dataset").agg(F.sort_array(F.collect_list(entry)).alias(name))

    results = results_of(measures)
    if samples:
        # A handful of rows per rule.
        shown = evaluation.samples().groupBy("rule_index").agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "_line", "row")),
                lambda a, b: a["rank"] - b["rank"],
            ).alias("sample")
        )
        results = results.join(shown, "rule_index", "left")
    described = [c for c in results.columns if c not in ("dataset", "rule_index")]
    results = results.groupBy("dataset").agg(
        F.array_sort(
            F.collect_list(F.struct("rule_index", *described)),
            lambda a, b: a["rule_index"] - b["rule_index"],
        ).alias("results")
    )
    summary = summary_of(measures)
    return (
        summary.select(
            "dataset",
            F.lit(evaluation.profile.title).alias("dataset_title"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
            "row_count",
            F.lit(len(evaluation.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in evaluation.columns]).alias("columns"),
            F.struct(*[c for c in summary.columns if c not in ("dataset", "row_count")])
            .alias("summary"),
        )
        .join(nested(dimensions_of(measures), "dimension_index", "dimensions"), "dataset")
        .join(results, "dataset")
    )
