"""Audit a set of tables together, with every foreign key resolvable."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.fixed_values import IMPERFECT_CEILING
from soundrows.functions import scoring
from soundrows.operators.evaluation import (
    Evaluation,
    dimensions_of,
    results_of,
    summary_of,
)
from soundrows.operators.keyed import DEFAULT_LIMITS, Limits
from soundrows.operators.report import Report, report_document
from soundrows.operators.rules import ForeignKey, ParentKeys, Tables
from soundrows.plans.profile import Registry
from soundrows.session import Workers


class Audit:
    """Evaluations of all recognised tables, in registry order."""

    def __init__(
        self,
        tables: Tables,
        registry: Registry,
        as_of: dt.date | str | None = None,
        limits: Limits = DEFAULT_LIMITS,
        **extra: Any,
    ):
        self.extra = extra
        profiles = [p for p in registry if p.key in tables]
        links = Counter(
            (rule.parent_table, rule.parent_column)
            for p in profiles
            for rule in p.rules
            if isinstance(rule, ForeignKey)
            and rule.skip_reason(tables[p.key].columns, tables) is None
        )
        shared = [link for link, uses in links.items() if uses > 1]
        # One plan shares equal exchanges by itself; separate jobs share stored keys.
        self._lazy = [Evaluation(tables[p.key], p, tables, as_of, limits) for p in profiles]
        parents = ParentKeys(tables, shared)
        self.evaluations = [
            Evaluation(tables[p.key], p, tables, as_of, limits, parents, lazy.date_formats)
            for p, lazy in zip(profiles, self._lazy)
        ]

    @property
    def recognised(self) -> list[str]:
        return [e.profile.key for e in self.evaluations]

    def measures(self, rows_with_errors: bool = True) -> DataFrame:
        """Counts of all tables in one plan; equal key scans are shared exchanges."""
        if rows_with_errors:
            self._prepare()
        bound = self.evaluations if rows_with_errors else self._lazy
        return reduce(DataFrame.unionByName, [e.measures(rows_with_errors) for e in bound])

    def _prepare(self) -> None:
        """Materialise the key verdicts of all tables; independent jobs overlap."""
        work = [
            (e, s) for e in self.evaluations for s in e.key_sets
            if any(rule.severity == "error" for _, rule in s.rules)
        ]
        with Workers(max_workers=8) as pool:
            list(pool.map(lambda pair: pair[0].verdicts(pair[1]), work))

    def results(self) -> DataFrame:
        return results_of(self.measures(rows_with_errors=False))

    def dimensions(self) -> DataFrame:
        return dimensions_of(self.measures(rows_with_errors=False))

    def summaries(self) -> DataFrame:
        return summary_of(self.measures())

    def aggregate(self) -> DataFrame:
        """One row: sums over the tables and the unweighted mean of their scores."""
        return aggregate_of(self.summaries())

    def reports(self, samples: bool = True) -> list[Report]:
        self._prepare()
        with Workers(max_workers=4) as pool:
            return list(pool.map(lambda e: Report(e, samples), self.evaluations))

    def documents(self, samples: bool = True) -> DataFrame:
        """One nested row per table; write it with ``.write.json``."""
        self._prepare()
        return reduce(
            DataFrame.unionByName, [report_document(e, samples) for e in self.evaluations]
        )

    def to_dict(self, source: str, samples: bool = True) -> dict[str, Any]:
        tables = [report.to_dict() for report in self.reports(samples)]
        summaries = [t["summary"] for t in tables]
        total = {
            name: sum(s[name] for s in summaries)
            for name in ("errors", "warnings", "total_issues")
        }
        total["rows"] = sum(t["row_count"] for t in tables)
        total["rows_with_errors"] = sum(s["rows_with_errors"] for s in summaries)
        total["tables"] = len(tables)
        score = round(sum(s["score"] for s in summaries) / len(tables), 1) if tables else 100.0
        if total["total_issues"] and score >= 100.0:
            score = IMPERFECT_CEILING
        total["score"] = score
        return {
            "source": source,
            "aggregate": total,
            "tables": tables,
            "recognised": [t["dataset"] for t in tables],
            **self.extra,
        }


def aggregate_of(summaries: DataFrame) -> DataFrame:
    def total(column: str):
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    sums = summaries.agg(
        total("errors").alias("errors"),
        total("warnings").alias("warnings"),
        total("total_issues").alias("total_issues"),
        total("row_count").alias("rows"),
        total("rows_with_errors").alias("rows_with_errors"),
        F.count(F.lit(1)).alias("tables"),
        F.avg("score").alias("_mean"),
    )
    mean = F.coalesce(F.bround("_mean", 1), F.lit(100.0))
    return sums.withColumn(
        "score", scoring.imperfect(mean, F.col("total_issues") > 0)
    ).drop("_mean")
