"""Entry points: check one table, a CSV file, a table set, a FHIR bundle, an HL7 feed."""

from __future__ import annotations

import datetime as dt
import functools
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from soundrows.errors import CheckError
from soundrows.fixed_values import MAX_INPUT_BYTES, MAX_INPUT_ROWS
from soundrows.operators.audit import Audit
from soundrows.operators.evaluation import Evaluation
from soundrows.operators.report import Report
from soundrows.operators.rules import Tables
from soundrows.plans.catalogue import clinical_registry
from soundrows.plans.profile import Registry
from soundrows.session import tidy
from soundrows.sources import tables as table_source
from soundrows.sources.csv import stage_csv
from soundrows.sources.origin import ORIGIN
from soundrows.sources.history import History


#: Usual limits of a single process: ``Checker(spark, **USUAL_LIMITS)``.
USUAL_LIMITS = {"max_bytes": MAX_INPUT_BYTES, "max_rows": MAX_INPUT_ROWS}


def _tidied(check):
    """Checks return plain values, so what they store on the way goes when they end."""

    @functools.wraps(check)
    def tidied(self, *args, **kwargs):
        with tidy(self.spark):
            return check(self, *args, **kwargs)

    return tidied


class Checker:
    """The catalogue, the reference day and the history that checks share."""

    def __init__(
        self,
        spark: SparkSession,
        registry: Registry | None = None,
        history: History | None = None,
        as_of: dt.date | str | None = None,
        max_bytes: int | None = None,
        max_rows: int | None = None,
    ):
        self.spark = spark
        self.registry = registry or clinical_registry()
        self.history = history
        self.as_of = as_of
        self.max_bytes = max_bytes
        self.max_rows = max_rows

    def evaluate(
        self, table: DataFrame, dataset: str | None = None, tables: Tables | None = None
    ) -> tuple[Evaluation, bool]:
        """Bind a table to its named or detected profile."""
        columns = [c for c in table.columns if c not in ORIGIN]
        profile, detected = self.registry.resolve(columns, dataset)
        return Evaluation(table, profile, tables, self.as_of), detected

    @_tidied
    def check_table(
        self, table: DataFrame, dataset: str | None = None, tables: Tables | None = None
    ) -> dict[str, Any]:
        evaluation, detected = self.evaluate(table, dataset, tables)
        return {**Report(evaluation).to_dict(), "auto_detected": detected}

    @_tidied
    def check_csv(self, path: str, dataset: str | None = None) -> dict[str, Any]:
        """Check one file on its own; links to other tables are skipped."""
        self._guard_bytes(path)
        table = stage_csv(self.spark, path)
        table_source.check_not_empty(table)
        self._guard_rows([table])
        report = self.check_table(table, dataset)
        self._remember([report], "upload")
        return report

    @_tidied
    def check_member(self, folder: str, dataset: str, variant: str | None = None) -> dict:
        """Check one table of a set, with its sibling tables available for links."""
        if self.registry.get(dataset) is None:
            raise CheckError(f"There is no profile '{dataset}'.")
        tables = self._load(folder)
        if dataset not in tables:
            raise CheckError(f"No table '{dataset}' in '{folder}'.")
        report = self.check_table(tables[dataset], dataset, tables)
        report["variant"] = variant
        self._remember([report], "sample")
        return report

    @_tidied
    def audit_folder(self, folder: str, **extra: Any) -> dict[str, Any]:
        tables = self._load(folder)
        if not tables:
            raise CheckError(f"No tables found in '{folder}'.")
        return self.audit_tables(tables, "audit", **extra)

    @_tidied
    def audit_tables(self, tables: Tables, source: str, **extra: Any) -> dict[str, Any]:
        self._guard_rows(tables.values())
        result = Audit(tables, self.registry, self.as_of, **extra).to_dict(source)
        self._remember(result["tables"], source)
        return result

    @_tidied
    def check_fhir(self, path: str) -> dict[str, Any]:
        """Audit the tables of one bundle file."""
        from soundrows.sources import fhir

        self._guard_bytes(path)
        tables = fhir.tables_of_bundle(self.spark, path)
        return self.audit_tables(tables, "fhir", format="FHIR R4")

    @_tidied
    def check_fhir_folder(self, folder: str) -> dict[str, Any]:
        """Audit a folder of bundles as if they were one.

        Files that are no bundle are skipped and counted by reason in ``skipped``; their
        names are in ``fhir.skipped_in_folder``.
        """
        from soundrows.sources import fhir

        audit = self.audit_tables(
            fhir.tables_of_folder(self.spark, folder), "fhir", format="FHIR R4"
        )
        reasons = fhir.skipped_in_folder(self.spark, folder).groupBy("reason").count()
        return {**audit, "skipped": {r["reason"]: r["count"] for r in reasons.collect()}}

    @_tidied
    def check_hl7(self, path: str) -> dict[str, Any]:
        from soundrows.sources import hl7

        self._guard_bytes(path)
        tables = hl7.tables_of_feed(self.spark, path)
        return self.audit_tables(tables, "hl7v2", format="HL7 v2")

    # -- helpers -----------------------------------------------------------------
    def _load(self, folder: str) -> dict[str, DataFrame]:
        return table_source.load_csv_tables(
            self.spark, folder, [p.key for p in self.registry], staged=True
        )

    def _guard_bytes(self, path: str) -> None:
        if self.max_bytes is not None:
            table_source.check_bytes(self.spark, path, self.max_bytes)

    def _guard_rows(self, tables) -> None:
        if self.max_rows is not None:
            table_source.check_rows(tables, self.max_rows)

    def _remember(self, reports: list[dict[str, Any]], source: str) -> None:
        if self.history is not None:
            self.history.save_quietly(reports, source)
