"""Evaluate a profile on one table.

Plan shape: one scan computes every row rule and every "checked" count; each
distinct key set adds one pre-aggregation over its key columns only.  Rows are
joined to per-key verdicts only when row-level output is asked for (rows with
errors, samples, quarantine), and then against *broken* keys, which are
materialised, measured, and broadcast when small.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundrows.fixed_values import (
    DIMENSIONS,
    ERROR,
    FIRST_DATA_LINE,
    MESSAGES,
    SAMPLE_ROWS,
    SEVERITY_WEIGHTS,
    WARNING,
)
from soundrows.functions import scoring, text
from soundrows.operators.cells import Cells, as_of_column, named
from soundrows.operators.keyed import DEFAULT_LIMITS, Limits, attach, most_frequent, size_in_bytes
from soundrows.operators.rules import (
    Consistency,
    DateValid,
    KeyRule,
    ParentKeys,
    Rule,
    Tables,
    key_cell,
    key_type,
)
from soundrows.plans.profile import Profile
from soundrows.session import Workers, durable
from soundrows.sources import origin

TABLE_ROW = -1  # rule_index of the row that carries table-level counts
DESCRIBED = ("rule_id", "title", "category", "severity", "column", "message", "skip_reason")


@dataclass(frozen=True)
class KeySet:
    """Key rules that share their key columns and therefore one aggregation."""

    columns: tuple[str, ...]
    rules: tuple[tuple[int, KeyRule], ...]
    key: str      # name of the text key column on rows
    label: str


class Evaluation:
    """A profile bound to a table; every output is a DataFrame."""

    def __init__(
        self,
        table: DataFrame,
        profile: Profile,
        tables: Tables | None = None,
        as_of: dt.date | str | None = None,
        limits: Limits = DEFAULT_LIMITS,
        parents: ParentKeys | None = None,
        date_formats: Mapping[str, tuple[str, ...]] | None = None,
    ):
        """``date_formats`` (Java patterns by column) spares looking at the first dates."""
        self.table = table
        self.profile = profile
        self.tables = dict(tables or {})
        self.parents = parents or ParentKeys(self.tables)
        self.limits = limits
        self.columns = [c for c in table.columns if c not in origin.ORIGIN]
        self.skipped: dict[int, str] = {}
        self._verdicts: dict[int, tuple[DataFrame, int]] = {}
        self._failed: dict[int, Column] = {}
        # Rules on the same column share one "checked" count.
        self._checked: dict[int, str | None] = {}
        self._checks: dict[str, Column] = {}
        keyed: dict[tuple[str, ...], list] = {}
        reference_day = as_of_column(as_of)
        for index, rule in enumerate(profile.rules):
            reason = rule.skip_reason(self.columns, self.tables)
            if reason is not None:
                self.skipped[index] = reason
        if date_formats is None:
            date_formats = self._first_formats(reference_day)
        self.date_formats = date_formats
        self.cells = Cells(table.schema, reference_day, date_formats)
        for index, rule in self._active():
            self._checked[index] = self._check_name(rule)
            if isinstance(rule, KeyRule):
                keyed.setdefault(rule.key_columns, []).append((index, rule))
            else:
                self._failed[index] = rule.failed(self.cells)
        self.key_sets = [
            KeySet(columns, tuple(rules), f"_key_{n}", f"{profile.key}/{n}")
            for n, (columns, rules) in enumerate(keyed.items())
        ]

    def _first_formats(self, reference_day: Column) -> dict[str, tuple[str, ...]]:
        """The format of each text column that rules read as dates: its first value's."""
        probe = Cells(self.table.schema, reference_day)
        for _, rule in self._active():
            if isinstance(rule, (Consistency, DateValid)):
                rule.failed(probe)
        columns = list(dict.fromkeys(probe.dated))
        if not columns or self.table.isStreaming:
            return {}
        place = F.struct(*origin.ORIGIN)
        first = origin.with_origin(self.table).agg(
            *[
                F.min_by(named(c), F.when(text.present(named(c)), place)).alias(f"_first{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        return {c: text.formats_like(value) for c, value in zip(columns, first)}

    def _check_name(self, rule: Rule) -> str | None:
        """Name of the rule's presence check; None when it applies to every row."""
        check = rule.checked(self.cells)
        if check is None:
            return None
        columns = rule.key_columns if isinstance(rule, KeyRule) else (rule.column,)
        name = "_checked_" + "_".join(str(self.columns.index(c)) for c in columns)
        self._checks[name] = check
        return name

    # -- keys ------------------------------------------------------------------
    def _typed_key(self, columns: Sequence[str]) -> list[Column]:
        return [key_cell(named(c), self.cells.types[c]) for c in columns]

    def _text_key(self, parts: Sequence[Column]) -> Column:
        """One text per key; NULL when a part of it is."""
        if len(parts) == 1:
            return parts[0].cast("string")
        whole = reduce(Column.__and__, [p.isNotNull() for p in parts])
        return F.when(whole, F.to_json(F.array(*[p.cast("string") for p in parts])))

    def judged_keys(self, key_set: KeySet) -> DataFrame:
        """One row per distinct key: its row count and which rules it breaks."""
        parts = self._typed_key(key_set.columns)
        names = [f"_key{i}" for i in range(len(parts))]
        key_types = [key_type(self.cells.types[c]) for c in key_set.columns]
        marks, sums = [], []
        for index, rule in key_set.rules:
            for name, value in rule.marks(self.cells).items():
                marks.append(value.alias(f"_mark_{index}_{name}"))
                sums.append(F.sum(f"_mark_{index}_{name}").alias(f"_sum_{index}_{name}"))
        keys = (
            self.table.select(*[p.alias(n) for p, n in zip(parts, names)], *marks)
            .groupBy(*names)
            .agg(F.count(F.lit(1)).alias("_rows"), *sums)
        )
        types = dict(zip(names, key_types))
        broken = []
        for index, rule in key_set.rules:
            keys = rule.with_parents(keys, str(index), types, self.parents)
            broken.append(
                F.coalesce(rule.broken(keys, str(index), key_types), F.lit(False)).alias(
                    f"_broken{index}"
                )
            )
        return keys.select(
            self._text_key([F.col(n) for n in names]).alias(key_set.key), "_rows", *broken
        )

    def _any_broken(self, key_set: KeySet) -> Column:
        return reduce(Column.__or__, [F.col(f"_broken{i}") for i, _ in key_set.rules])

    def verdicts(self, key_set: KeySet) -> tuple[DataFrame, int]:
        """Broken and very frequent keys, materialised; and their measured size."""
        at = self.key_sets.index(key_set)
        if at not in self._verdicts:
            kept = durable(
                self.judged_keys(key_set).filter(
                    self._any_broken(key_set) | (F.col("_rows") >= self.limits.hot_rows)
                )
            )
            size = size_in_bytes(kept, key_set.key)
            self._verdicts[at] = (kept, size)
        return self._verdicts[at]

    # -- rows ------------------------------------------------------------------
    def _flagged(
        self,
        keep: Sequence[str],
        severities: Sequence[str],
        table: DataFrame | None = None,
    ) -> DataFrame:
        """Rows with one boolean ``_failed<i>`` per rule of the given severities.

        Row rules always get their flag.  ``keep`` names the columns to carry on;
        ``table`` may stand in for the table with columns added to it.
        """
        wanted = [
            s for s in self.key_sets
            if any(rule.severity in severities for _, rule in s.rules)
        ]
        with Workers(max_workers=max(len(wanted), 1)) as pool:
            measured = list(pool.map(self.verdicts, wanted))  # independent jobs
        rows = self.table if table is None else table
        identity = ()
        if any(size > self.limits.broadcast_bytes for _, size in measured):
            # Settled rows are spread by file position, which tells even copies
            # apart; rows without one are spread by their contents.
            located = rows if origin.FILE in rows.columns else origin.with_file_origin(rows)
            if located is not None:
                rows, identity = located, origin.ORIGIN
        carried = list(dict.fromkeys((*keep, *identity)))
        rows = self.cells.with_views(rows).select(
            *[named(c) for c in carried],
            *[flag.alias(f"_failed{i}") for i, flag in self._failed.items()],
            *[check.alias(name) for name, check in self._checks.items()],
            *[self._text_key(self._typed_key(s.columns)).alias(s.key) for s in wanted],
        )
        spread = [named(c) for c in identity or rows.columns]
        for key_set, (kept, size) in zip(wanted, measured):
            broken = kept.filter(self._any_broken(key_set) & F.col(key_set.key).isNotNull())
            carried = [named(c) for c in rows.columns]
            if size:
                small = size <= self.limits.broadcast_bytes
                hot = None if small else most_frequent(kept, key_set.key, self.limits)
                rows = attach(
                    rows, key_set.key, broken.drop("_rows"), spread, hot, small, self.limits
                )
            flags = []
            for index, _ in key_set.rules:
                found = F.coalesce(F.col(f"_broken{index}"), F.lit(False)) if size \
                    else F.lit(False)
                # Rows without a group break the rules that also count such rows.
                if self._checked[index] is None:
                    found = found | F.col(key_set.key).isNull()
                flags.append(found.alias(f"_failed{index}"))
            rows = rows.select(*carried, *flags)
        return rows

    def flagged(self) -> DataFrame:
        """The table plus ``failed_rules``: ids of the rules each row breaks."""
        rows = self._flagged(self.table.columns, (ERROR, WARNING))
        return rows.select(
            *[named(c) for c in self.columns],
            self._failed_ids((ERROR, WARNING)).alias("failed_rules"),
            (F.size(self._failed_ids((ERROR,))) > 0).alias("has_error"),
        )

    def _failed_ids(self, severities: Sequence[str]) -> Column:
        names = [
            F.when(F.col(f"_failed{i}"), F.lit(rule.rule_id))
            for i, rule in self._active()
            if rule.severity in severities
        ]
        return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")

    def _active(self) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.profile.rules) if i not in self.skipped]

    # -- counts ----------------------------------------------------------------
    def measures(self, rows_with_errors: bool = True) -> DataFrame:
        """Counts per rule, plus one row (index -1) with the table's counts.

        Without ``rows_with_errors`` nothing is materialised: the failed counts of
        key rules come straight from the pre-aggregated keys.
        """
        needs_keys = rows_with_errors and any(
            rule.severity == ERROR for s in self.key_sets for _, rule in s.rules
        )
        rows = self._flagged((), (ERROR,) if needs_keys else ())
        counts = ["count(*) AS _row_count"]
        counts += [f"count_if({check}) AS {check}" for check in self._checks]
        counts += [f"count_if(_failed{i}) AS _failed{i}" for i in self._failed]
        error_rows = "CAST(NULL AS BIGINT)"
        if rows_with_errors:
            errors = [
                f"_failed{i}" for i, rule in self._active()
                if rule.severity == ERROR and f"_failed{i}" in rows.columns
            ]
            counts.append(f"count_if({' OR '.join(errors) or 'false'}) AS _error_rows")
            error_rows = "_error_rows"
        scanned = [(TABLE_ROW, "_row_count", error_rows)]
        for index, _ in enumerate(self.profile.rules):
            if index in self.skipped:
                scanned.append((index, "0L", "0L"))
            else:
                checked = self._checked[index] or "_row_count"
                failed = f"_failed{index}" if index in self._failed else "0L"
                scanned.append((index, checked, failed))
        parts = [_stacked(rows.selectExpr(*counts), scanned)]
        for at, key_set in enumerate(self.key_sets):
            keys = self._verdicts[at][0] if at in self._verdicts else self.judged_keys(key_set)
            indices = [index for index, _ in key_set.rules]
            tallies = keys.selectExpr(
                *[f"coalesce(sum(if(_broken{i}, _rows, 0L)), 0L) AS _failed{i}" for i in indices]
            )
            parts.append(_stacked(tallies, [(i, "0L", f"_failed{i}") for i in indices]))
        rule = F.get(self._described_rules(), F.col("rule_index"))
        return reduce(DataFrame.unionByName, parts).select(
            F.lit(self.profile.key).alias("dataset"),
            "rule_index",
            *[rule.getField(f).alias(f) for f in DESCRIBED],
            "checked",
            "failed",
        )

    def _described_rules(self) -> Column:
        """The profile's rules as one constant array, in rule order."""
        described = []
        for index, rule in enumerate(self.profile.rules):
            reason = self.skipped.get(index)
            message = MESSAGES["skipped"].format(reason=reason) if reason else rule.message
            described.append({**rule.describe(), "message": message, "skip_reason": reason})
        fields = ", ".join(f"`{f}`: string" for f in DESCRIBED)
        return F.from_json(F.lit(json.dumps(described)), f"array<struct<{fields}>>")

    def results(self) -> DataFrame:
        """One row per rule, in profile order."""
        return results_of(self.measures(rows_with_errors=False))

    def dimensions(self) -> DataFrame:
        """One row per quality dimension; all five are always listed."""
        return dimensions_of(self.measures(rows_with_errors=False))

    def summary(self) -> DataFrame:
        """One row of table-level figures."""
        return summary_of(self.measures())

    # -- samples ---------------------------------------------------------------
    def samples(self, order_by: Sequence[str] | None = None) -> DataFrame:
        """The first offending rows of every rule, in row order.

        Rows come in the order of ``order_by`` when given (it must be a total
        order), else in file order, and then carry their line number.
        """
        table = self.table if order_by else origin.with_origin(self.table)
        order = tuple(order_by or origin.ORIGIN)
        shown_columns = [
            c for _, rule in self._active() for c in rule.sample_columns(self.columns)
        ]
        kept = list(dict.fromkeys((*shown_columns, *order)))
        rows = self._flagged(kept, (ERROR, WARNING), table)
        broken = F.array_compact(
            F.array(*[F.when(F.col(f"_failed{i}"), F.lit(i)) for i, _ in self._active()])
        )
        hits = rows.select(
            *[named(c) for c in kept], F.explode(broken).alias("rule_index")
        )
        # Every task keeps its own first rows per rule before anything is shuffled.
        first = Window.partitionBy("rule_index").orderBy(*[named(c) for c in order])
        top = hits.withColumn("rank", F.row_number().over(first)).filter(
            F.col("rank") <= SAMPLE_ROWS
        )
        shown = reduce(
            lambda chain, entry: chain.when(F.col("rule_index") == entry[0], entry[1]),
            [(i, self._shown(rule)) for i, rule in self._active()],
            F,
        )
        numbered = (
            top.withColumn("_line", F.lit(None).cast("bigint")) if order_by
            else self._numbered(table, top)
        )
        rule = F.get(self._described_rules(), F.col("rule_index"))
        return numbered.select(
            F.lit(self.profile.key).alias("dataset"),
            "rule_index",
            rule.getField("rule_id").alias("rule_id"),
            "rank",
            "_line",
            shown.alias("row"),
        )

    def _shown(self, rule: Rule) -> Column:
        pairs = []
        for column in rule.sample_columns(self.columns):
            pairs += [F.lit(column), named(column).cast("string")]
        return F.create_map(*pairs)

    def _numbered(self, table: DataFrame, top: DataFrame) -> DataFrame:
        """Line numbers for a handful of sampled rows.

        Rows that know their place in their file need no more; for others the rows of each
        block are counted.  ``top`` holds at most SAMPLE_ROWS rows per rule, so it is the
        broadcast side.
        """
        if origin.knows_row_index(self.table):
            line = F.col(origin.SEQUENCE) + F.lit(FIRST_DATA_LINE)
            return top.withColumn("_line", line.cast("bigint"))
        place = [origin.FILE, origin.BLOCK]
        before = (
            Window.partitionBy(origin.FILE)
            .orderBy(origin.BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        blocks = (
            table.groupBy(*place)
            .agg(
                F.count(F.lit(1)).alias("_block_rows"),
                F.min(origin.SEQUENCE).alias("_block_first"),
            )
            .withColumn("_earlier", F.coalesce(F.sum("_block_rows").over(before), F.lit(0)))
        )
        located = blocks.join(F.broadcast(top), place, "inner")
        in_block = F.col(origin.SEQUENCE) - F.col("_block_first")
        if origin.FILE in self.table.columns:
            # Rows that were made from other rows leave gaps in the sequence.
            wanted = top.select(*place, F.col(origin.SEQUENCE).alias("_at")).distinct()
            ranks = (
                table.select(*origin.ORIGIN)
                .join(F.broadcast(wanted), place)
                .filter(F.col(origin.SEQUENCE) < F.col("_at"))
                .groupBy(*place, F.col("_at").alias(origin.SEQUENCE))
                .agg(F.count(F.lit(1)).alias("_in_block"))
            )
            located = located.join(F.broadcast(ranks), list(origin.ORIGIN), "left")
            in_block = F.coalesce(F.col("_in_block"), F.lit(0))
        line = F.col("_earlier") + in_block + F.lit(FIRST_DATA_LINE)
        return located.withColumn("_line", line.cast("bigint"))


def _stacked(totals: DataFrame, counts: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Turn one row of totals into (rule_index, checked, failed) rows."""
    values = ", ".join(f"{index}, {checked}, {failed}" for index, checked, failed in counts)
    return totals.selectExpr(f"stack({len(counts)}, {values}) AS (rule_index, checked, failed)")


# -- derived frames ---------------------------------------------------------------
def combined(measures: DataFrame) -> DataFrame:
    """Bring the scan's and the keys' halves of every rule together."""
    return measures.groupBy("dataset", "rule_index", *DESCRIBED).agg(
        F.sum("checked").alias("checked"), F.sum("failed").alias("failed")
    )


def results_of(measures: DataFrame) -> DataFrame:
    rules = combined(measures.filter(F.col("rule_index") > TABLE_ROW))
    status = (
        F.when(F.col("skip_reason").isNotNull(), "skipped")
        .when(F.col("failed") == 0, "passed")
        .otherwise("failed")
    )
    failed_share = F.when(F.col("checked") == 0, F.lit(0.0)).otherwise(
        F.col("failed") / F.col("checked")
    )
    return rules.select(
        "dataset", "rule_index", "rule_id", "title", "category", "severity", "column",
        status.alias("status"), "checked", "failed",
        F.bround(F.lit(1.0) - failed_share, 4).alias("pass_rate"),
        "message", "skip_reason",
    )


def dimensions_of(measures: DataFrame) -> DataFrame:
    listed = F.inline(
        F.array(*[F.struct(F.lit(d).alias("category"), F.lit(n).alias("dimension_index"))
                  for n, d in enumerate(DIMENSIONS)])
    )
    tables = measures.filter(F.col("rule_index") == TABLE_ROW).select("dataset", listed).select(
        "dataset", "category", "dimension_index",
        F.lit(0).cast("bigint").alias("rules"),
        F.lit(0).cast("bigint").alias("checked"),
        F.lit(0).cast("bigint").alias("failed"),
    )
    place = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("category"))
    active = combined(
        measures.filter((F.col("rule_index") > TABLE_ROW) & F.col("skip_reason").isNull())
    ).select(
        "dataset", "category", (place - 1).cast("int").alias("dimension_index"),
        F.lit(1).cast("bigint").alias("rules"), "checked", "failed",
    )
    totals = tables.unionByName(active).groupBy("dataset", "dimension_index", "category").agg(
        F.sum("rules").alias("rules"),
        F.sum("checked").alias("checked"),
        F.sum("failed").alias("failed"),
    )
    score = scoring.percent_passed(
        F.col("checked"), F.col("failed"), F.lit(None).cast("double")
    )
    return totals.withColumn("score", score)


def summary_of(measures: DataFrame) -> DataFrame:
    rules = combined(measures)
    is_rule = F.col("rule_index") > TABLE_ROW
    ran = is_rule & F.col("skip_reason").isNull()

    def total(column: str, severity: str) -> Column:
        return F.coalesce(
            F.sum(F.when(ran & (F.col("severity") == severity), F.col(column))), F.lit(0)
        )

    def how_many(condition: Column) -> Column:
        return F.count_if(condition).cast("bigint")

    totals = rules.groupBy("dataset").agg(
        F.max(F.when(~is_rule, F.col("checked"))).alias("row_count"),
        F.max(F.when(~is_rule, F.col("failed"))).alias("rows_with_errors"),
        total("failed", ERROR).alias("errors"),
        total("failed", WARNING).alias("warnings"),
        total("checked", ERROR).alias("_errors_checked"),
        total("checked", WARNING).alias("_warnings_checked"),
        how_many(is_rule).alias("rules_total"),
        how_many(ran).alias("rules_run"),
        how_many(ran & (F.col("failed") == 0)).alias("rules_passed"),
        how_many(ran & (F.col("failed") > 0)).alias("rules_failed"),
        how_many(is_rule & F.col("skip_reason").isNotNull()).alias("rules_skipped"),
    )
    light = F.lit(SEVERITY_WEIGHTS[WARNING])
    score = scoring.percent_passed(
        F.col("_errors_checked") + light * F.col("_warnings_checked"),
        F.col("errors") + light * F.col("warnings"),
        F.lit(100.0),
    )
    clean = F.col("row_count") - F.col("rows_with_errors")
    return totals.withColumn("score", score).select(
        "dataset", "row_count", "score",
        scoring.grade(F.col("score")).alias("grade"),
        (F.col("errors") + F.col("warnings")).alias("total_issues"),
        "errors", "warnings",
        "rules_total", "rules_run", "rules_passed", "rules_failed", "rules_skipped",
        "rows_with_errors",
        clean.alias("clean_rows"),
        scoring.share(clean, F.col("row_count"), 1, 100.0, 100.0).alias("clean_row_pct"),
    )
