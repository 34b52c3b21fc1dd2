"""The ten declarative rule types.

A rule never touches rows itself.  Row rules answer with boolean expressions over
the typed views of one table and are evaluated together in a single scan.  Key
rules judge a key by its group (how often it occurs, whether a parent has it) and
are evaluated on pre-aggregated keys, so a key that holds a large part of a table
is one row before anything is shuffled.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundrows.fixed_values import (
    ALLOWED_VALUES_PREVIEW,
    BOOLEAN_TOKENS,
    ERROR,
    MESSAGES,
    NOT_NULL_SAMPLE_COLUMNS,
    SKIP_REASONS,
    TRUE_TOKENS,
    WARNING,
)
from soundrows.functions import text
from soundrows.operators.cells import Cells, named
from soundrows.session import durable

Tables = Mapping[str, DataFrame]


class Rule:
    """What every rule declares: identity, dimension, severity and wording."""

    dimension = "validity"

    def __init__(self, rule_id: str, title: str, column: str, severity: str = ERROR):
        if severity not in (ERROR, WARNING):
            raise ValueError(f"unknown severity {severity!r}")
        self.rule_id = rule_id
        self.title = title
        self.column = column
        self.severity = severity

    @property
    def message(self) -> str:
        raise NotImplementedError

    def skip_reason(self, columns: Sequence[str], tables: Tables) -> str | None:
        """Why the rule cannot run on a table with these columns; None when it can."""
        if self.column in columns:
            return None
        return SKIP_REASONS["column"].format(column=self.column)

    def sample_columns(self, columns: Sequence[str]) -> list[str]:
        return [self.column]

    def describe(self) -> dict[str, str]:
        return {
            "rule_id": self.rule_id,
            "title": self.title,
            "category": self.dimension,
            "severity": self.severity,
            "column": self.column,
        }


class RowRule(Rule):
    """A rule decided by one row alone."""

    def checked(self, cells: Cells) -> Column | None:
        """Rows the rule applies to; None means every row."""
        return cells.present(self.column)

    def failed(self, cells: Cells) -> Column:
        """Rows that break the rule.  NULL counts as not broken."""
        raise NotImplementedError


class NotNull(RowRule):
    """The value is neither NULL nor blank."""

    dimension = "completeness"

    @property
    def message(self):
        return MESSAGES["not_null"].format(column=self.column)

    def sample_columns(self, columns):
        return list(columns)[:NOT_NULL_SAMPLE_COLUMNS]

    def checked(self, cells):
        return None

    def failed(self, cells):
        return ~cells.present(self.column)


class AllowedValues(RowRule):
    """The value belongs to a fixed set; compared as text without trimming."""

    def __init__(
        self,
        rule_id: str,
        title: str,
        column: str,
        allowed: Iterable[Any],
        severity: str = ERROR,
        case_sensitive: bool = True,
    ):
        super().__init__(rule_id, title, column, severity)
        words = {str(value) for value in allowed}
        self.case_sensitive = case_sensitive
        self.allowed = words if case_sensitive else {word.lower() for word in words}

    @property
    def message(self):
        preview = ", ".join(sorted(self.allowed)[:ALLOWED_VALUES_PREVIEW])
        return MESSAGES["allowed_values"].format(column=self.column, preview=preview)

    def failed(self, cells):
        value = cells.text(self.column)
        if not self.case_sensitive:
            value = F.lower(value)
        return cells.present(self.column) & ~value.isin(*sorted(self.allowed))


NAMED_GROUP = re.compile(r"\(\?P<(\w+)>")
NAMED_REFERENCE = re.compile(r"\(\?P=(\w+)\)")
UNSUPPORTED = (
    (re.compile(r"\(\?\("), "conditional groups"),
    (re.compile(r"\(\?[aiLmsux]*L"), "locale flags"),
    (re.compile(r"\\N\{"), "characters by name"),
)


def java_pattern(pattern: str) -> str:
    """A Python pattern as Java writes it; ValueError for what Java does not have.

    Escaped backslashes are skipped, so that only real group openings count.
    """
    plain = re.sub(r"\\\\", "  ", pattern)  # same length
    for found, what in UNSUPPORTED:
        if found.search(plain):
            raise ValueError(f"pattern {pattern!r}: {what} are not supported")
    try:
        re.compile(pattern)
    except re.error as error:
        if "possessive" not in str(error):
            raise ValueError(f"pattern {pattern!r}: {error}") from None
    named = lambda m: m[1].replace("_", "U")  # noqa: E731  Java's names are letters and digits
    out, done = [], 0
    for m in re.finditer(r"\(\?P<\w+>|\(\?P=\w+\)|\\Z", plain):
        out.append(pattern[done : m.start()])
        if group := NAMED_GROUP.fullmatch(m[0]):
            out.append(f"(?<{named(group)}>")
        elif group := NAMED_REFERENCE.fullmatch(m[0]):
            out.append(rf"\k<{named(group)}>")
        else:
            out.append(r"\z")
        done = m.end()
    return "".join([*out, pattern[done:]])


class Regex(RowRule):
    """The value matches a pattern from its first character on."""

    def __init__(
        self,
        rule_id: str,
        title: str,
        column: str,
        pattern: str,
        severity: str = ERROR,
        hint: str = "",
    ):
        super().__init__(rule_id, title, column, severity)
        self.pattern = java_pattern(pattern)
        self.hint = hint

    @property
    def message(self):
        wording = "regex_hint" if self.hint else "regex"
        return MESSAGES[wording].format(column=self.column, hint=self.hint)

    def failed(self, cells):
        # Only \n ends a line, and character classes are Unicode, as in Python patterns.
        anchored = rf"(?dU)\A(?:{self.pattern})"
        return cells.present(self.column) & ~cells.text(self.column).rlike(anchored)


class IntegerType(RowRule):
    """The value is a whole number in any numeric notation."""

    @property
    def message(self):
        return MESSAGES["integer"].format(column=self.column)

    def failed(self, cells):
        value = cells.number(self.column)
        whole = F.coalesce(value == F.rint(value), F.lit(False))
        return cells.present(self.column) & ~whole


class NumericRange(RowRule):
    """The value is a number between optional inclusive bounds."""

    def __init__(
        self,
        rule_id: str,
        title: str,
        column: str,
        min_value: float | None = None,
        max_value: float | None = None,
        severity: str = ERROR,
    ):
        super().__init__(rule_id, title, column, severity)
        self.min_value = min_value
        self.max_value = max_value

    @property
    def message(self):
        bounds = [
            f"{sign} {bound}"
            for sign, bound in ((">=", self.min_value), ("<=", self.max_value))
            if bound is not None
        ]
        return MESSAGES["number"].format(
            column=self.column, bounds=" and ".join(bounds) or "numeric"
        )

    def failed(self, cells):
        value = cells.number(self.column)
        inside = value.isNotNull()
        if self.min_value is not None:
            inside = inside & (value >= F.lit(float(self.min_value)))
        if self.max_value is not None:
            inside = inside & (value <= F.lit(float(self.max_value)))
        return cells.present(self.column) & ~F.coalesce(inside, F.lit(False))


class BooleanType(RowRule):
    """The value is one of the accepted truth words."""

    @property
    def message(self):
        return MESSAGES["boolean"].format(column=self.column)

    def failed(self, cells):
        word = F.lower(cells.text(self.column))
        return cells.present(self.column) & ~word.isin(*BOOLEAN_TOKENS)


class DateValid(RowRule):
    """The value is a calendar date inside a plausible window."""

    def __init__(
        self,
        rule_id: str,
        title: str,
        column: str,
        not_future: bool = True,
        min_date: str | None = None,
        max_date: str | None = None,
        severity: str = ERROR,
        formats: Sequence[str] | None = None,
    ):
        """``formats`` are Java patterns; without them the column's first value shows it."""
        super().__init__(rule_id, title, column, severity)
        self.not_future = not_future
        self.min_date = min_date
        self.max_date = max_date
        self.formats = tuple(formats) if formats else None

    @property
    def message(self):
        return MESSAGES["date"].format(column=self.column)

    def failed(self, cells):
        value = cells.date(self.column, self.formats)
        plausible = value.isNotNull()
        if self.not_future:
            plausible = plausible & (value <= cells.as_of)
        if self.min_date is not None:
            plausible = plausible & (value >= F.lit(self.min_date).cast("date"))
        if self.max_date is not None:
            plausible = plausible & (value <= F.lit(self.max_date).cast("date"))
        return cells.present(self.column) & ~F.coalesce(plausible, F.lit(False))


class Consistency(RowRule):
    """Related columns agree.

    ``violation`` is true for rows that break the rule: SQL text for ``expr``, or a
    callable that gets the table's ``Cells`` and returns a boolean column (a window
    expression is fine).  NULL is not a violation.
    """

    dimension = "consistency"

    def __init__(
        self,
        rule_id: str,
        title: str,
        violation: str | Callable[[Cells], Column],
        columns: Sequence[str],
        severity: str = ERROR,
    ):
        super().__init__(rule_id, title, ", ".join(columns), severity)
        self.violation = violation
        self.columns = list(columns)

    @property
    def message(self):
        return self.title

    def skip_reason(self, columns, tables):
        return _absent(self.columns, columns)

    def sample_columns(self, columns):
        return self.columns

    def checked(self, cells):
        return None

    def failed(self, cells):
        broken = F.expr(self.violation) if isinstance(self.violation, str) \
            else self.violation(cells)
        return F.coalesce(broken, F.lit(False))


class KeyRule(Rule):
    """A rule decided by all rows that share a key.

    ``judge`` sees one row per distinct key with its row count ``_rows`` and the
    rule's own ``marks``; it answers which keys break the rule.
    """

    key_columns: tuple[str, ...]

    def checked(self, cells: Cells) -> Column | None:
        return all_present(cells, self.key_columns)

    def marks(self, cells: Cells) -> dict[str, Column]:
        """Row-level numbers to sum per key, by name."""
        return {}

    def with_parents(
        self, keys: DataFrame, name: str, types: Mapping[str, T.DataType], parents: ParentKeys
    ) -> DataFrame:
        """Add what the rule needs from other tables to the key frame."""
        return keys

    def broken(self, keys: DataFrame, name: str, key_types: Sequence[T.DataType]) -> Column:
        raise NotImplementedError


class Unique(KeyRule):
    """A key occurs once.  Keys with a missing part are left out; no trimming."""

    dimension = "uniqueness"

    def __init__(
        self, rule_id: str, title: str, columns: str | Sequence[str], severity: str = ERROR
    ):
        self.key_columns = (columns,) if isinstance(columns, str) else tuple(columns)
        super().__init__(rule_id, title, ", ".join(self.key_columns), severity)

    @property
    def message(self):
        return MESSAGES["unique"].format(columns=list(self.key_columns))

    def skip_reason(self, columns, tables):
        return _absent(self.key_columns, columns)

    def sample_columns(self, columns):
        return list(self.key_columns)

    def broken(self, keys, name, key_types):
        return (F.col("_rows") > 1) & _key_present(key_types)


class ForeignKey(KeyRule):
    """The value exists in a column of a parent table; compared as text."""

    dimension = "integrity"

    def __init__(
        self,
        rule_id: str,
        title: str,
        column: str,
        parent_table: str,
        parent_column: str,
        severity: str = ERROR,
    ):
        super().__init__(rule_id, title, column, severity)
        self.key_columns = (column,)
        self.parent_table = parent_table
        self.parent_column = parent_column

    @property
    def message(self):
        return MESSAGES["foreign_key"].format(
            column=self.column, table=self.parent_table, parent_column=self.parent_column
        )

    def skip_reason(self, columns, tables):
        reason = super().skip_reason(columns, tables)
        if reason is not None:
            return reason
        if self.parent_table not in tables:
            return SKIP_REASONS["parent_table"].format(table=self.parent_table)
        if self.parent_column not in tables[self.parent_table].columns:
            return SKIP_REASONS["parent_column"].format(
                parent_column=self.parent_column, table=self.parent_table
            )
        return None

    def with_parents(self, keys, name, types, parents):
        known = parents.keys_of(self.parent_table, self.parent_column).select(
            F.col("key").alias(f"_parent_{name}")
        )
        parent_key, child_key = known[f"_parent_{name}"], F.col("_key0")
        if types["_key0"] != known.schema[0].dataType:
            parent_key, child_key = parent_key.cast("string"), child_key.cast("string")
        return keys.join(known, child_key == parent_key, "left")

    def broken(self, keys, name, key_types):
        return _key_present(key_types) & F.col(f"_parent_{name}").isNull()


class ExactlyOne(KeyRule):
    """Exactly one row of every group carries a truth word in ``marker``.

    Rows without a group break the rule.
    """

    dimension = "consistency"

    def __init__(
        self,
        rule_id: str,
        title: str,
        group: str,
        marker: str,
        severity: str = ERROR,
        words: Sequence[str] = TRUE_TOKENS,
    ):
        super().__init__(rule_id, title, f"{group}, {marker}", severity)
        self.key_columns = (group,)
        self.marker = marker
        self.words = tuple(word.lower() for word in words)

    @property
    def message(self):
        return self.title

    def skip_reason(self, columns, tables):
        return _absent((*self.key_columns, self.marker), columns)

    def sample_columns(self, columns):
        return [*self.key_columns, self.marker]

    def checked(self, cells):
        return None

    def marks(self, cells):
        marked = F.lower(cells.text(self.marker)).isin(*self.words)
        return {"marked": F.coalesce(marked, F.lit(False)).cast("bigint")}

    def broken(self, keys, name, key_types):
        return F.col("_key0").isNull() | (F.col(f"_sum_{name}_marked") != 1)


class ParentKeys:
    """The distinct keys of parent columns.

    Keys are distinct so that a repeated parent does not multiply its children.  A
    column that ``shared`` links refer to more than once is materialised on first use.
    """

    def __init__(self, tables: Tables, shared: Iterable[tuple[str, str]] = ()):
        self.tables = tables
        self.shared = set(shared)
        self._keys: dict[tuple[str, str], DataFrame] = {}
        self._lock = threading.Lock()

    def keys_of(self, table: str, column: str) -> DataFrame:
        link = (table, column)
        with self._lock:
            if link not in self._keys:
                parent = self.tables[table]
                key = key_cell(named(column), parent.schema[column].dataType).alias("key")
                keys = parent.select(key).filter(F.col("key").isNotNull()).distinct()
                self._keys[link] = durable(keys) if link in self.shared else keys
            return self._keys[link]


LONG_KEY = 256
DIGEST = "\x01sha256:"  # no cell of a table begins like this


def key_cell(cell: Column, dtype: T.DataType) -> Column:
    """A key as it is compared: whole numbers stay numbers, the rest is text.

    Long texts are compared by their SHA-256, so that no shuffle or broadcast carries
    whole texts.  Long blank cells stay: a blank is no key.
    """
    if isinstance(dtype, T.IntegralType):
        return cell.cast("bigint")
    key = cell.cast("string")
    if not isinstance(dtype, T.StringType):
        return key
    digest = F.concat(F.lit(DIGEST), F.sha2(key, 256))
    return F.when((F.length(key) > LONG_KEY) & text.present(key), digest).otherwise(key)


def key_type(dtype: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(dtype, T.IntegralType) else T.StringType()


def all_present(cells: Cells, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [cells.present(c) for c in columns])


def _key_present(key_types: Sequence[T.DataType]) -> Column:
    return reduce(
        Column.__and__,
        [text.present(F.col(f"_key{i}"), dtype) for i, dtype in enumerate(key_types)],
    )


def _absent(needed: Sequence[str], columns: Sequence[str]) -> str | None:
    missing = [c for c in needed if c not in columns]
    return SKIP_REASONS["columns"].format(columns=missing) if missing else None
