"""Typed views of a table's columns, shared by all rules of a profile."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundrows.functions import text as parse


def named(column: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


class Cells:
    """Hands out presence, number and date views and parses each of them once.

    A view is a helper column.  ``with_views`` adds all requested views in one
    projection; rules then refer to them by name, so two rules on one column share
    the parse.
    """

    def __init__(
        self,
        schema: T.StructType,
        as_of: Column,
        date_formats: Mapping[str, tuple[str, ...]] | None = None,
    ):
        self.types = {field.name: field.dataType for field in schema.fields}
        self.as_of = as_of
        self.date_formats = dict(date_formats or {})
        self.dated: list[str] = []  # text columns that were read as dates
        self._views: dict[tuple, tuple[Column, Column]] = {}

    def _view(self, kind: str, column: str, parser: Callable, *options) -> Column:
        """The column that holds a view; its expression is built on first use only."""
        wanted = (kind, column, *options)
        if wanted not in self._views:
            name = f"_view{len(self._views)}"
            expression = parser(self.raw(column), self.types[column], *options)
            self._views[wanted] = (expression.alias(name), F.col(name))
        return self._views[wanted][1]

    def raw(self, column: str) -> Column:
        return named(column)

    def text(self, column: str) -> Column:
        return parse.as_text(self.raw(column), self.types[column])

    def present(self, column: str) -> Column:
        return self._view("present", column, parse.present)

    def number(self, column: str) -> Column:
        return self._view("number", column, parse.number)

    def date(self, column: str, formats: tuple[str, ...] | None = None) -> Column:
        """The date in a cell: in the given formats, or in the column's own."""
        if formats is None and isinstance(self.types[column], T.StringType):
            self.dated.append(column)
        return self._view("date", column, parse.date, formats or self._formats(column))

    def _formats(self, column: str) -> tuple[str, ...]:
        return self.date_formats.get(column, (parse.ISO_DATE,))

    def _stamped(self, column: str) -> bool:
        """Does the column have times of day?"""
        kind = self.types[column]
        if isinstance(kind, T.StringType):
            return parse.has_time(self._formats(column))
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType))

    def days_between(self, later: str, earlier: str) -> Column:
        stamped = self._stamped(later) or self._stamped(earlier)
        return parse.days_between(self.date(later), self.date(earlier), stamped)

    def days_until_as_of(self, column: str) -> Column:
        return parse.days_between(self.as_of, self.date(column), self._stamped(column))

    def with_views(self, rows: DataFrame) -> DataFrame:
        if not self._views:
            return rows
        return rows.select("*", *[expression for expression, _ in self._views.values()])


def as_of_column(as_of: dt.date | str | Column | None) -> Column:
    """The reference day of date rules: a fixed day, or the day of the run."""
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")
