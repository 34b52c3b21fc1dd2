"""Column functions that read text cells: presence, numbers, dates, rounding.

Cells are text; a logical type is parsed on demand and a parse failure is NULL,
never an exception.  Columns that already carry a numeric, date or timestamp type
skip the parsing.  All functions are built-in expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pandas.tseries.api import guess_datetime_format
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundrows.fixed_values import (
    CSV_NA_TOKENS,
    EARLIEST_DATE,
    INFINITY_TOKENS,
    ISO_DATE_PATTERN,
    LATEST_DATE,
    WHITE_SPACE,
)

ISO_DATE = "yyyy-M-d"
#: Tried one after the other where a column does not show its format.
COMMON_DATES = (ISO_DATE, "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "M/d/yyyy", "MMM d, yyyy")
#: Parts of a date as strptime and as Java write them.
DATE_PARTS = {
    "%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%b": "MMM",
    "%B": "MMMM", "%I": "h", "%p": "a", "%z": "XXX", "%y": "yy",
}


def strip(cell: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(cell, F.lit(WHITE_SPACE))


def present(cell: Column, dtype: T.DataType | None = None) -> Column:
    """True when a cell is neither NULL nor blank; never NULL itself."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return cell.isNotNull()
    # ltrim stops at the first visible character, which is cheaper than a regex.
    return cell.isNotNull() & (F.ltrim(cell, F.lit(WHITE_SPACE)) != "")


def as_text(cell: Column, dtype: T.DataType | None = None) -> Column:
    if dtype is None or isinstance(dtype, T.StringType):
        return cell
    return cell.cast("string")


def number(cell: Column, dtype: T.DataType | None = None) -> Column:
    """Parse a decimal number; NULL when the text is not one.

    ``try_cast`` alone is too lenient: it takes Java suffixes (``1d``, ``1f``),
    hexadecimal floats and NaN, and turns ``1e400`` into infinity.
    """
    if isinstance(dtype, T.NumericType):
        value = cell.cast("double")
        return F.when(~F.isnan(value), value)
    text = as_text(cell, dtype)
    value = text.try_cast("double")
    finite = F.abs(value) < F.lit(float("inf"))
    foreign = F.lit(False)
    for letter in "dDfFxX":
        foreign = foreign | text.contains(letter)
    written_infinite = F.lower(strip(text)).isin(*INFINITY_TOKENS)
    # The word test runs only for the rare infinite value (when() is lazy).
    return F.when(finite, F.when(~foreign, value)).when(
        ~F.isnan(value), F.when(written_infinite, value)
    )


def formats_like(first: str | None) -> tuple[str, ...]:
    """The formats of a column whose first value is ``first``.

    A column has one format, that of its first value.  A value that shows none leaves
    every later one to the common formats.
    """
    if first is None or re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", first):
        return (ISO_DATE,)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        shown = guess_datetime_format(first)
    if shown is None:
        return COMMON_DATES
    if shown == "%Y%m%d":
        return ("yyyyMMdd",)
    fraction = re.search(r"[0-9]\.([0-9]+)", first) if "%f" in shown else None
    if fraction:
        # One to as many digits of the second as are usual.
        shown = shown.replace("%S.%f", "%S.#")
    pattern = ""
    for part in re.findall(r"%.|[^%]", shown):
        if part.startswith("%") and part not in DATE_PARTS:
            return COMMON_DATES
        pattern += DATE_PARTS.get(part) or (f"'{part}'" if part.isalpha() else part)
    if fraction:
        return tuple(pattern.replace("#", "S" * n) for n in range(1, 10))
    return (pattern,)


def has_time(formats: Sequence[str]) -> bool:
    return any(letter in re.sub("'[^']*'", "", f) for f in formats for letter in "Hh")


def date(
    cell: Column,
    dtype: T.DataType | None = None,
    formats: Sequence[str] = (ISO_DATE,),
) -> Column:
    """Parse a calendar date in one of ``formats``; NULL when none fits.

    Formats with a time give timestamps.  Date and timestamp columns are returned as they are.  Dates outside the
    nanosecond clock's window are unparseable.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return cell
    if isinstance(dtype, T.DateType):
        value = cell
    else:
        text = as_text(cell, dtype)
        readings = []
        for pattern in formats:
            if pattern == ISO_DATE:
                # The cast has a hand-written ISO parser, several times faster than
                # a formatter; the pattern keeps out what the cast would add.
                readings.append(F.when(text.rlike(ISO_DATE_PATTERN), text.try_cast("date")))
            elif has_time(formats):
                readings.append(F.try_to_timestamp(text, F.lit(pattern)))
            else:
                readings.append(F.try_to_date(text, pattern))
        value = readings[0] if len(readings) == 1 else F.coalesce(*readings)
    earliest = F.lit(EARLIEST_DATE).cast("date")
    latest = F.lit(LATEST_DATE).cast("date")
    return F.when(value.between(earliest, latest), value)


def days_between(later: Column, earlier: Column, timestamps: bool = False) -> Column:
    """Whole days from ``earlier`` to ``later`` (floored, like a time delta's days)."""
    if not timestamps:
        return F.datediff(later, earlier).cast("bigint")
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def without_na_tokens(cell: Column) -> Column:
    """NULL for the words a CSV reader takes for a missing value."""
    return F.when(~cell.isin(*CSV_NA_TOKENS), cell)


def float_text(value: Column) -> Column:
    """Write a double in positional notation where Java would use an exponent.

    Java switches to ``1.0E7`` at ten million; amounts keep plain digits from
    1e-4 up to 1e16.
    """
    shown = value.cast("string")
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    positional = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    return F.when(shown.contains("E") & positional, plain).otherwise(shown)


def nonempty(text: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(text, F.lit(""))


def mapped(key: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """Look a code up in a small fixed table."""
    meanings = F.create_map(*[F.lit(word) for pair in table.items() for word in pair])
    found = F.try_element_at(meanings, key)
    return found if otherwise is None else F.coalesce(found, otherwise)
