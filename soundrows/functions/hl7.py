"""Column functions over HL7 v2 segments: fields, components, dates, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundrows.fixed_values import WHITE_SPACE
from soundrows.functions.text import nonempty, strip


def fields_of(segment: Column) -> Column:
    return F.split(segment, "[|]")


def field(fields: Column, number: int) -> Column:
    """A field by number; the segment name is number 0; empty when out of range."""
    return F.coalesce(F.get(fields, F.lit(number)), F.lit(""))


def code(fields: Column, number: int) -> Column:
    """A coded field without surrounding white space."""
    return strip(field(fields, number))


def component(fields: Column, number: int, place: int) -> Column:
    """A component by 0-based place; NULL when empty or absent."""
    return nonempty(F.get(F.split(field(fields, number), r"\^"), F.lit(place)))


def day(fields: Column, number: int) -> Column:
    """The day of a timestamp that starts with eight digits, as YYYY-MM-DD."""
    digits = F.regexp_extract(field(fields, number), f"^[{WHITE_SPACE}]*([0-9]{{8}})", 1)
    return nonempty(F.regexp_replace(digits, "^(....)(..)(..)$", "$1-$2-$3"))
