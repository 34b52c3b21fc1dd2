"""Score, grade and rounding expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundrows.fixed_values import GRADES, IMPERFECT_CEILING, LOWEST_GRADE


def percent_passed(checked: Column, failed: Column, nothing_checked: Column) -> Column:
    """``100 * (1 - failed / checked)`` to one decimal.

    A score that rounds to 100 although something failed shows as 99.9.
    """
    raw = F.bround(F.lit(100.0) * (F.lit(1.0) - failed / checked), 1)
    return F.when(checked == 0, nothing_checked).otherwise(imperfect(raw, failed > 0))


def imperfect(score: Column, anything_failed: Column) -> Column:
    return F.when(anything_failed & (score >= 100.0), F.lit(IMPERFECT_CEILING)).otherwise(score)


def grade(score: Column) -> Column:
    cutoff, letter = GRADES[0]
    result = F.when(score >= cutoff, letter)
    for cutoff, letter in GRADES[1:]:
        result = result.when(score >= cutoff, letter)
    return result.otherwise(LOWEST_GRADE)


def share(part: Column, whole: Column, digits: int, when_empty: float, scale: float) -> Column:
    """Rounded ``scale * part / whole``; ``when_empty`` for an empty whole."""
    return F.when(whole == 0, F.lit(when_empty)).otherwise(
        F.bround(F.lit(scale) * part / whole, digits)
    )
