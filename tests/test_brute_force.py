"""All rule types at once on random rows, against a plain Python reading of the rules."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from helpers import evaluate, frame

from soundrows.operators.keyed import Limits
from soundrows.operators.report import Report
from soundrows.operators.rules import (
    AllowedValues, BooleanType, Consistency, DateValid, ExactlyOne, ForeignKey, IntegerType,
    NotNull, NumericRange, Regex, Unique,
)

POOL = [None, "", " ", "\t", " ", "1", "2", " 2", "3.0", "4.5", "-7", "1e3", "1e400", "nan",
        "inf", "0x1", "7d", "abc", "T", "yes", "NO", "M", "m", "2020-01-05", "2020-1-5",
        "2020-02-30", "2031-01-01", "1899-12-31", "MA", "MAX", "E11.9"]
PARENT = ["1", "2", "abc", "M", None]
AS_OF = dt.date(2024, 6, 1)
NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")


def present(v):
    return v is not None and v.strip() != ""


def number(v):
    if v is None:
        return None
    if v.strip().lower().lstrip("+-") in ("inf", "infinity"):
        return float(v)
    if not NUMBER.fullmatch(v) or abs(float(v)) == float("inf"):
        return None
    return float(v)


def date(v):
    match = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", v or "")
    try:
        return dt.date(*map(int, match.groups())) if match else None
    except ValueError:
        return None


def expected(rows):
    """Rule id -> set of row numbers that break the rule."""
    broken = {}

    def rule(name, test):
        broken[name] = {i for i, r in enumerate(rows) if test(r)}

    rule("null", lambda r: not present(r["a"]))
    rule("enum", lambda r: present(r["a"]) and r["a"] not in ("M", "1"))
    rule("enum_ci", lambda r: present(r["a"]) and r["a"].lower() not in ("m", "yes"))
    rule("regex", lambda r: present(r["a"]) and not re.match("^[A-Z]{2}", r["a"]))
    rule("int", lambda r: present(r["a"]) and not (
        number(r["a"]) is not None and (abs(number(r["a"])) == float("inf")
                                        or number(r["a"]) == round(number(r["a"])))))
    rule("range", lambda r: present(r["a"]) and not (
        number(r["a"]) is not None and -5 <= number(r["a"]) <= 1000))
    rule("bool", lambda r: present(r["a"]) and r["a"].lower() not in (
        "true", "false", "1", "0", "t", "f", "yes", "no"))
    rule("date", lambda r: present(r["a"]) and not (
        date(r["a"]) and dt.date(1900, 1, 1) <= date(r["a"]) <= AS_OF))
    rule("order", lambda r: bool(date(r["a"]) and date(r["b"]) and date(r["a"]) > date(r["b"])))
    copies = Counter(r["b"] for r in rows if present(r["b"]))
    rule("unique", lambda r: copies[r["b"]] > 1)
    pairs = Counter((r["b"], r["c"]) for r in rows if present(r["b"]) and present(r["c"]))
    rule("pair", lambda r: pairs[(r["b"], r["c"])] > 1)
    rule("link", lambda r: present(r["b"]) and r["b"] not in PARENT)
    marks = Counter(r["c"] for r in rows if (r["a"] or "").lower() in ("true", "1", "t", "yes"))
    rule("one", lambda r: r["c"] is None or marks[r["c"]] != 1)
    return broken


RULES = [
    NotNull("null", "t", "a"), AllowedValues("enum", "t", "a", ["M", "1"]),
    AllowedValues("enum_ci", "t", "a", ["M", "Yes"], "warning", case_sensitive=False),
    Regex("regex", "t", "a", "^[A-Z]{2}"), IntegerType("int", "t", "a"),
    NumericRange("range", "t", "a", -5, 1000), BooleanType("bool", "t", "a", "warning"),
    DateValid("date", "t", "a", min_date="1900-01-01"),
    Consistency("order", "t", lambda c: c.date("a") > c.date("b"), ["a", "b"]),
    Unique("unique", "t", "b"), Unique("pair", "t", ["b", "c"], "warning"),
    ForeignKey("link", "t", "b", "p", "k"), ExactlyOne("one", "t", "c", "a", "warning"),
]


@pytest.mark.parametrize("limits", [
    Limits(), Limits(broadcast_bytes=0, hot_rows=10, hot_keys=3, salts=5)])
def test_random_rows(spark, limits):
    rng = random.Random(7)
    keys = [f"k{i}" for i in range(120)] + POOL
    rows = [
        {"id": str(i), "a": rng.choice(POOL),
         "b": "hot" if rng.random() < 0.3 else rng.choice(keys),
         "c": None if rng.random() < 0.3 else rng.choice(keys)}
        for i in range(400)
    ]
    table = frame(spark, ["id", "a", "b", "c"], [tuple(r.values()) for r in rows])
    parent = frame(spark, ["k"], [(v,) for v in PARENT])
    evaluation = evaluate(table, *RULES, tables={"p": parent}, as_of=AS_OF, limits=limits)
    broken = expected(rows)

    flagged = {r["id"]: set(r["failed_rules"]) for r in evaluation.flagged().collect()}
    assert flagged == {
        str(i): {name for name, at in broken.items() if i in at} for i in range(len(rows))}

    report = Report(evaluation)
    assert {r["rule_id"]: r["failed"] for r in report.results} == {
        name: len(at) for name, at in broken.items()}
    lazy = {r["rule_id"]: r["failed"] for r in evaluate(
        table, *RULES, tables={"p": parent}, as_of=AS_OF).results().collect()}
    assert lazy == {name: len(at) for name, at in broken.items()}
    errors = {r.rule_id for r in RULES if r.severity == "error"}
    assert report.rows_with_errors == len(set().union(*(broken[n] for n in errors)))
    for row in report.results:
        first = sorted(broken[row["rule_id"]])[:8]
        assert [s["_line"] for s in row["sample"]] == [i + 2 for i in first]
