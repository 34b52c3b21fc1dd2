"""One rule at a time, on inline frames."""

import pytest
from helpers import column, evaluate, flags, frame, outcome

from soundrows.operators.keyed import Limits
from soundrows.operators.rules import (
    AllowedValues, BooleanType, Consistency, DateValid, ExactlyOne, ForeignKey,
    IntegerType, NotNull, NumericRange, Regex, Unique,
)

ICD10 = r"^[A-TV-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"


@pytest.mark.parametrize(
    "values, rule, checked, failed",
    [
        (["a", "", None, "b"], NotNull("r", "t", "x"), 4, 2),
        (["\t", " ", "　", "\u001c", "​"], NotNull("r", "t", "x"), 5, 4),
        (["1", "2", "2", "3", "3"], Unique("r", "t", "x"), 5, 4),
        (["1", "", "", "2"], Unique("r", "t", "x"), 2, 0),
        (["1", " 1", "1", "1 "], Unique("r", "t", "x"), 4, 2),
        (["M", "F", "X", None, "m"], AllowedValues("r", "t", "x", ["M", "F"]), 4, 2),
        (["Oral", "oral", "ORAL", "iv"],
         AllowedValues("r", "t", "x", ["oral"], case_sensitive=False), 4, 1),
        (["E11.9", "S72.0", "12345", "ABC", ""], Regex("r", "t", "x", ICD10), 4, 2),
        (["MA", "MA\n", "MA\r", "MAX"], Regex("r", "t", "x", "^[A-Z]{2}$"), 4, 2),
        (["é1", "٣", "-"], Regex("r", "t", "x", r"\w+"), 3, 1),
        (["ab1", "1ab"], Regex("r", "t", "x", "[a-z]+"), 2, 1),
        (["a", "b1", "xb"], Regex("r", "t", "x", "a|b"), 3, 1),
        (["1", "2", "3.5", "abc", None], IntegerType("r", "t", "x"), 4, 2),
        (["1.0", "1e3", " 5 ", "+3", "inf", "-Infinity"], IntegerType("r", "t", "x"), 6, 0),
        (["nan", "1_000", "0x10", "True", "1,000", "1e400", "1d", "1f"],
         IntegerType("r", "t", "x"), 8, 8),
        (["10", "-5", "0", "N/A"], NumericRange("r", "t", "x", min_value=0), 4, 2),
        (["1", "5", "9", "10", "-inf"], NumericRange("r", "t", "x", 2, 9), 5, 3),
        (["True", "f", "YES", "0", "maybe", " 1"], BooleanType("r", "t", "x"), 6, 2),
        (["2020-01-01", "2023-13-40", "2999-01-01", None], DateValid("r", "t", "x"), 3, 2),
        (["2020-1-5", "2020-01-01 10:00:00", "20200101", " 2020-01-01 ", "2020-02-30", "2020"],
         DateValid("r", "t", "x"), 6, 5),
        (["2020-01-01", "1999-01-01", "2021-01-01"],
         DateValid("r", "t", "x", min_date="2000-01-01", max_date="2020-12-31"), 3, 2),
        (["31/12/2020", "2020-12-31"],
         DateValid("r", "t", "x", formats=("dd/MM/yyyy",)), 2, 1),
    ],
)
def test_counts(spark, values, rule, checked, failed):
    row = outcome(column(spark, values), rule)
    assert (row["checked"], row["failed"]) == (checked, failed)
    assert row["status"] == ("failed" if failed else "passed")


def test_consistency_sql_text_and_callable(spark):
    table = frame(spark, ["a", "b"], [("2020-01-02", "2020-01-01"), ("2020-01-01", "2020-01-02"),
                                      (None, "2020-01-01"), ("x", "2020-01-01")])
    by_call = Consistency("r", "t", lambda c: c.date("a") > c.date("b"), ["a", "b"])
    by_text = Consistency("r", "t", "a > b and a like '2%'", ["a", "b"])
    for rule in (by_call, by_text):
        row = outcome(table, rule)
        assert (row["checked"], row["failed"]) == (4, 1)


def test_far_dates_do_not_trip_differences(spark):
    table = frame(spark, ["a", "b"], [("2999-01-01", "2020-01-01"), ("2022-01-01", "2020-01-01")])
    rule = Consistency("r", "t", lambda c: c.days_between("a", "b") > 365, ["a", "b"])
    assert outcome(table, rule)["failed"] == 1


def test_foreign_key(spark):
    child = column(spark, ["1", "2", "999", None, " "], "k")
    parent = frame(spark, ["id"], [("1",), ("2",), ("2",), ("3",), (None,)])
    rule = ForeignKey("r", "t", "k", "p", "id")
    row = outcome(child, rule, {"p": parent})
    assert (row["checked"], row["failed"]) == (3, 1)
    assert flags(child, rule, {"p": parent}) == [False, False, True, False, False]


def test_foreign_key_skips(spark):
    child = column(spark, ["1"], "k")
    rule = ForeignKey("r", "t", "k", "p", "id")
    row = outcome(child, rule)
    assert row["status"] == "skipped" and "not provided" in row["skip_reason"]
    row = outcome(child, rule, {"p": column(spark, ["1"], "other")})
    assert row["skip_reason"] == "'id' missing from 'p'"


def test_typed_and_text_keys_compare_as_text(spark):
    child = column(spark, ["1", "01", "3"], "k")
    parent = spark.range(3)
    assert outcome(child, ForeignKey("r", "t", "k", "p", "id"), {"p": parent})["failed"] == 2
    assert outcome(parent, ForeignKey("r", "t", "id", "p", "k"), {"p": child})["failed"] == 2


def test_absent_column_is_skipped(spark):
    row = outcome(column(spark, ["a"]), NotNull("r", "t", "y"))
    assert (row["status"], row["checked"], row["pass_rate"]) == ("skipped", 0, 1.0)
    assert row["skip_reason"] == "column 'y' not present in dataset"
    row = outcome(column(spark, ["a"]), Unique("r", "t", ["x", "y"]))
    assert row["message"] == "Skipped: column(s) ['y'] not present"


ENCOUNTERS = ["a", "a", "b", None, "c", "c", None, ""]
PRIMARY = ["T", "F", "no", "True", "t", "YES", None, "1"]


def test_exactly_one(spark):
    table = frame(spark, ["enc", "prim"], zip(ENCOUNTERS, PRIMARY))
    rule = ExactlyOne("r", "t", "enc", "prim")
    row = outcome(table, rule)
    assert (row["checked"], row["failed"]) == (8, 5)
    assert flags(table, rule) == [False, False, True, True, True, True, True, False]


def test_composite_unique(spark):
    table = frame(spark, ["a", "b"], [("1", "x"), ("1", "x"), ("1", "y"), (None, "x"), (None, "x")])
    rule = Unique("r", "t", ["a", "b"])
    row = outcome(table, rule)
    assert (row["checked"], row["failed"]) == (3, 2)
    assert row["message"] == "Key ['a', 'b'] must be unique; duplicate values found."
    assert flags(table, rule) == [True, True, False, False, False]


def test_messages(spark):
    table = column(spark, ["1"])
    rules = [
        NotNull("a", "t", "x"),
        AllowedValues("b", "t", "x", ["z", "y"]),
        NumericRange("c", "t", "x", 0, 10),
        NumericRange("d", "t", "x"),
        Regex("e", "t", "x", "a", hint="an a"),
    ]
    messages = [r["message"] for r in evaluate(table, *rules).results()
                .orderBy("rule_index").collect()]
    assert messages == [
        "'x' must not be blank or missing.",
        "'x' must be one of: y, z.",
        "'x' must be >= 0 and <= 10.",
        "'x' must be numeric.",
        "'x' is malformed. Expected an a.",
    ]


# Few, hot and many broken keys must all give the same flags.
TINY = Limits(broadcast_bytes=0, hot_rows=5, hot_keys=2, salts=7)


def test_hot_keys_take_the_spread_path(spark):
    keys = ["hot"] * 50 + [None] * 30 + ["warm"] * 4 + [f"k{i}" for i in range(40)]
    table = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "k string, i string")
    parent = column(spark, [f"k{i}" for i in range(0, 40, 2)] + ["hot"], "id")
    rules = [Unique("u", "t", "k"), ForeignKey("f", "t", "k", "p", "id")]
    plain = evaluate(table, *rules, tables={"p": parent})
    spread = evaluate(table, *rules, tables={"p": parent}, limits=TINY)
    as_set = lambda e: {(r["i"], tuple(r["failed_rules"])) for r in e.flagged().collect()}
    assert as_set(plain) == as_set(spread)
    summary = spread.summary().first()
    assert summary["row_count"] == len(keys)
    assert summary["errors"] == 54 + 4 + 20
    assert summary["rows_with_errors"] == 54 + 20
    assert plain.summary().first() == summary


@pytest.mark.parametrize("values, bad", [
    (["2020-01-01 10:00:00", "2020-01-02", "2020-1-3 1:2:3", "2999-01-01 00:00:00", None], [1, 3]),
    (["01/02/2020", "1/2/2020", "13/02/2020", "2020-01-01"], [2, 3]),
    (["25/12/2020", "01/02/2020", "12/25/2020"], [2]),
    (["2020-01-01T10:00:00Z", "2020-01-01T10:00:00+02:00", "2020-01-01"], [2]),
    (["2020-01-01 10:00:00.5", "2020-01-01 10:00:00.123456", "2020-01-01 10:00:00"], [2]),
    (["Jan 5, 2020", "Feb 30, 2020", "Dec 31, 2019"], [1]),
    (["20200101", "2020-01-02", "20201301"], [1, 2]),
    (["never", "2020-01-02", "01/02/2020", "Jan 5, 2020"], [0]),
    (["  ", "2020-01-02", "01/02/2020"], [2]),
])
def test_dates_follow_the_first_value(spark, values, bad):
    table = column(spark, values).coalesce(1)
    failed = flags(table, DateValid("d", "d", "x"))
    assert [i for i, f in enumerate(failed) if f] == bad


def test_consistency_reads_times(spark):
    table = frame(spark, ["a", "b"], [
        ("2020-01-01 10:00:00", "2020-01-01 09:00:00"), ("2020-01-01 10:00:00", "2020-01-02 09:59:59"),
        ("2020-01-01 10:00:00", "2020-01-02 10:00:00"), ("x", "2020-01-02 10:00:00"),
    ]).coalesce(1)
    later = Consistency("c", "c", lambda c: c.date("b") < c.date("a"), ["a", "b"])
    whole = Consistency("c", "c", lambda c: c.days_between("b", "a") >= 1, ["a", "b"])
    assert flags(table, later) == [True, False, False, False]
    assert flags(table, whole) == [False, False, True, False]


def test_long_texts_are_keys_by_digest(spark):
    long = "x" * 300
    table = column(spark, [long + "a", long + "b", long + "a", " " * 300, " " * 300, "short"])
    assert flags(table, Unique("u", "u", "x")) == [True, False, True, False, False, False]
    evaluation = evaluate(table, Unique("u", "u", "x"))
    keys = evaluation.judged_keys(evaluation.key_sets[0]).collect()
    assert len(keys) == 4 and max(len(r[0]) for r in keys if r[0].strip()) < 100
    parent = column(spark, [long + "a", "short"], "y")
    link = ForeignKey("f", "f", "x", "p", "y")
    assert flags(table, link, {"p": parent}) == [False, True, False, False, False, False]


def test_python_patterns(spark):
    table = column(spark, ["ab-ab", "ab-ac", "AB", "x"])
    rule = Regex("r", "r", "x", r"(?P<two_letters>[a-z]{2})-(?P=two_letters)\Z")
    assert flags(table, rule) == [False, True, True, True]
    for pattern, what in ((r"(a)?(?(1)b|c)", "conditional"), ("(", "unterminated"), (r"[z-a]", "bad character range")):
        with pytest.raises(ValueError, match=what):
            Regex("r", "r", "x", pattern)
    assert flags(table, Regex("r", "r", "x", r"\\(?P<a>x)")) == [True] * 4
