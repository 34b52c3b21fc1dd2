"""Small frames and profiles for tests."""

from pyspark.sql import types as T

from soundrows.operators.evaluation import Evaluation
from soundrows.plans.profile import Profile


def frame(spark, columns, rows):
    """An all-text frame in one partition per row order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def column(spark, values, name="x"):
    return frame(spark, [name], [(v,) for v in values])


def profile(*rules, key="t"):
    return Profile(key, key.title(), "", "", (), tuple(rules))


def evaluate(table, *rules, tables=None, as_of="2024-06-01", **options):
    return Evaluation(table, profile(*rules), tables, as_of, **options)


def outcome(table, rule, tables=None, as_of="2024-06-01"):
    """The result row of one rule, checked to agree on both counting paths."""
    evaluation = evaluate(table, rule, tables=tables, as_of=as_of)
    [row] = evaluation.results().collect()
    return row


def flags(table, rule, tables=None, order=None, **options):
    """Per row, in input order: does it break the rule?"""
    rows = evaluate(table, rule, tables=tables, **options).flagged().collect()
    return [bool(r["failed_rules"]) for r in rows]
