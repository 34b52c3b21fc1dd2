"""One query per rule type, over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.operators.evaluation import Evaluation
from soundrows.operators.rules import (
    AllowedValues,
    BooleanType,
    Consistency,
    DateValid,
    ExactlyOne,
    ForeignKey,
    IntegerType,
    NotNull,
    NumericRange,
    Regex,
    Rule,
    Unique,
)
from soundrows.plans.profile import Profile
from soundrows.queries.register import AS_OF, query, table


def counted(rows: DataFrame, *rules: Rule, tables=None) -> DataFrame:
    """Result rows of ad-hoc rules over one frame."""
    profile = Profile("adhoc", "Ad hoc", "", "", (), rules)
    results = Evaluation(rows, profile, tables, AS_OF).results()
    return results.select("rule_id", "category", "status", "checked", "failed", "pass_rate")


def expected(rule_id: str, category: str, checked: str, failed: str, source: str) -> str:
    """SQL for one result row from two boolean SQL expressions over ``source``."""
    return f"""
        SELECT '{rule_id}' AS rule_id, '{category}' AS category,
               CASE WHEN failed = 0 THEN 'passed' ELSE 'failed' END AS status,
               checked, failed,
               round_even(1.0 - CASE WHEN checked = 0 THEN 0.0::DOUBLE
                                ELSE failed::DOUBLE / checked END, 4) AS pass_rate
        FROM (SELECT CAST(count(*) FILTER (WHERE {checked}) AS BIGINT) AS checked,
                     CAST(count(*) FILTER (WHERE {failed}) AS BIGINT) AS failed
              FROM {source})"""


def together(*parts: str) -> str:
    return " UNION ALL ".join(parts)


# -- completeness ------------------------------------------------------------------
@query("rule_not_null", expected(
    "status", "completeness", "true", "l_linestatus = 'F'", "lineitem"))
def rule_not_null(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.nullif("l_linestatus", F.lit("F")).alias("status")
    )
    return counted(rows, NotNull("status", "status is required", "status"))


@query("rule_not_null_blank", expected(
    "role", "completeness", "true", "role = 'assistant'", "conversations"))
def rule_not_null_blank(spark, folder):
    rows = table(spark, folder, "conversations").select(
        F.when(F.col("role") == "assistant", F.lit(" \t　")).otherwise(F.col("role"))
        .alias("role")
    )
    return counted(rows, NotNull("role", "role is required", "role"))


# -- uniqueness --------------------------------------------------------------------
@query("rule_unique", together(
    expected("event", "uniqueness", "event_id IS NOT NULL", "n > 1",
             "(SELECT event_id, count(*) OVER (PARTITION BY event_id) AS n FROM events)"),
    expected("text", "uniqueness", "trim(text) <> ''", "n > 1 AND trim(text) <> ''",
             "(SELECT text, count(*) OVER (PARTITION BY text) AS n FROM documents)")))
def rule_unique(spark, folder):
    events = counted(
        table(spark, folder, "events"), Unique("event", "event_id must be unique", "event_id")
    )
    texts = counted(
        table(spark, folder, "documents"), Unique("text", "text must be unique", "text")
    )
    return events.unionByName(texts)


@query("rule_unique_composite", expected(
    "line", "uniqueness", "true", "n > 1",
    "(SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)"))
def rule_unique_composite(spark, folder):
    return counted(
        table(spark, folder, "lineitem"),
        Unique("line", "order line must be unique", ["l_orderkey", "l_linenumber"]),
    )


# -- validity ----------------------------------------------------------------------
@query("rule_allowed_values", expected(
    "status", "validity", "true", "o_orderstatus NOT IN ('O', 'F')", "orders"))
def rule_allowed_values(spark, folder):
    return counted(
        table(spark, folder, "orders"),
        AllowedValues("status", "status is known", "o_orderstatus", ["O", "F"]),
    )


@query("rule_allowed_values_ci", expected(
    "type", "validity", "true", "lower(event_type) NOT IN ('click', 'view', 'purchase')",
    "events"))
def rule_allowed_values_ci(spark, folder):
    rows = table(spark, folder, "events").select(F.upper("event_type").alias("event_type"))
    return counted(
        rows,
        AllowedValues("type", "type is known", "event_type", ["Click", "view", "purchase"],
                      case_sensitive=False),
    )


@query("rule_regex", together(
    expected("brand", "validity", "true",
             "NOT regexp_full_match(p_brand, 'Brand#[0-9]')", "part"),
    expected("start", "validity", "true", "p_name NOT LIKE 'red%'", "part")))
def rule_regex(spark, folder):
    return counted(
        table(spark, folder, "part"),
        Regex("brand", "brand is known", "p_brand", "^Brand#[0-9]$"),
        Regex("start", "a match is anchored at the start only", "p_name", "red"),
    )


@query("rule_integer", expected(
    "price", "validity", "true",
    "TRY_CAST(price AS DOUBLE) IS NULL OR TRY_CAST(price AS DOUBLE) <> "
    "round(TRY_CAST(price AS DOUBLE))",
    "(SELECT CAST(p_retailprice AS VARCHAR) AS price FROM part)"))
def rule_integer(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_retailprice").cast("string").alias("p"))
    return counted(rows, IntegerType("price", "price is whole", "p"))


@query("rule_numeric_range", together(
    expected("balance", "validity", "true", "c_acctbal < 0 OR c_acctbal > 9000", "customer"),
    expected("segment", "validity", "true", "true", "customer")))
def rule_numeric_range(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment"
    )
    return counted(
        rows,
        NumericRange("balance", "balance is in range", "c_acctbal", 0, 9000),
        NumericRange("segment", "words are not numbers", "c_mktsegment"),
    )


@query("rule_boolean", expected(
    "status", "validity", "true", "lower(o_orderstatus) <> 'f'", "orders"))
def rule_boolean(spark, folder):
    return counted(
        table(spark, folder, "orders"),
        BooleanType("status", "status is a truth word", "o_orderstatus"),
    )


@query("rule_date_window", together(
    expected("text", "validity", "true",
             "o_orderdate < DATE '1995-06-01' OR o_orderdate > DATE '2001-01-01'", "orders"),
    expected("typed", "validity", "true",
             "o_orderdate < DATE '1995-06-01' OR o_orderdate > DATE '2000-01-01'", "orders")))
def rule_date_window(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderdate"
    )
    return counted(
        rows,
        DateValid("text", "day is plausible", "day", min_date="1995-06-01"),
        DateValid("typed", "day is plausible", "o_orderdate", not_future=False,
                  min_date="1995-06-01", max_date="2000-01-01"),
    )


# -- consistency -------------------------------------------------------------------
JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def lines_with_orders(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("rule_consistency_order", expected(
    "order", "consistency", "true", "l_shipdate < o_orderdate", JOINED))
def rule_consistency_order(spark, folder):
    return counted(
        lines_with_orders(spark, folder),
        Consistency("order", "shipped on or after the order",
                    lambda c: c.date("shipped") < c.date("ordered"), ["shipped", "ordered"]),
    )


@query("rule_consistency_los", expected(
    "delay", "consistency", "true",
    "date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 365", JOINED))
def rule_consistency_los(spark, folder):
    return counted(
        lines_with_orders(spark, folder),
        Consistency("delay", "shipped within a year",
                    lambda c: c.days_between("shipped", "ordered") > 365,
                    ["shipped", "ordered"]),
    )


@query("rule_consistency_amount", expected(
    "charge", "consistency", "true",
    "l_extendedprice * (1.0 - l_discount) + l_extendedprice * l_tax "
    "> l_extendedprice + 0.01::DOUBLE", "lineitem"))
def rule_consistency_amount(spark, folder):
    return counted(
        table(spark, folder, "lineitem"),
        Consistency(
            "charge", "charge must not exceed the list price",
            "l_extendedprice * (1.0D - l_discount) + l_extendedprice * l_tax "
            "> l_extendedprice + 0.01D",
            ["l_extendedprice", "l_discount", "l_tax"],
        ),
    )


@query("rule_one_primary", together(
    expected("opening", "consistency", "true", "n <> 1",
             "(SELECT sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) "
             "OVER (PARTITION BY conv_id) AS n FROM conversations)"),
    expected("orphans", "consistency", "true", "role = 'user' OR n <> 1",
             "(SELECT role, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER "
             "(PARTITION BY conv_id, role = 'user') AS n FROM conversations)")))
def rule_one_primary(spark, folder):
    rows = table(spark, folder, "conversations").select(
        "conv_id", "role",
        F.when(F.col("role") != "user", F.col("conv_id")).alias("answered"),
    )
    return counted(
        rows,
        ExactlyOne("opening", "one system turn", "conv_id", "role", words=["system"]),
        ExactlyOne("orphans", "rows without a group fail", "answered", "role",
                   words=["SYSTEM"]),
    )


# -- integrity ---------------------------------------------------------------------
@query("rule_foreign_key", together(
    expected("labelled", "integrity", "true", "doc_id NOT IN (SELECT doc_id FROM labels)",
             "documents"),
    expected("user", "integrity", "true", "user_id NOT IN (SELECT s_suppkey FROM supplier)",
             "events"),
    expected("order", "integrity", "true",
             "l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
             "lineitem")))
def rule_foreign_key(spark, folder):
    load = lambda name: table(spark, folder, name)
    finished = load("orders").filter("o_orderstatus <> 'P'")
    labelled = counted(
        load("documents"),
        ForeignKey("labelled", "document is labelled", "doc_id", "labels", "doc_id"),
        tables={"labels": load("labels")},
    )
    users = counted(
        load("events"),
        ForeignKey("user", "user is a supplier", "user_id", "supplier", "s_suppkey"),
        tables={"supplier": load("supplier")},
    )
    lines = counted(
        load("lineitem"),
        ForeignKey("order", "order is not pending", "l_orderkey", "orders", "o_orderkey"),
        tables={"orders": finished},
    )
    return labelled.unionByName(users).unionByName(lines)


# -- skipped -----------------------------------------------------------------------
@query("rule_skipped", """
    SELECT * FROM (VALUES
        ('clerk', 'completeness'), ('key', 'uniqueness'),
        ('parent', 'integrity'), ('column', 'integrity')) AS t(rule_id, category),
    (SELECT 'skipped' AS status, CAST(0 AS BIGINT) AS checked, CAST(0 AS BIGINT) AS failed,
            CAST(1.0 AS DOUBLE) AS pass_rate)
    UNION ALL
    SELECT 'present', 'completeness', 'passed', count(*), 0, 1.0 FROM orders""")
def rule_skipped(spark, folder):
    orders = table(spark, folder, "orders")
    return counted(
        orders,
        NotNull("clerk", "clerk is required", "o_clerk"),
        Unique("key", "key must be unique", ["o_orderkey", "o_clerk"]),
        ForeignKey("parent", "customer exists", "o_custkey", "customer", "c_custkey"),
        ForeignKey("column", "nation exists", "o_custkey", "nation", "n_custkey"),
        NotNull("present", "priority is required", "o_orderpriority"),
        tables={"nation": table(spark, folder, "nation")},
    )
