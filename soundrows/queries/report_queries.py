"""Reports, audits, samples, gates and detection over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundrows.operators.audit import Audit
from soundrows.operators.evaluation import Evaluation
from soundrows.operators.gate import split
from soundrows.operators.report import (
    failed_findings,
    findings_by_status,
    report_document,
    sorted_findings,
)
from soundrows.plans.profile import Registry, profile_from
from soundrows.queries.commerce import commerce_registry
from soundrows.queries.register import AS_OF, query, table
from soundrows.session import scratch_path
from soundrows.sources.csv import read_csv
from soundrows.sources.history import History
from soundrows.sources.tables import load_parquet_tables

COUNTS = ("dataset", "rule_index", "rule_id", "category", "severity", "status", "checked",
          "failed", "pass_rate")


def tables_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return load_parquet_tables(spark, folder, [p.key for p in commerce_registry()])


def evaluation_of(spark: SparkSession, folder: str, key: str) -> Evaluation:
    tables = tables_of(spark, folder)
    return Evaluation(tables[key], commerce_registry().get(key), tables, AS_OF)


def audit_of(spark: SparkSession, folder: str) -> Audit:
    return Audit(tables_of(spark, folder), commerce_registry(), AS_OF)


# -- the expected counts, written by hand per rule --------------------------------
E, W = "error", "warning"


def _required(*columns):
    return [(f"not_null.{c}", "completeness", E, f"{c} IS NULL") for c in columns]


def _in(column, parent, key):
    return f"{column} NOT IN (SELECT {key} FROM {parent})"


def _keyed(name, key):
    return f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS copies FROM {name})"


COPIED = "copies > 1"
EXPECTED = {
    "region": (_keyed("region", "r_regionkey"), [
        *_required("r_regionkey", "r_name"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.id", "validity", E, "false"),
        ("enum.name", "validity", W, "r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"),
    ]),
    "nation": (_keyed("nation", "n_nationkey"), [
        *_required("n_nationkey", "n_name", "n_regionkey"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.id", "validity", E, "false"),
        ("fk.region", "integrity", E, _in("n_regionkey", "region", "r_regionkey")),
    ]),
    "customer": (_keyed("customer", "c_custkey"), [
        *_required("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.id", "validity", E, "false"),
        ("num.balance", "validity", E, "c_acctbal < 0 OR c_acctbal > 9000"),
        ("enum.segment", "validity", W, "c_mktsegment = 'MACHINERY'"),
        ("regex.name", "validity", E,
         "NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[0-4]')"),
        ("fk.nation", "integrity", E, _in("c_nationkey", "nation", "n_nationkey")),
    ]),
    "supplier": (_keyed("supplier", "s_suppkey"), [
        *_required("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.id", "validity", E, "false"),
        ("num.balance", "validity", E, "s_acctbal < 0"),
        ("fk.nation", "integrity", E, _in("s_nationkey", "nation", "n_nationkey")),
    ]),
    "part": (_keyed("part", "p_partkey"), [
        *_required("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.id", "validity", E, "false"),
        ("regex.brand", "validity", W, "NOT regexp_full_match(p_brand, 'Brand#[0-9]')"),
        ("int.price", "validity", W, "p_retailprice <> round(p_retailprice)"),
        ("num.size", "validity", E, "p_size > 48"),
    ]),
    "orders": (_keyed("orders", "o_orderkey"), [
        *_required("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                   "o_orderpriority"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.id", "validity", E, "false"),
        ("enum.status", "validity", E, "o_orderstatus NOT IN ('O', 'F')"),
        ("bool.status", "validity", W, "o_orderstatus <> 'F'"),
        ("num.total", "validity", E, "o_totalprice < 1000"),
        ("date.order", "validity", E,
         "o_orderdate < DATE '1995-06-01' OR o_orderdate > DATE '2001-01-01'"),
        ("fk.customer", "integrity", E, _in("o_custkey", "customer", "c_custkey")),
        ("not_null.clerk", "completeness", E, None),
    ]),
    "lineitem": (_keyed("lineitem", "l_orderkey, l_linenumber"), [
        *_required("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                   "l_extendedprice", "l_shipdate"),
        ("unique.id", "uniqueness", E, COPIED),
        ("int.quantity", "validity", E, "l_quantity <> round(l_quantity)"),
        ("num.quantity", "validity", W, "l_quantity > 45"),
        ("date.ship", "validity", W, "l_shipdate > DATE '2001-01-01'"),
        ("enum.flag", "validity", W, "l_returnflag NOT IN ('A', 'N')"),
        ("consistency.charge", "consistency", W,
         "l_extendedprice * (1.0 - l_discount) + l_extendedprice * l_tax "
         "> l_extendedprice + 0.01::DOUBLE"),
        ("fk.order", "integrity", E, _in("l_orderkey", "orders", "o_orderkey")),
        ("fk.part", "integrity", E, _in("l_partkey", "part", "p_partkey")),
        ("fk.supplier", "integrity", E, _in("l_suppkey", "supplier", "s_suppkey")),
    ]),
}


def rules_sql(*datasets: str) -> str:
    """``rules`` (one row per rule) and ``rows_of`` (one row per table)."""
    rules, rows = [], []
    for n, key in enumerate(EXPECTED):
        if key not in datasets:
            continue
        source, listed = EXPECTED[key]
        for index, (name, category, severity, failed) in enumerate(listed):
            checked = "0" if failed is None else "count(*)"
            rules.append(
                f"SELECT '{key}' AS dataset, {n} AS place, {index} AS rule_index, "
                f"'{key}.{name}' AS rule_id, '{category}' AS category, "
                f"'{severity}' AS severity, {failed is None} AS skipped, "
                f"CAST({checked} AS BIGINT) AS checked, "
                f"CAST(count(*) FILTER (WHERE {failed or 'false'}) AS BIGINT) AS failed "
                f"FROM {source}"
            )
        errors = " OR ".join(f"({f})" for _, _, s, f in listed if s == E and f)
        rows.append(
            f"SELECT '{key}' AS dataset, {n} AS place, "
            f"CAST(count(*) AS BIGINT) AS row_count, "
            f"CAST(count(*) FILTER (WHERE {errors}) AS BIGINT) AS rows_with_errors "
            f"FROM {source}"
        )
    return (
        f"rules AS ({' UNION ALL '.join(rules)}), rows_of AS ({' UNION ALL '.join(rows)})"
    )


STATUS_SQL = ("CASE WHEN skipped THEN 'skipped' WHEN failed = 0 THEN 'passed' "
              "ELSE 'failed' END")
RESULTS_SQL = f"""
    SELECT dataset, rule_index, rule_id, category, severity, {STATUS_SQL} AS status,
           checked, failed,
           round_even(1.0::DOUBLE - CASE WHEN checked = 0 THEN 0.0::DOUBLE
                      ELSE failed::DOUBLE / checked END, 4) AS pass_rate
    FROM rules"""


def _score_sql(checked: str, failed: str, empty: str) -> str:
    raw = f"round_even(100.0::DOUBLE * (1.0::DOUBLE - ({failed}) / ({checked})), 1)"
    return (f"CASE WHEN ({checked}) = 0 THEN {empty} WHEN ({failed}) > 0 AND {raw} >= 100.0 "
            f"THEN 99.9::DOUBLE ELSE {raw} END")


DIMENSIONS_SQL = f"""
    SELECT dataset, category, rules, checked, failed,
           {_score_sql('checked::DOUBLE', 'failed::DOUBLE', 'CAST(NULL AS DOUBLE)')} AS score
    FROM (SELECT d.dataset, c.category,
                 CAST(count(r.rule_id) AS BIGINT) AS rules,
                 CAST(coalesce(sum(r.checked), 0) AS BIGINT) AS checked,
                 CAST(coalesce(sum(r.failed), 0) AS BIGINT) AS failed
          FROM rows_of d
          CROSS JOIN (VALUES ('completeness'), ('validity'), ('uniqueness'), ('consistency'),
                             ('integrity')) AS c(category)
          LEFT JOIN rules r ON r.dataset = d.dataset AND r.category = c.category
                           AND NOT r.skipped
          GROUP BY ALL)"""

SUMMARY_SQL = f"""
    SELECT dataset, row_count, score,
           CASE WHEN score >= 97 THEN 'A+' WHEN score >= 93 THEN 'A' WHEN score >= 90 THEN 'A-'
                WHEN score >= 85 THEN 'B' WHEN score >= 75 THEN 'C' WHEN score >= 60 THEN 'D'
                ELSE 'F' END AS grade,
           errors + warnings AS total_issues, errors, warnings, rules_total, rules_run,
           rules_passed, rules_failed, rules_skipped, rows_with_errors,
           row_count - rows_with_errors AS clean_rows,
           round_even(100.0::DOUBLE * (row_count - rows_with_errors) / row_count, 1)
               AS clean_row_pct
    FROM (SELECT *, {_score_sql("ec + 0.4::DOUBLE * wc", "errors + 0.4::DOUBLE * warnings",
                                "100.0")} AS score
          FROM (SELECT r.dataset, max(d.row_count) AS row_count,
                       max(d.rows_with_errors) AS rows_with_errors,
                       CAST(coalesce(sum(failed) FILTER (WHERE severity = 'error'), 0)
                            AS BIGINT) AS errors,
                       CAST(coalesce(sum(failed) FILTER (WHERE severity = 'warning'), 0)
                            AS BIGINT) AS warnings,
                       CAST(coalesce(sum(checked) FILTER (WHERE severity = 'error'), 0)
                            AS BIGINT) AS ec,
                       CAST(coalesce(sum(checked) FILTER (WHERE severity = 'warning'), 0)
                            AS BIGINT) AS wc,
                       CAST(count(*) AS BIGINT) AS rules_total,
                       CAST(count(*) FILTER (WHERE NOT skipped) AS BIGINT) AS rules_run,
                       CAST(count(*) FILTER (WHERE NOT skipped AND failed = 0) AS BIGINT)
                           AS rules_passed,
                       CAST(count(*) FILTER (WHERE NOT skipped AND failed > 0) AS BIGINT)
                           AS rules_failed,
                       CAST(count(*) FILTER (WHERE skipped) AS BIGINT) AS rules_skipped
                FROM rules r JOIN rows_of d ON r.dataset = d.dataset
                GROUP BY r.dataset))"""

ALL = tuple(EXPECTED)


# -- one table ---------------------------------------------------------------------
@query("report_results", f"WITH {rules_sql('orders')} {RESULTS_SQL}")
def report_results(spark, folder):
    return evaluation_of(spark, folder, "orders").results().select(*COUNTS)


@query("report_dimensions", f"WITH {rules_sql('lineitem')} {DIMENSIONS_SQL}")
def report_dimensions(spark, folder):
    return evaluation_of(spark, folder, "lineitem").dimensions().drop("dimension_index")


@query("report_summary", f"WITH {rules_sql('lineitem')} {SUMMARY_SQL}")
def report_summary(spark, folder):
    return evaluation_of(spark, folder, "lineitem").summary()


@query("report_document", f"""
    WITH {rules_sql('customer')}, s AS ({SUMMARY_SQL}), r AS ({RESULTS_SQL})
    SELECT s.dataset, s.row_count, s.score, s.grade, s.rows_with_errors,
           r.rule_id, r.checked, r.failed FROM s JOIN r ON s.dataset = r.dataset""")
def report_document_query(spark, folder):
    """The nested document, written as JSON text and read back."""
    document = report_document(evaluation_of(spark, folder, "customer"))
    path = scratch_path(spark, "report")
    document.write.json(path)
    back = spark.read.schema(document.schema).json(path)
    return back.select(
        "dataset", "row_count", "summary.score", "summary.grade", "summary.rows_with_errors",
        F.explode("results").alias("r"),
    ).select("dataset", "row_count", "score", "grade", "rows_with_errors",
             "r.rule_id", "r.checked", "r.failed")


# -- all tables --------------------------------------------------------------------
@query("audit_results", f"WITH {rules_sql(*ALL)} {RESULTS_SQL}")
def audit_results(spark, folder):
    return audit_of(spark, folder).results().select(*COUNTS)


@query("audit_dimensions", f"WITH {rules_sql(*ALL)} {DIMENSIONS_SQL}")
def audit_dimensions(spark, folder):
    return audit_of(spark, folder).dimensions().drop("dimension_index")


@query("audit_tables", f"WITH {rules_sql(*ALL)} {SUMMARY_SQL}")
def audit_tables(spark, folder):
    return audit_of(spark, folder).summaries()


@query("audit_all", f"""
    WITH {rules_sql(*ALL)}, s AS ({SUMMARY_SQL})
    SELECT CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings,
           CAST(sum(total_issues) AS BIGINT) AS total_issues,
           CAST(sum(row_count) AS BIGINT) AS rows,
           CAST(sum(rows_with_errors) AS BIGINT) AS rows_with_errors,
           CAST(count(*) AS BIGINT) AS tables, round_even(avg(score), 1) AS score FROM s""")
def audit_all(spark, folder):
    return audit_of(spark, folder).aggregate()


# -- findings ----------------------------------------------------------------------
@query("findings_sorted", f"WITH {rules_sql(*ALL)} {RESULTS_SQL}")
def findings_sorted(spark, folder):
    return sorted_findings(audit_of(spark, folder).results()).select(*COUNTS)


@query("findings_failed", f"""
    WITH {rules_sql(*ALL)}, r AS ({RESULTS_SQL}) SELECT * FROM r WHERE status = 'failed'""")
def findings_failed(spark, folder):
    return failed_findings(audit_of(spark, folder).results()).select(*COUNTS)


@query("findings_by_status", f"""
    WITH {rules_sql(*ALL)}
    SELECT {STATUS_SQL} AS status, CAST(count(*) AS BIGINT) AS findings
    FROM rules GROUP BY 1""")
def findings_counted(spark, folder):
    return findings_by_status(audit_of(spark, folder).results())


# -- rows --------------------------------------------------------------------------
def _hits_sql(key: str, shown: str, order: str) -> str:
    source, listed = EXPECTED[key]
    return " UNION ALL ".join(
        f"SELECT '{key}.{name}' AS rule_id, {order} AS place, {shown} FROM {source} "
        f"WHERE {failed}"
        for name, _, _, failed in listed if failed
    )


@query("sample_rows", f"""
    WITH hits AS ({_hits_sql('customer', 'c_custkey, c_acctbal', 'c_custkey')}),
    top AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY place) AS rank FROM hits)
    SELECT rule_id, CAST(rank AS INTEGER) AS rank,
           CASE WHEN rule_id = 'customer.num.balance' THEN c_acctbal END AS balance
    FROM top WHERE rank <= 8""")
def sample_rows(spark, folder):
    """The first offending customers per rule, in key order."""
    samples = evaluation_of(spark, folder, "customer").samples(order_by=["c_custkey"])
    return samples.select(
        "rule_id", "rank", F.col("row")["c_acctbal"].cast("double").alias("balance")
    )


@query("sample_lines", f"""
    WITH orders AS (SELECT *, row_number() OVER () + 1 AS line FROM orders),
    hits AS ({_hits_sql('orders', 'line', 'line')}),
    top AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY place) AS rank FROM hits)
    SELECT rule_id, CAST(rank AS INTEGER) AS rank, CAST(line AS BIGINT) AS _line
    FROM top WHERE rank <= 8""")
def sample_lines(spark, folder):
    """The first offending orders per rule, in file order with line numbers."""
    return evaluation_of(spark, folder, "orders").samples().select("rule_id", "rank", "_line")


def _failed_rules_sql(key: str) -> str:
    names = ", ".join(
        f"CASE WHEN {failed} THEN '{key}.{name}' END"
        for name, _, _, failed in EXPECTED[key][1] if failed
    )
    return f"concat_ws(',', {names})"


@query("flagged_rows", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, {_failed_rules_sql('lineitem')} AS failed_rules
    FROM {EXPECTED['lineitem'][0]}""")
def flagged_rows(spark, folder):
    """Every line item with the rules it breaks."""
    rows = evaluation_of(spark, folder, "lineitem").flagged()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey",
                       F.concat_ws(",", "failed_rules").alias("failed_rules"))


CUSTOMER_ERRORS = " OR ".join(
    f"({f})" for _, _, s, f in EXPECTED["customer"][1] if s == E and f)


@query("quarantine_split", f"""
    SELECT CASE WHEN {CUSTOMER_ERRORS} THEN 'quarantined' ELSE 'accepted' END AS side,
           c_nationkey, CAST(count(*) AS BIGINT) AS customers
    FROM {EXPECTED['customer'][0]} GROUP BY ALL""")
def quarantine_split(spark, folder):
    accepted, quarantined = split(evaluation_of(spark, folder, "customer"))
    sides = accepted.select(F.lit("accepted").alias("side"), "c_nationkey").unionByName(
        quarantined.select(F.lit("quarantined").alias("side"), "c_nationkey")
    )
    return sides.groupBy("side", "c_nationkey").agg(F.count(F.lit(1)).alias("customers"))


@query("quarantined_rows", f"""
    SELECT o_orderkey, {_failed_rules_sql('orders')} AS failed_rules
    FROM {EXPECTED['orders'][0]}
    WHERE {" OR ".join(f"({f})" for _, _, s, f in EXPECTED['orders'][1] if s == E and f)}""")
def quarantined_rows(spark, folder):
    _, quarantined = split(evaluation_of(spark, folder, "orders"))
    return quarantined.select(
        "o_orderkey", F.concat_ws(",", "failed_rules").alias("failed_rules")
    )


# -- text tables -------------------------------------------------------------------
@query("csv_results", f"WITH {rules_sql('customer')} {RESULTS_SQL}")
def csv_results(spark, folder):
    """The same report when the table arrives as a CSV file, all cells text."""
    customers = table(spark, folder, "customer").withColumn(
        "c_acctbal", F.col("c_acctbal").cast("string")
    )
    path = scratch_path(spark, "csv")
    customers.write.option("header", True).csv(path)
    tables = {**tables_of(spark, folder), "customer": read_csv(spark, path)}
    profile = commerce_registry().get("customer")
    return Evaluation(tables["customer"], profile, tables, AS_OF).results().select(*COUNTS)


@query("csv_missing_words", """
    SELECT CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'P')
                AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS cells FROM orders""")
def csv_missing_words(spark, folder):
    """Missing-value words and blanks of a CSV file are missing; others are not."""
    word = F.when(F.col("o_orderpriority") == "5-LOW", "N/A").when(
        F.col("o_orderstatus") == "P", " "
    ).otherwise("-")
    path = scratch_path(spark, "csv")
    table(spark, folder, "orders").select("o_orderkey", word.alias(" word ")).write.option(
        "header", True
    ).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    profile = profile_from("words", dict(
        id_column="o_orderkey", detect=["o_orderkey", "word"], required=["word"]))
    [rows] = [Evaluation(read_csv(spark, path), profile).results()]
    return rows.select(F.col("failed").alias("missing"), F.col("checked").alias("cells"))


# -- history -----------------------------------------------------------------------
@query("history_append", f"""
    WITH {rules_sql(*ALL)}, s AS ({SUMMARY_SQL})
    SELECT dataset, 'audit' AS source, CAST(NULL AS VARCHAR) AS variant, row_count, score,
           grade, errors, warnings, rules_failed,
           CAST(now() AT TIME ZONE 'UTC' AS DATE) AS created_day FROM s""")
def history_append(spark, folder):
    """Audit summaries appended to a history and read back."""
    history = History(spark, scratch_path(spark, "history"), enabled=True)
    history.append(audit_of(spark, folder).summaries(), "audit")
    day = F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("created_at").cast("timestamp_ntz")))
    return history.recent().withColumn("created_day", day).drop("id", "created_at")


# -- detection ---------------------------------------------------------------------
VISITS = Registry(
    profile_from(key, dict(id_column="", detect=detect))
    for key, detect in {
        "buyer": ["view", "purchase"],
        "newcomer": ["signup", "view"],
        "browser": ["view"],
        "troubled": ["error"],
    }.items()
)


@query("detect_dataset", """
    WITH lists AS (
        SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS visit,
               count(DISTINCT event_type)::DOUBLE AS n,
               bool_or(event_type = 'view') AS v, bool_or(event_type = 'purchase') AS p,
               bool_or(event_type = 'signup') AS s, bool_or(event_type = 'error') AS e
        FROM events GROUP BY 1)
    SELECT visit,
           CASE WHEN v AND p THEN 'buyer' WHEN s AND v THEN 'newcomer'
                WHEN v THEN 'browser' WHEN e THEN 'troubled' END AS dataset,
           CASE WHEN v AND (p OR s) THEN 2.0 / n WHEN v OR e THEN 1.0 / n ELSE 0.0 END
               AS match_score
    FROM lists""")
def detect_dataset(spark, folder):
    """Which profile fits the column list of every table; here a user's day is a table."""
    listing = table(spark, folder, "events").select(
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("visit"),
        "event_type",
    )
    return VISITS.detect_many(listing, "visit", "event_type")
