"""The whole built-in catalogue over an extract of eight tables made from the given ones.

The extract is stated once, in expressions that Spark and the comparing SQL both read; it
has defects of every kind that a rule looks for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from soundrows.operators.audit import Audit
from soundrows.plans.catalogue import clinical_registry
from soundrows.queries.register import AS_OF, query, table
from soundrows.queries.rule_queries import counted
from soundrows.operators.rules import Consistency, DateValid
from soundrows.session import stored

ORDER_DAY = "CAST(o_orderdate AS DATE)"
SHIP_DAY = "CAST(l_shipdate AS DATE)"


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


def one_of(number: str, *words: str | None) -> str:
    """A word by the remainder of a number; None is NULL."""
    cases = " ".join(
        f"WHEN {n} THEN {'NULL' if word is None else repr(word)}" for n, word in enumerate(words)
    )
    return f"CASE {number} % {len(words)} {cases} END"


EXTRACT = {
    "departments": ("nation", {
        "department_id": text("CASE WHEN n_nationkey = 9 THEN 8 ELSE n_nationkey END"),
        "department_name": "CASE WHEN n_nationkey % 7 = 3 THEN ' ' ELSE n_name END",
        "department_type": one_of("n_nationkey", "Inpatient", "Surgical", "Laboratory", "Emergency"),
        "floor": "CASE WHEN n_nationkey = 4 THEN '2.5' WHEN n_nationkey = 5 THEN 'top' ELSE "
                 + text("n_regionkey") + " END",
    }),
    "providers": ("supplier", {
        "provider_id": "CASE WHEN s_suppkey % 50 = 9 THEN 'x' || " + text("s_suppkey")
                       + " WHEN s_suppkey % 50 = 8 THEN " + text("s_suppkey - 1") + " ELSE " + text("s_suppkey") + " END",
        "first_name": "s_name",
        "last_name": one_of("s_suppkey", "A", "B", None, ""),
        "specialty": one_of("s_suppkey", "Imaging", None, "Surgery"),
        "department_id": "CASE WHEN s_suppkey % 11 = 0 THEN '404' WHEN s_suppkey % 11 = 1 THEN '1.5' ELSE "
                         + text("s_nationkey") + " END",
        "hire_date": one_of("s_suppkey", "2000-05-05", "1949-12-31", "2999-01-01", "soon", "1999-2-3", None),
    }),
    "patients": ("customer", {
        "patient_id": "CASE WHEN c_custkey % 40 = 3 THEN " + text("c_custkey - 1") + " ELSE " + text("c_custkey") + " END",
        "first_name": one_of("c_custkey", "Ann", "Bo", None),
        "last_name": "c_name",
        "gender": one_of("c_custkey", "F", "M", "m", "F"),
        "birth_date": one_of("c_custkey", "1950-01-01", "1899-12-31", "1850-06-06", "2000-12-31", "1980-13-01", None, "2999-09-09"),
        "city": "c_mktsegment",
        "state": one_of("c_nationkey", "MA", "Ma", "NY", "TEX", None),
        "insurance_provider": one_of("c_nationkey", "Plan", None),
        "registration_date": one_of("c_custkey", "1999-01-01", "1989-12-31", "2000-06-06", None),
    }),
    "encounters": ("orders", {
        "encounter_id": "CASE WHEN o_orderkey % 100 = 7 THEN " + text("o_orderkey - 1") + " ELSE " + text("o_orderkey") + " END",
        "patient_id": "CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE " + text("o_custkey") + " END",
        "provider_id": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE " + text("o_orderkey % 50") + " END",
        "department_id": text("o_custkey % 30"),
        "admit_date": text(ORDER_DAY),
        "discharge_date": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 17 = 1 THEN 'later' ELSE "
                          + text(f"{ORDER_DAY} + CAST(o_orderkey % 500 - 20 AS INT)") + " END",
        "admission_type": one_of("o_custkey", "Emergency", "Elective", "urgent", "Newborn", ""),
        "discharge_disposition": one_of("o_custkey", "Home", "Expired", "Gone", None),
    }),
    "diagnoses": ("events", {
        "diagnosis_id": text("event_id"),
        "encounter_id": "CASE WHEN event_id % 19 = 0 THEN 'none' ELSE " + text("user_id * 3") + " END",
        "icd10_code": one_of("event_id", "E11.9", "e11.9", "S72", "U07.1", None, "A1", "Z99.12345"),
        "diagnosis_description": "event_type",
        "is_primary": one_of("event_id", "True", "false", "0", "maybe", "NO", "1", "f"),
    }),
    "procedures": ("lineitem", {
        "procedure_id": text("l_orderkey * 8 + l_linenumber"),
        "encounter_id": text("l_orderkey"),
        "procedure_name": "CASE l_linestatus WHEN 'O' THEN 'Scan' END",
        "procedure_date": "CASE l_returnflag WHEN 'R' THEN NULL ELSE " + text(SHIP_DAY) + " END",
    }),
    "prescriptions": ("lineitem", {
        "prescription_id": text("l_orderkey * 8 + l_linenumber"),
        "encounter_id": text("l_orderkey * 2"),
        "medication_name": "l_linestatus",
        "route": one_of("l_partkey", "Oral", "oral", "IV", "By hand", None, "Topical"),
    }),
    "billing": ("orders", {
        "encounter_id": "CASE WHEN o_orderkey % 60 = 5 THEN " + text("o_orderkey + 1") + " ELSE " + text("o_orderkey") + " END",
        "total_charge": "CASE WHEN o_orderkey % 10 = 1 THEN '-5' WHEN o_orderkey % 10 = 2 THEN 'free' ELSE "
                        + text("o_orderkey % 1000") + " END",
        "insurance_paid": text("o_custkey % 600"),
        "patient_paid": "CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE " + text("o_custkey % 400 - 10") + " END",
        "payment_status": one_of("o_orderkey", "Paid", "Pending", "paid", "Written Off", "Partially Paid"),
    }),
}


def extract(spark, folder):
    """The eight tables, stored as an extract would be."""
    return {
        name: stored(
            table(spark, folder, source).selectExpr(*[f"{value} AS {column}" for column, value in columns.items()]),
            f"extract-{name}",
        )
        for name, (source, columns) in EXTRACT.items()
    }


def _present(column):
    return f"coalesce(trim({column}), '') <> ''"


def _missing(columns):
    return [(f"not_null.{c}", "true", f"NOT ({_present(c)})") for c in columns]


def _key(column):
    return [
        ("unique.id", _present(column),
         f"{_present(column)} AND {column} IN (SELECT {column} FROM {{t}} GROUP BY 1 HAVING count(*) > 1)"),
        ("int.id", _present(column), f"{_present(column)} AND NOT regexp_full_match({column}, '-?[0-9]+')"),
    ]


def _integer(rule, column):
    return [(rule, _present(column), f"{_present(column)} AND NOT regexp_full_match({column}, '-?[0-9]+')")]


def _words(rule, column, *words):
    return [(rule, _present(column), f"{_present(column)} AND {column} NOT IN {words}")]


def _day(column):
    """An ISO day inside the clock's window, else NULL."""
    return (f"CASE WHEN regexp_full_match({column}, '[0-9]{{{{4}}}}-[0-9]{{{{1,2}}}}-[0-9]{{{{1,2}}}}') AND "
            f"try_cast({column} AS DATE) BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' THEN try_cast({column} AS DATE) END")


def _date(rule, column, least="0001-01-01"):
    return [(rule, _present(column),
             f"{_present(column)} AND NOT coalesce({_day(column)} BETWEEN DATE '{least}' AND DATE '{AS_OF}', false)")]


def _link(rule, column, parent, parent_column):
    return [(rule, _present(column),
             f"{_present(column)} AND {column} NOT IN (SELECT {parent_column} FROM {parent} WHERE {parent_column} IS NOT NULL)")]


def _amount(column):
    return f"try_cast({column} AS DOUBLE)"


def _not_negative(rule, column):
    return [(rule, _present(column), f"{_present(column)} AND NOT coalesce({_amount(column)} >= 0, false)")]


TO_ENCOUNTER = _link("fk.encounter", "encounter_id", "encounters", "encounter_id")
RULES = {
    "departments": [*_key("department_id"), *_integer("int.floor", "floor"),
                    *_words("enum.type", "department_type", "Inpatient", "Outpatient", "Emergency", "Surgical", "Diagnostic")],
    "providers": [*_key("provider_id"), *_integer("int.dept", "department_id"),
                  *_date("date.hire", "hire_date", "1950-01-01"),
                  *_link("fk.dept", "department_id", "departments", "department_id")],
    "patients": [*_key("patient_id"), *_words("enum.gender", "gender", "M", "F"),
                 ("regex.state", _present("state"), f"{_present('state')} AND NOT regexp_full_match(state, '[A-Z][A-Z]')"),
                 *_date("date.birth", "birth_date", "1900-01-01"),
                 *_date("date.registration", "registration_date", "1990-01-01"),
                 ("consistency.birth_before_registration", "true", f"{_day('birth_date')} > {_day('registration_date')}"),
                 ("consistency.plausible_age", "true", f"date_diff('day', {_day('birth_date')}, DATE '{AS_OF}') > 43830")],
    "encounters": [*_key("encounter_id"), *_date("date.admit", "admit_date"), *_date("date.discharge", "discharge_date"),
                   *_words("enum.admission", "admission_type", "Emergency", "Elective", "Urgent", "Newborn"),
                   *_words("enum.disposition", "discharge_disposition", "Home", "Home Health Care", "Skilled Nursing Facility",
                           "Rehabilitation", "Transferred", "Left Against Medical Advice", "Expired"),
                   ("consistency.discharge_after_admit", "true", f"{_day('discharge_date')} < {_day('admit_date')}"),
                   ("consistency.los_plausible", "true", f"date_diff('day', {_day('admit_date')}, {_day('discharge_date')}) > 365"),
                   *_link("fk.patient", "patient_id", "patients", "patient_id"),
                   *_link("fk.provider", "provider_id", "providers", "provider_id"),
                   *_link("fk.dept", "department_id", "departments", "department_id")],
    "diagnoses": [*_key("diagnosis_id"),
                  ("regex.icd10", _present("icd10_code"), f"{_present('icd10_code')} AND NOT regexp_full_match(icd10_code, "
                   "'[A-TV-Z][0-9][0-9A-Z](\\.[0-9A-Z]{{1,4}})?')"),
                  ("bool.primary", _present("is_primary"), "lower(is_primary) NOT IN ('true', 'false', '1', '0', 't', 'f', 'yes', 'no')"),
                  *TO_ENCOUNTER,
                  ("consistency.one_primary", "true",
                   "encounter_id NOT IN (SELECT encounter_id FROM diagnoses GROUP BY 1 "
                   "HAVING count(*) FILTER (WHERE lower(is_primary) IN ('true', '1', 't', 'yes')) = 1)")],
    "procedures": [*_key("procedure_id"), *_date("date.performed", "procedure_date"), *TO_ENCOUNTER],
    "prescriptions": [*_key("prescription_id"),
                      *_words("enum.route", "route", "Oral", "Injection", "Inhalation", "IV", "IM", "Topical", "Subcutaneous"),
                      *TO_ENCOUNTER],
    "billing": [_key("encounter_id")[0], *_not_negative("num.total", "total_charge"),
                *_not_negative("num.insurance", "insurance_paid"), *_not_negative("num.patient", "patient_paid"),
                *_words("enum.status", "payment_status", "Paid", "Partially Paid", "Pending", "Written Off"),
                ("consistency.not_overpaid", "true",
                 f"{_amount('insurance_paid')} + {_amount('patient_paid')} > {_amount('total_charge')} + 0.01::DOUBLE"),
                *TO_ENCOUNTER],
}

TABLES_SQL = ", ".join(
    f"{name} AS (SELECT {', '.join(f'{value} AS {column}' for column, value in columns.items())} FROM {source})"
    for name, (source, columns) in EXTRACT.items()
)
RULES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, '{name}.{rule}' AS rule_id, "
    f"CAST(count(*) FILTER (WHERE {checked.format(t=name)}) AS BIGINT) AS checked, "
    f"CAST(count(*) FILTER (WHERE {failed.format(t=name)}) AS BIGINT) AS failed FROM {name}"
    for name, rules in RULES.items()
    for rule, checked, failed in (*_missing(EXTRACT[name][1]), *rules)
)


@query("clinical_audit", f"WITH {TABLES_SQL} {RULES_SQL}")
def clinical_audit(spark, folder):
    """All 94 rules of the catalogue, every link resolved."""
    results = Audit(extract(spark, folder), clinical_registry(), AS_OF).results()
    return results.select("dataset", "rule_id", "checked", "failed")


# -- dates in other formats ------------------------------------------------------------
def _date_rules_sql(failed: str) -> str:
    return f"""
        SELECT 'day' AS rule_id, CAST(count(*) AS BIGINT) AS checked,
               CAST(count(*) FILTER (WHERE {failed} OR {ORDER_DAY} > DATE '1998-06-01') AS BIGINT) AS failed FROM orders
        UNION ALL
        SELECT 'order', count(*), count(*) FILTER (
            WHERE NOT ({failed}) AND o_orderkey % 5 = 2) FROM orders"""


def _dated(spark, folder, pattern, odd):
    """Orders with two dates as text; the odd ones are in another format."""
    later = F.expr(f"{ORDER_DAY} + CAST(CASE WHEN o_orderkey % 5 = 2 THEN -1 ELSE 1 END AS INT)")
    rows = table(spark, folder, "orders").select(
        F.when(F.expr(odd), "1999 in May").otherwise(F.date_format("o_orderdate", pattern)).alias("ordered"),
        F.date_format(later, pattern).alias("shipped"),
    )
    found = counted(
        stored(rows, "dates"),
        DateValid("day", "ordered is a plausible day", "ordered", max_date="1998-06-01"),
        Consistency("order", "shipped on or after the order", lambda c: c.date("shipped") < c.date("ordered"), ["ordered", "shipped"]),
    )
    return found.select("rule_id", "checked", "failed")


@query("rule_dates_with_times", _date_rules_sql("o_orderkey % 7 = 3"))
def rule_dates_with_times(spark, folder):
    return _dated(spark, folder, "yyyy-MM-dd HH:mm:ss", "o_orderkey % 7 = 3")


@query("rule_dates_with_slashes", _date_rules_sql("o_orderkey % 7 = 4"))
def rule_dates_with_slashes(spark, folder):
    return _dated(spark, folder, "MM/dd/yyyy", "o_orderkey % 7 = 4")
