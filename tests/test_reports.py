"""Reports, samples, detection, audits, gates."""

import pytest
from pyspark.sql import functions as F
from helpers import column, evaluate, frame, profile

from soundrows.checks import Checker
from soundrows.errors import CheckError, GateFailed
from soundrows.operators.audit import Audit, aggregate_of
from soundrows.operators.evaluation import Evaluation, dimensions_of, results_of
from soundrows.operators.gate import gate, split
from soundrows.operators.report import (
    Report, failed_findings, findings, letter_grade, report_document, sorted_findings,
)
from soundrows.operators.rules import (
    AllowedValues, Consistency, ForeignKey, IntegerType, NotNull, RowRule, Unique,
)
from soundrows.plans.catalogue import clinical_registry
from soundrows.plans.profile import Registry, profile_from

PATIENTS = ["patient_id", "first_name", "last_name", "gender", "birth_date", "city", "state",
            "insurance_provider", "registration_date"]


def patients(spark, n=3, **changes):
    row = dict(zip(PATIENTS, ["", "A", "B", "F", "1980-01-01", "C", "MA", "I", "2020-01-01"]))
    rows = [{**row, "patient_id": str(i + 1)} for i in range(n)]
    for position, values in changes.items():
        rows[int(position.removeprefix("row"))].update(values)
    return frame(spark, PATIENTS, [tuple(r[c] for c in PATIENTS) for r in rows])


def test_catalogue_counts():
    registry = clinical_registry()
    assert {p.key: len(p.rules) for p in registry} == {
        "departments": 8, "providers": 11, "patients": 17, "encounters": 19,
        "diagnoses": 11, "procedures": 8, "prescriptions": 8, "billing": 12,
    }
    ids = [r.rule_id for p in registry for r in p.rules]
    assert len(ids) == len(set(ids)) == 94


def test_catalogue_frames(spark):
    registry = clinical_registry()
    assert registry.catalogue(spark).count() == 94
    listed = {r["dataset"]: r["rule_count"] for r in registry.profile_list(spark).collect()}
    assert listed["billing"] == 12
    assert registry.describe()[2]["rules"][0] == {
        "rule_id": "patients.not_null.patient_id", "title": "patient_id is required",
        "category": "completeness", "severity": "error", "column": "patient_id",
    }


def test_detection():
    registry = clinical_registry()
    assert registry.detect(PATIENTS).key == "patients"
    assert registry.detect(["foo", "bar", "baz"]) is None
    billing = ["encounter_id", "total_charge", "insurance_paid", "patient_paid", "payment_status"]
    assert registry.detect(billing).match_score(billing) == 1.0
    with pytest.raises(CheckError, match="no profile 'x'; profiles are: departments"):
        registry.resolve(PATIENTS, "x")
    with pytest.raises(CheckError, match="No profile fits"):
        registry.resolve(["foo"], None)


def test_profile_as_data(spark):
    registry = clinical_registry()
    registry.register(profile_from("labs", dict(
        id_column="lab_id", detect=["lab_id", "value"], required=["lab_id"],
        rules=[("number", "num.value", "value must be >= 0", dict(column="value", min_value=0))],
    )))
    table = frame(spark, ["lab_id", "value"], [("1", "-1"), (None, "2")])
    result = Checker(spark, registry).check_table(table)
    assert result["dataset"] == "labs" and result["auto_detected"]
    assert result["summary"]["errors"] == 2 and result["summary"]["rows_with_errors"] == 2


@pytest.mark.parametrize("score, letter", [
    (100, "A+"), (97, "A+"), (96.9, "A"), (93, "A"), (92.9, "A-"), (90, "A-"), (85, "B"),
    (75, "C"), (60, "D"), (59.9, "F")])
def test_grades(score, letter):
    assert letter_grade(score) == letter


def test_clean_and_dirty_patients(spark):
    registry = clinical_registry()
    clean = Report(Evaluation(patients(spark), registry.get("patients"), as_of="2024-06-01"))
    assert clean.summary()["score"] == 100.0 and clean.summary()["errors"] == 0
    assert clean.summary()["rules_run"] == 17
    dirty = Report(Evaluation(
        patients(spark, 4, row0=dict(gender="X", state="Mass"),
                 row1=dict(birth_date="2021-01-01"), row2=dict(birth_date="1900-01-02"),
                 row3=dict(patient_id="1", city=" ")),
        registry.get("patients"), as_of="2024-06-01"))
    failed = {r["rule_id"].removeprefix("patients."): r["failed"]
              for r in dirty.results if r["failed"]}
    assert failed == {
        "enum.gender": 1, "regex.state": 1, "consistency.birth_before_registration": 1,
        "consistency.plausible_age": 1, "unique.id": 2, "not_null.city": 1,
    }
    summary = dirty.summary()
    assert (summary["errors"], summary["warnings"]) == (5, 2)
    assert summary["rows_with_errors"] == 3 and summary["clean_row_pct"] == 25.0


def test_imperfect_tables_never_show_a_hundred(spark):
    ids = [str(i) for i in range(999)] + ["5"]
    evaluation = evaluate(
        column(spark, ids), NotNull("n", "t", "x"), Unique("u", "t", "x"),
        *[IntegerType(f"i{k}", "t", "x") for k in range(6)],
    )
    report = Report(evaluation)
    assert report.score < 100
    assert evaluation.summary().first()["score"] == report.score


def test_frames_agree_with_the_collected_report(spark):
    table = frame(spark, ["k", "v"], [("1", "a"), ("1", "b"), (None, "x"), ("9", None)])
    evaluation = evaluate(
        table, NotNull("n", "t", "v"), Unique("u", "t", "k"),
        ForeignKey("f", "t", "k", "p", "k", "warning"),
        AllowedValues("a", "t", "v", ["a", "b"], "warning"),
        Consistency("c", "t", "k = v", ["k", "v"]), NotNull("s", "t", "absent"),
        tables={"p": column(spark, ["1"], "k")},
    )
    report = Report(evaluation)
    summary = evaluation.summary().first().asDict()
    assert {k: summary[k] for k in report.summary()} == report.summary()
    measures = evaluation.measures()
    by_rule = {r["rule_id"]: r for r in results_of(measures).collect()}
    for row in report.results:
        assert by_rule[row["rule_id"]]["failed"] == row["failed"]
        assert by_rule[row["rule_id"]]["pass_rate"] == row["pass_rate"]
        assert by_rule[row["rule_id"]]["status"] == row["status"]
    listed = {r["category"]: r for r in dimensions_of(measures).collect()}
    assert len(listed) == 5
    for name, figures in report.dimensions().items():
        assert {k: listed[name][k] for k in figures} == figures
    [document] = report_document(evaluation).collect()
    assert document["summary"]["errors"] == report.summary()["errors"]
    assert [r["rule_id"] for r in document["results"]] == ["n", "u", "f", "a", "c", "s"]
    assert report.to_dict()["columns"] == ["k", "v"]


def test_empty_table(spark):
    evaluation = evaluate(column(spark, []), NotNull("n", "t", "x"), Unique("u", "t", "x"))
    summary = evaluation.summary().first()
    assert (summary["score"], summary["grade"], summary["clean_row_pct"]) == (100.0, "A+", 100.0)
    assert Report(evaluation).summary()["clean_row_pct"] == 100.0


def test_samples_keep_row_order_and_lines(spark):
    values = ["a" if i % 3 else None for i in range(200)]
    table = frame(spark, list("abcdefgh"), [(v,) + tuple("1234567") for v in values])
    [found] = [r for r in Report(evaluate(table, NotNull("n", "t", "a"))).results]
    assert [s["_line"] for s in found["sample"]] == [2 + 3 * i for i in range(8)]
    assert list(found["sample"][0]) == ["_line", "a", "b", "c", "d", "e", "f"]
    keyed = evaluate(column(spark, ["5", "9", "5", "x"], "k"), Unique("u", "t", "k"),
                     IntegerType("i", "t", "k"))
    rows = {(r["rule_id"], r["rank"], r["_line"]) for r in keyed.samples().collect()}
    assert rows == {("u", 1, 2), ("u", 2, 4), ("i", 1, 5)}
    ordered = keyed.samples(order_by=["k"]).filter("rule_id = 'i'").first()
    assert ordered["_line"] is None and ordered["row"] == {"k": "x"}


def test_findings(spark):
    table = column(spark, ["1", "x", None])
    evaluation = evaluate(
        table, AllowedValues("w", "t", "x", [], "warning"), NotNull("n", "t", "x"),
        IntegerType("i", "t", "x"), NotNull("s", "t", "y"), Unique("u", "t", "x"),
    )
    results = evaluation.results()
    assert [r["rule_id"] for r in sorted_findings(results).collect()] == ["n", "i", "w", "u", "s"]
    assert [r["rule_id"] for r in failed_findings(results).collect()] == ["n", "i", "w"]
    assert findings(results, "skipped").count() == 1 and findings(results).count() == 5


def test_gate_and_split(spark):
    evaluation = evaluate(column(spark, ["1", "x", None]), NotNull("n", "t", "x"),
                          AllowedValues("w", "t", "x", ["1"], "warning"))
    report = Report(evaluation).to_dict()
    assert gate(report, max_errors=1) is report
    with pytest.raises(GateFailed):
        gate(report)
    accepted, quarantined = split(evaluation)
    assert [r["x"] for r in accepted.collect()] == ["1", "x"]
    assert [tuple(r) for r in quarantined.collect()] == [(None, ["n"])]


def test_audit_resolves_links_and_ignores_unknown_tables(spark):
    registry = clinical_registry()
    providers = frame(
        spark, ["provider_id", "first_name", "last_name", "specialty", "department_id",
                "hire_date"],
        [("1", "A", "B", "S", "1", "2010-01-01"), ("2", "A", "B", "S", "404", "2010-01-01")])
    departments = frame(
        spark, ["department_id", "department_name", "department_type", "floor"],
        [("1", "Cardiology", "Inpatient", "2")])
    tables = {"providers": providers, "other": providers, "departments": departments}
    audit = Audit(tables, registry, "2024-06-01")
    assert audit.recognised == ["departments", "providers"]
    result = audit.to_dict("audit")
    assert result["aggregate"] == {
        "errors": 1, "warnings": 0, "total_issues": 1, "rows": 3, "rows_with_errors": 1,
        "tables": 2, "score": 97.8,
    }
    frame_row = audit.aggregate().first().asDict()
    assert frame_row["errors"] == 1 and frame_row["rows_with_errors"] == 1
    alone = Checker(spark, as_of="2024-06-01").check_table(providers)
    assert alone["summary"]["rules_skipped"] == 1 and alone["summary"]["errors"] == 0


def test_shared_parents_and_documents(spark, tmp_path):
    keys = column(spark, ["1", "2"], "encounter_id")
    child = frame(spark, ["encounter_id", "v"], [("1", "a"), ("9", "b")])
    link = lambda name: profile(ForeignKey(
        f"{name}.fk", "t", "encounter_id", "encounters", "encounter_id"), key=name)
    registry = Registry([link("x"), link("y"), profile(NotNull("n", "t", "encounter_id"),
                                                       key="encounters")])
    audit = Audit({"x": child, "y": child, "encounters": keys}, registry, "2024-06-01")
    assert {r["dataset"]: r["errors"] for r in audit.summaries().collect()} == {
        "x": 1, "y": 1, "encounters": 0}
    audit.documents().write.json(str(tmp_path / "out"))
    back = {r["dataset"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["x"]["summary"]["errors"] == 1 and back["x"]["columns"] == ["encounter_id", "v"]
    [failed] = back["y"]["results"]
    assert failed["sample"][0]["_line"] == 3
    assert failed["sample"][0]["row"]["encounter_id"] == "9"


class ShortText(RowRule):
    """A rule type of a user's own."""

    message = "too long"

    def failed(self, cells):
        return cells.present(self.column) & (F.length(cells.text(self.column)) > 2)


def test_rule_types_of_your_own(spark):
    report = Report(evaluate(column(spark, ["ab", "abc", None]), ShortText("s", "t", "x")))
    assert [(r["checked"], r["failed"], r["message"]) for r in report.results] == [
        (2, 1, "too long")]


def test_odd_column_names(spark):
    table = frame(spark, ["a.b", "c`d", "e f"], [("1", None, "x"), ("1", "2", None)])
    evaluation = evaluate(table, Unique("u", "t", ["a.b", "e f"]), Unique("v", "t", "a.b"),
                          NotNull("n", "t", "c`d"), IntegerType("i", "t", "e f"))
    failed = {r["rule_id"]: r["failed"] for r in Report(evaluation).results}
    assert failed == {"u": 0, "v": 2, "n": 1, "i": 1}


def test_aggregate_of_no_tables(spark):
    summaries = evaluate(column(spark, []), NotNull("n", "t", "x")).summary().limit(0)
    assert aggregate_of(summaries).first()["score"] == 100.0


def test_row_rules_run_on_a_stream(spark, tmp_path):
    """Row rules are plain expressions, so they flag a stream of rows unchanged."""
    column(spark, ["1", "x", None]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string").parquet(str(tmp_path / "in"))
    flagged = Evaluation(
        stream, profile(NotNull("n", "t", "x"), IntegerType("i", "t", "x"))).flagged()
    run = (flagged.select("x", F.concat_ws(",", "failed_rules").alias("failed"))
           .writeStream.format("memory").queryName("flagged_stream")
           .trigger(availableNow=True).start())
    run.awaitTermination(60)
    rows = {tuple(r) for r in spark.table("flagged_stream").collect()}
    assert rows == {("1", ""), ("x", "i"), (None, "n")}
