"""FHIR bundles and HL7 feeds, on small inline inputs."""

import json

import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F

from helpers import evaluate

from soundrows.checks import Checker
from soundrows.errors import CheckError
from soundrows.functions import fhir as fx
from soundrows.operators import rules
from soundrows.operators.keyed import Limits
from soundrows.queries import ORACLES, QUERIES
from soundrows.sources import bundles, fhir, hl7
from soundrows.sources.origin import FILE, ORIGIN, SEQUENCE

ICD10 = "http://hl7.org/fhir/sid/icd-10-cm"
SNOMED = "http://snomed.info/sct"


def write_bundle(path, *resources, urls=True):
    entries = [
        {**({"fullUrl": f"urn:uuid:{r['id']}"} if urls else {}), "resource": r}
        for r in resources
    ]
    path.write_text(json.dumps({"resourceType": "Bundle", "entry": entries}))
    return str(path)


@pytest.fixture
def flatten(spark, tmp_path):
    def run(*resources):
        tables = fhir.tables_of_bundle(spark, write_bundle(tmp_path / "b.json", *resources))
        return {
            name: [r.asDict() for r in rows.orderBy(*ORIGIN).drop(*ORIGIN).collect()]
            for name, rows in tables.items()
        }
    return run


def ref(id_, prefix="urn:uuid:"):
    return {"reference": prefix + id_}


def condition(id_, encounter="e1", codings=(), text=None, dx=True, **more):
    return {
        "resourceType": "Condition", "id": id_, "encounter": ref(encounter),
        "code": {"coding": list(codings), **({"text": text} if text else {})},
        **({"category": [{"coding": [{"code": "encounter-diagnosis"}]}]} if dx else {}), **more,
    }


def coding(system, code, display=None):
    return {"system": system, "code": code, **({"display": display} if display else {})}


def test_patient_encounter_and_references(flatten):
    tables = flatten(
        {"resourceType": "Patient", "id": "anna", "gender": "female", "birthDate": "1971-11-23",
         "name": [{"use": "usual", "family": "No"},
                  {"use": "official", "given": ["Mirela", "X"], "family": "Vance"}],
         "address": [{"city": "Keene", "state": "NH"}, {"city": "Other"}],
         "meta": {"lastUpdated": "2023-06-17T21:40:09Z"}},
        {"resourceType": "Encounter", "id": "visit1", "subject": ref("anna"),
         "participant": [{}, {"individual": ref("d1", "Practitioner/")}],
         "class": {"code": "EMER"}, "serviceProvider": ref("o1", "http://x/Organization/"),
         "period": {"start": "2023-06-19T08:15:00Z", "end": "2023-06-22T17:30:00Z"},
         "hospitalization": {"dischargeDisposition": {"coding": [{"code": "home"}]}}},
        {"resourceType": "Encounter", "id": "visit2", "subject": ref("anna", "Patient/"),
         "class": "IMP"},
        {"resourceType": "Encounter", "id": "visit3", "class": {"code": "NEW"}},
    )
    assert tables["patients"] == [{
        "patient_id": "1", "first_name": "Mirela", "last_name": "Vance", "gender": "F",
        "birth_date": "1971-11-23", "city": "Keene", "state": "NH",
        "insurance_provider": None, "registration_date": "2023-06-17"}]
    first, second, third = tables["encounters"]
    assert first == {
        "encounter_id": "2", "patient_id": "1", "provider_id": "5", "department_id": "6",
        "admit_date": "2023-06-19", "discharge_date": "2023-06-22",
        "admission_type": "Emergency", "discharge_disposition": "home"}
    assert (second["patient_id"], second["admission_type"]) == ("1", None)
    assert (third["patient_id"], third["admission_type"]) == (None, "Elective")


def test_codes_prefer_icd10_then_snomed_then_first(flatten):
    rows = flatten(
        condition("c1", codings=[coding(SNOMED, "44054006", "S"), coding(ICD10, "E11.9", "I")]),
        condition("c2", codings=[coding("x", "1"), coding(SNOMED, "22298006")], text="Infarct"),
        condition("c3", codings=[coding("x", "local", "Shown")]),
        condition("c4", text="only text"),
    )["diagnoses"]
    assert [(r["icd10_code"], r["diagnosis_description"]) for r in rows] == [
        ("E11.9", "I"), ("22298006", "Infarct"), ("local", "Shown"), (None, "only text")]


def test_one_primary_per_encounter(flatten):
    rows = flatten(
        condition("c1", recordedDate="2024-01-02"),
        condition("c2", recordedDate="2024-01-01"),
        condition("c3", dx=False),
        condition("c4", "e2", onsetDateTime="2024-01-05", recordedDate="2020-01-01"),
        condition("c5", "e2", onsetDateTime="2024-01-05"),
        condition("c6", ""),
    )["diagnoses"]
    assert [r["is_primary"] for r in rows] == ["False", "True", "False", "True", "False", "False"]


def test_procedures(flatten):
    rows = flatten(
        {"resourceType": "Procedure", "id": "p1", "code": {"text": "A"},
         "performedDateTime": "2024-01-02T00:00:00Z", "encounter": ref("e")},
        {"resourceType": "Procedure", "id": "p2", "code": {"coding": [{"code": "B"}]},
         "performedPeriod": {"start": "2024-02-02"}},
    )["procedures"]
    assert [(r["procedure_name"], r["procedure_date"]) for r in rows] == [
        ("A", "2024-01-02"), ("B", "2024-02-02")]


def test_medications_inline_resource_and_contained(flatten):
    def request(id_, **more):
        return {"resourceType": "MedicationRequest", "id": id_, **more}

    rows = flatten(
        request("m1", medicationCodeableConcept={"text": "Inline"},
                dosageInstruction=[{"route": {"text": "Oral"}}]),
        request("m2", medicationReference=ref("med", "Medication/")),
        request("m3", medicationReference=ref("#c", ""),
                contained=["x", {"id": "c", "code": {"text": "Inside"}}]),
        request("m4", medicationReference=ref("gone")),
        {"resourceType": "Medication", "id": "med", "code": {"text": "Old"}},
        {"resourceType": "Medication", "id": "med", "code": {"coding": [{"display": "New"}]}},
    )["prescriptions"]
    assert [r["medication_name"] for r in rows] == ["Inline", "New", "Inside", None]
    assert [r["route"] for r in rows] == ["Oral", None, None, None]


def claim(id_, encounter, total):
    return {"resourceType": "Claim", "id": id_, "total": {"value": total},
            "item": [{"encounter": [ref(encounter)]}]}


def benefit(id_, encounter, **more):
    return {"resourceType": "ExplanationOfBenefit", "id": id_,
            "item": [{"encounter": [ref(encounter)], "adjudication": [
                {"category": {"text": "Line Coinsurance"}, "amount": {"value": 10.5}},
                {"category": {"text": "Other", "coding": [{"code": "coinsurance"}]},
                 "amount": {"value": 2}},
                {"category": {"text": "Deductible"}, "amount": {"value": 99}}]}], **more}


def test_billing(flatten):
    rows = flatten(
        claim("c1", "e1", 1200.00), claim("c2", "e2", 500), claim("c3", "e3", 12345678.9),
        claim("c4", "e3", 7),
        benefit("b1", "e1", claim=ref("c1", "Claim/"), payment={"amount": {"value": 1187.5}}),
        benefit("b2", "e2", payment={"amount": None}, total=[
            {"category": {"text": "x"}, "amount": {"value": 1}},
            {"category": {"coding": [{"code": "submitted"}]}, "amount": {"value": 80}}]),
        {"resourceType": "ExplanationOfBenefit", "id": "b3", "payment": {"amount": {"value": 5}}},
    )["billing"]
    plain = [(r["total_charge"], r["insurance_paid"], r["patient_paid"], r["payment_status"])
             for r in rows]
    assert plain == [
        ("1200.0", "1187.5", "12.5", "Paid"),
        ("80", "0", "12.5", "Partially Paid"),
        (None, "5", "0", "Pending"),
        ("12345678.9", "0", "0", "Pending"),
        ("7", "0", "0", "Pending"),
    ]
    assert rows[2]["encounter_id"] is None and rows[3]["encounter_id"] == rows[4]["encounter_id"]


def test_insurer_comes_from_the_last_benefit_that_names_one(flatten):
    def cover(id_, *contained):
        return benefit(id_, "e", patient=ref("p"), contained=list(contained))

    patients = flatten(
        {"resourceType": "Patient", "id": "p"},
        cover("b1", {"resourceType": "Coverage", "payor": [{"display": "First"}]}),
        cover("b2", {"resourceType": "Coverage"},
              {"resourceType": "Coverage", "type": {"text": "By type"}}),
        cover("b3", {"resourceType": "Patient", "payor": [{"display": "No"}]}),
    )["patients"]
    assert patients[0]["insurance_provider"] == "By type"


@pytest.mark.parametrize("name", ["oops", ["oops"], [123], None, [["x"]], {"family": "x"}])
def test_malformed_names(flatten, name):
    [row] = flatten({"resourceType": "Patient", "id": "p", "gender": "male",
                     "name": name})["patients"]
    assert (row["first_name"], row["last_name"], row["gender"]) == (None, None, "M")


def test_only_usable_bundles(spark, tmp_path):
    path = tmp_path / "x.json"
    for text, message in [
        ("not json", "not JSON"),
        ('{"resourceType": "Patient", "id": "x"}', "not a FHIR Bundle"),
        ("[1]", "not a FHIR Bundle"),
        ('{"resourceType": "Bundle", "entry": []}', "is empty"),
        ('{"resourceType": "Bundle", "entry": [1, {"resource": 2}, '
         '{"resource": {"resourceType": "Device", "id": "d"}}]}', "makes a table"),
    ]:
        path.write_text(text)
        with pytest.raises(CheckError, match=message):
            fhir.tables_of_bundle(spark, str(path))


def test_folder_skips_bad_files_and_shares_keys(spark, tmp_path):
    write_bundle(tmp_path / "b.json", {"resourceType": "Encounter", "id": "e",
                                       "subject": ref("p")})
    write_bundle(tmp_path / "a.json", {"resourceType": "Patient", "id": "p"})
    (tmp_path / "c.json").write_text("broken {")
    (tmp_path / "d.json").write_text('{"resourceType": "Patient", "id": "q"}')
    checked = Checker(spark, as_of="2024-06-01").check_fhir_folder(str(tmp_path))
    assert checked["recognised"] == ["patients", "encounters"]
    tables = fhir.tables_of_folder(spark, str(tmp_path))
    [patient] = tables["patients"].collect()
    [encounter] = tables["encounters"].collect()
    assert encounter["patient_id"] == patient["patient_id"] == "1"


def test_newline_delimited_resources(spark, tmp_path):
    path = tmp_path / "r.ndjson"
    path.write_text("\n".join(json.dumps(r) for r in [
        claim("c1", "e1", 10), benefit("b1", "e1", claim=ref("c1", "Claim/"))]))
    [row] = fhir.tables_of_ndjson(spark, str(path))["billing"].collect()
    assert (row["total_charge"], row["patient_paid"]) == ("10", "12.5")


def test_hot_references_take_the_salted_join(spark, tmp_path):
    resources = [claim("c1", "e1", 10), claim("c2", "e2", 20)] + [
        benefit(f"b{i}", f"e{i}", claim=ref("c1" if i % 3 else "c2", "Claim/"))
        for i in range(30)
    ] + [benefit(f"n{i}", f"n{i}") for i in range(10)]
    path = write_bundle(tmp_path / "b.json", *resources)
    staged = fhir.staged(fhir.resources_of(fhir.read_bundles(spark, path)))
    tiny = Limits(broadcast_bytes=0, hot_rows=5, hot_keys=1, salts=4)
    plain, salted = (
        sorted(tuple(map(str, r)) for r in fhir.billing(staged, limits).collect())
        for limits in (Limits(), tiny)
    )
    assert plain == salted and len(plain) == 40
    tables = {"billing": fhir.billing(staged)}
    keyed = [
        sorted(tuple(map(str, r)) for r in
               fhir.with_surrogate_keys(tables, limits)["billing"].collect())
        for limits in (Limits(), Limits(broadcast_bytes=0, hot_rows=1, hot_keys=3, salts=4))
    ]
    assert keyed[0] == keyed[1]


def test_bundle_audit(spark, tmp_path):
    path = write_bundle(
        tmp_path / "b.json",
        {"resourceType": "Patient", "id": "p", "gender": "unknown", "birthDate": "1980-01-01"},
        {"resourceType": "Encounter", "id": "e", "subject": ref("p"),
         "period": {"start": "2024-01-05", "end": "2024-01-01"}, "class": {"code": "IMP"}},
        {"resourceType": "Encounter", "id": "f", "subject": ref("nobody"),
         "period": {"start": "2024-01-05", "end": "2024-01-06"}, "class": {"code": "IMP"}},
    )
    result = Checker(spark, as_of="2024-06-01").check_fhir(path)
    assert (result["source"], result["format"]) == ("fhir", "FHIR R4")
    assert result["recognised"] == ["patients", "encounters"]
    rules = {r["rule_id"]: r for t in result["tables"] for r in t["results"]}
    assert rules["patients.enum.gender"]["sample"] == [{"_line": 2, "gender": "unknown"}]
    assert rules["encounters.fk.patient"]["sample"] == [{"_line": 3, "patient_id": "4"}]
    assert rules["encounters.consistency.discharge_after_admit"]["failed"] == 1
    assert rules["encounters.fk.provider"]["status"] == "skipped"


# -- HL7 ---------------------------------------------------------------------------
def segment(name, **fields):
    size = max((int(k[1:]) for k in fields), default=1)
    return "|".join([name] + [fields.get(f"f{n}", "") for n in range(1, size + 1)])


def feed(spark, tmp_path, *lines, sep="\r", name="f.hl7", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(sep.join(lines).encode(encoding))
    return {
        table: [r.asDict() for r in rows.orderBy(*ORIGIN).drop(*ORIGIN).collect()]
        for table, rows in hl7.tables_of_feed(spark, str(path)).items()
    }


MSH = "MSH|^~\\&|HIS|HOSP|EHR|D|20240310||ADT^A01|1|P|2.5"
PID = segment("PID", f3="8302^^^REG^PI", f5="Vance^Mirela", f7="19711123", f8="F",
              f11="7 Mill Lane^^Keene^NH^03431", f33="20240301")
PV1 = segment("PV1", f2="I", f3="ICU^4^B", f4="E", f7="477^Adeyemi^Tola", f19="7719^^^REG",
              f36="01", f44="20240310090000", f45="20240312110000")


@pytest.mark.parametrize("sep", ["\r", "\n", "\r\n", "\r\n\r\n"])
def test_segments_and_fields(spark, tmp_path, sep):
    tables = feed(spark, tmp_path, MSH, "EVN|A01", f"  {PID}", PV1, sep=sep)
    assert tables["patients"] == [{
        "patient_id": "8302", "first_name": "Mirela", "last_name": "Vance", "gender": "F",
        "birth_date": "1971-11-23", "city": "Keene", "state": "NH",
        "insurance_provider": None, "registration_date": "2024-03-01"}]
    assert tables["encounters"] == [{
        "encounter_id": "7719", "patient_id": "8302", "provider_id": "477",
        "department_id": "ICU", "admit_date": "2024-03-10", "discharge_date": "2024-03-12",
        "admission_type": "Emergency", "discharge_disposition": "Home"}]


def test_codes_and_carry(spark, tmp_path):
    visits = feed(
        spark, tmp_path,
        segment("PV1", f2="O"), MSH, PID, segment("PV1", f2="E", f4="?", f36="99"), MSH,
        segment("PV1", f2="?", f4=" u "), segment("PID", f3=""), segment("PV1", f4=" U"),
    )["encounters"]
    assert [v["patient_id"] for v in visits] == [None, "8302", "8302", None]
    assert [v["admission_type"] for v in visits] == ["Elective", "Emergency", None, "Urgent"]
    assert visits[1]["discharge_disposition"] == "99"


def test_carry_crosses_blocks_but_not_files(spark, tmp_path):
    lines = [MSH, PID] + [segment("PV1", f19=str(n)) for n in range(2000)]
    folder = tmp_path / "feeds"
    folder.mkdir()
    (folder / "a.hl7").write_text("\r".join(lines))
    (folder / "b.hl7").write_text(segment("PV1", f19="lost"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = hl7.encounters(hl7.segments_of(hl7.read_feed(spark, str(folder)))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r["_src_block"] for r in rows}) > 3
    assert {r["patient_id"] for r in rows if r["encounter_id"] != "lost"} == {"8302"}
    assert [r["patient_id"] for r in rows if r["encounter_id"] == "lost"] == [None]


def test_latin_files_are_decoded_as_a_whole(spark, tmp_path):
    line = segment("PID", f5="Müller^Zoë")
    for encoding in ("utf-8", "latin-1"):
        [row] = feed(spark, tmp_path, MSH, line, encoding=encoding)["patients"]
        assert (row["last_name"], row["first_name"]) == ("Müller", "Zoë")


def test_unusable_feeds(spark, tmp_path):
    with pytest.raises(CheckError, match="no segment"):
        feed(spark, tmp_path, "this is not a message")
    with pytest.raises(CheckError, match="neither patients"):
        feed(spark, tmp_path, MSH)


def test_feed_audit(spark, tmp_path):
    path = tmp_path / "f.hl7"
    path.write_text("\r".join([MSH, PID.replace("|F|", "|X|"), PV1]))
    result = Checker(spark, as_of="2024-06-01").check_hl7(str(path))
    assert (result["source"], result["format"]) == ("hl7v2", "HL7 v2")
    failed = {r["rule_id"] for t in result["tables"] for r in t["results"] if r["failed"]}
    assert failed == {"patients.enum.gender", "patients.not_null.insurance_provider"}


# -- nothing is lost ------------------------------------------------------------------
def raw_patient(number, extra=""):
    return f'{{"resourceType": "Patient", "id": "q{number}", "gender": "male"{extra}}}'


def write_text_bundle(path, *resources):
    entries = ", ".join(f'{{"resource": {r}}}' for r in resources)
    path.write_text(f'{{"resourceType": "Bundle", "entry": [{entries}]}}')


def both_ways(spark, folder, name):
    """Patients by the folder and by the single-file path."""
    merged = fhir.tables_of_folder(spark, str(folder))["patients"].count()
    return merged, fhir.tables_of_bundle(spark, str(folder / name))["patients"].count()


def test_very_long_strings_lose_nothing(spark, tmp_path):
    data = "A" * 25_000_000
    write_text_bundle(
        tmp_path / "a.json", raw_patient(1), f'{{"resourceType": "Binary", "id": "b", "data": "{data}"}}',
        raw_patient(2, f', "photo": [{{"data": "{data}"}}]'),
    )
    assert both_ways(spark, tmp_path, "a.json") == (2, 2)


def test_bundles_beyond_128_mib(spark, tmp_path):
    note = "n" * 4000
    write_text_bundle(tmp_path / "a.json", *[raw_patient(i, f', "text": {{"div": "{note}"}}') for i in range(35_000)])
    assert (tmp_path / "a.json").stat().st_size > 128 << 20
    assert both_ways(spark, tmp_path, "a.json") == (35_000, 35_000)


def test_of_a_repeated_key_the_last_value_counts(spark, tmp_path):
    write_text_bundle(tmp_path / "a.json", raw_patient(1), raw_patient(2, ', "gender": "female", "name": [{"family": "X", "family": "Y"}]'))
    rows = fhir.tables_of_folder(spark, str(tmp_path))["patients"].orderBy("patient_id").collect()
    assert [r.gender for r in rows] == ["M", "F"] and rows[1].last_name == "Y"
    assert both_ways(spark, tmp_path, "a.json") == (2, 2)


def test_skipped_files_have_reasons(spark, tmp_path):
    write_text_bundle(tmp_path / "a.json", raw_patient(1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('["x"]')
    (tmp_path / "d.json").write_text('{"resourceType": "Bundle"}')
    found = {r[0].rsplit("/", 1)[1]: r.reason for r in fhir.skipped_in_folder(spark, str(tmp_path)).collect()}
    assert found == {"b.json": "This is not JSON.", "c.json": "Not a bundle.", "d.json": "Empty."}


def test_lines_count_through_a_merged_folder(spark, tmp_path):
    bad = ', "birthDate": "never"'
    write_text_bundle(tmp_path / "a.json", raw_patient(1, bad), raw_patient(2, bad))
    write_text_bundle(tmp_path / "b.json", raw_patient(3, bad), raw_patient(4, bad))
    table = fhir.tables_of_folder(spark, str(tmp_path))["patients"]
    rule = rules.DateValid("d", "d", "birth_date")
    assert sorted(r["_line"] for r in evaluate(table, rule).samples().collect()) == [2, 3, 4, 5]


def test_dates_and_references_are_strings(spark, tmp_path):
    write_text_bundle(
        tmp_path / "a.json",
        '{"resourceType": "Encounter", "id": "e1", "subject": [{"reference": "Patient/p"}], "period": {"start": 20200101}}',
        '{"resourceType": "Encounter", "id": "e2", "subject": {"reference": "Patient/p"}, "period": {"start": "2020-01-01T10:00"}}',
        '{"resourceType": "Encounter", "id": "e3", "subject": {"reference": 7}, "period": {"start": ["2020"]}}',
    )
    rows = {r["encounter_id"]: r for r in fhir.tables_of_bundle(spark, str(tmp_path / "a.json"))["encounters"].collect()}
    values = [(r["patient_id"] is not None, r["admit_date"]) for r in sorted(rows.values(), key=lambda r: int(r["encounter_id"]))]
    assert values.count((True, "2020-01-01")) == 1 and values.count((False, None)) == 2


def test_csv_files_follow_the_table(spark, monkeypatch):
    """One file of quoted and one of stray cells per 5,000 documents, not six for any table."""
    from soundrows.queries import exchange_queries

    docs = spark.range(20_000).selectExpr("id doc_id", "'a text' text", "'en' lang")
    seen = []
    monkeypatch.setattr(exchange_queries, "table", lambda *_: docs)
    monkeypatch.setattr(exchange_queries, "written", lambda rows, *_: seen.append(rows) or "nowhere")
    monkeypatch.setattr(exchange_queries, "read_csv", lambda *_: None)
    exchange_queries.csv_quotes(spark, "")
    sizes = [r["count"] for r in seen[0].groupBy("file").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 5001 and sum(sizes) == 20_008


# -- bundles in blocks ----------------------------------------------------------------
def rows_of(resources):
    return sorted(
        (r["_src_file"].rsplit("/", 1)[1], r["_src_seq"], r["full_url"], r["id"], r["label"])
        for r in resources.filter("resource_type is not null").collect()
    )


@pytest.mark.parametrize("block", [100])
def test_bundles_at_every_block_border(spark, tmp_path, block):
    """Braces, quotes and escapes in strings; the same rows as from whole texts."""
    import random

    draw = random.Random(block)
    strings = ["}", "{", '"', "\\", '\\"', "}\\", "a, b", "[{", "}]}", "é", "\n", "x" * 150]
    for number in range(2):
        entries = []
        for i in range(12):
            note = "".join(draw.choice(strings) for _ in range(draw.randrange(5)))
            resource = {"resourceType": draw.choice(["Patient", "Encounter", "Device"]), "id": f"{number}-{i}",
                        "code": {"text": note}, "name": [{"family": note, "given": [note, {"a": [1, {}]}]}]}
            entries.append(draw.choice([{"fullUrl": f"u{note}", "resource": resource}, {"resource": resource}, 7, None, "}", {}]))
        bundle = {"link": [{"url": "}"}], "meta": {"a": {"b": "{"}}, "resourceType": "Bundle", "entry": entries, "total": 5}
        (tmp_path / f"{number}.json").write_text(
            json.dumps(bundle, indent=[None, 1][number], ensure_ascii=False) + "\n" * number
        )
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = bundles.read(spark, f"{tmp_path}/*.json", fhir.opened)
        assert all(r.sound and r.bundle_type == "Bundle" and r.n == 12 for r in found.files.collect())
        mine = rows_of(fhir.resources_in(found))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert mine == rows_of(fhir.resources_of(fhir.read_bundles(spark, f"{tmp_path}/*.json")))
    assert len(mine) > 5


def test_odd_files_are_judged_like_whole_texts(spark, tmp_path):
    sound = '{"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "p"}}]}'
    texts = [
        sound, sound[:-1], sound[:-2], sound + "}", sound + " \n", sound.replace("}}]", "}},,{}]"), sound.replace("}}]", "}} {}]"),
        sound.replace('"id": "p"', '"id" "p"'), sound.replace('"Bundle"', '"Bundle", "meta": {broken}'), "", "{}", "}", "null",
        sound.replace('"entry"', '"entry": [1, 2], "entry"'), sound.replace('"p"', '"p}'), "[" + sound + "]", '{"entry": {}}',
    ]
    for i, text in enumerate(texts):
        (tmp_path / f"{i:02}.json").write_text(text)
    mine = {r[0][-7:]: (r.sound, r.bundle_type, r.n) for r in bundles.read(spark, f"{tmp_path}/*.json", fhir.opened).files.collect()}
    whole = fhir.opened(fhir.read_bundles(spark, f"{tmp_path}/*.json")).selectExpr(
        "_src_file", "sound", "bundle_type", "coalesce(size(entries), 0) n"
    )
    theirs = {r[0][-7:]: (r.sound, r.bundle_type, r.n) for r in whole.collect()}
    for i, text in enumerate(texts):
        name = f"{i:02}.json"
        if theirs.get(name, (False,))[0]:
            assert mine[name] == theirs[name], text
        else:
            assert not mine[name][0], text


def test_large_maps_of_ids_give_the_same_tables(spark, tmp_path):
    """Every table with several id columns, by broadcast and in long form."""
    resources = [{"resourceType": "Patient", "id": f"p{i}"} for i in range(6)]
    resources += [
        {"resourceType": "Encounter", "id": f"e{i}", "subject": ref(f"p{i % 3}"),
         **({"serviceProvider": ref("d")} if i % 2 else {}),
         "participant": [{"individual": ref(f"doc{i % 4}")}]}
        for i in range(20)
    ]
    path = write_bundle(tmp_path / "b.json", *resources)
    found = fhir.resources_in(bundles.read(spark, path, fhir.opened))
    staged = fhir.staged(found)
    tables = {"patients": fhir.patients(staged), "encounters": fhir.encounters(staged)}
    by_broadcast = fhir.with_surrogate_keys(tables)
    in_long_form = fhir.with_surrogate_keys(tables, Limits(broadcast_bytes=0, hot_rows=5, hot_keys=2, salts=3))
    for name in tables:
        assert by_broadcast[name].columns == in_long_form[name].columns == tables[name].columns
        rows = [sorted(map(str, t[name].collect())) for t in (by_broadcast, in_long_form)]
        assert rows[0] == rows[1] and len(rows[0]) == tables[name].count()


def plans_of(monkeypatch, spark, name):
    """The frames that a query stores, by name, without their rows."""
    from soundrows import session
    from soundrows.queries import QUERIES

    seen = {}

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    def noted(frame, label, *args, **options):
        seen[label] = plan(frame)
        return session.stored(frame, label, *args, **options)

    monkeypatch.setattr(fhir, "stored", noted)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    return seen


def test_staging_parses_each_text_once(spark, monkeypatch):
    """The bundle, the entry and the resource; no body is sorted by type, no other member opened."""
    staging = plans_of(monkeypatch, spark, "fhir_procedures")["resources"]
    bundle = staging.count("StructField(entry,ArrayType(StringType,true),true)")
    assert (bundle, staging.count("StructField(fullUrl,StringType,true)")) == (1, 1)
    assert staging.count("StructField(resourceType,VariantType,true)") == 1
    assert staging.count("to_json") + staging.count("StructsToJson") <= 1 and "get_json_object" not in staging
    assert "StructField(birthDate" not in staging and "Sort [" not in staging


def test_bundles_are_dealt_by_their_number(spark, monkeypatch):
    from soundrows.queries import exchange_queries

    monkeypatch.setattr(exchange_queries, "BUNDLES_PER_TASK", 50)
    found = exchange_queries.encounter_bundles(spark, "/root/testdata/sf0.001")
    rows = exchange_queries.table(spark, "/root/testdata/sf0.001", "orders").count()
    assert found.rdd.getNumPartitions() == -(-rows // 50) > 8


def test_a_contained_medication_is_looked_up_once(spark, monkeypatch):
    requests = plans_of(monkeypatch, spark, "fhir_prescriptions")["requests"]
    assert requests.count("lambdafunction") <= 2 and requests.count("filter(") <= 1


def test_surrogate_numbers_read_a_table_once_in_bounded_tasks(spark, tmp_path, monkeypatch):
    resources = [
        {"resourceType": "Encounter", "id": f"e{i}", "subject": ref(f"p{i % 7}"), "serviceProvider": ref("d"),
         "participant": [{"individual": ref(f"e{i - 1}")}]}
        for i in range(60)
    ]
    path = write_bundle(tmp_path / "b.json", *resources)
    tables = {"encounters": fhir.encounters(fhir.staged(fhir.resources_of(fhir.read_bundles(spark, path))))}
    numbered = {r.id: r.number for r in fhir.surrogate_numbers(tables).collect()}
    monkeypatch.setattr(fhir, "ROWS_PER_TASK", 2)
    seen = []
    monkeypatch.setattr(fhir, "numbered", lambda first, *_: seen.append(first) or first.withColumn("number", F.lit(0)))
    fhir.surrogate_numbers(tables)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and ", REPARTITION_BY_NUM" in plan and ", 30)" in plan
    # Ids of encounters come first, then patients, then the practitioner of the first row.
    assert numbered["e0"] == 1 and numbered["e59"] == 60 and numbered["p0"] == 61
    assert numbered["e-1"] == 68 and numbered["d"] == 69 and len(numbered) == 69


def test_benefits_are_read_once_per_part(spark, monkeypatch):
    """What several columns need is a column itself, not an expression in each of them."""
    benefits = plans_of(monkeypatch, spark, "fhir_billing")["benefits"]
    assert benefits.count("$.item") + benefits.count("item, $, ArrayType") <= 2
    assert benefits.count(".total, $,") <= 1


def test_entries_without_a_resource_are_not_staged(spark):
    entries = ['"oops"', '{"resource": "text"}', "{}", '{"resource": {"resourceType": "Device"}}', '{"resource": {"id": "x"}}']
    bundle = '{"resourceType": "Bundle", "entry": [%s]}' % ", ".join(entries)
    texts = spark.createDataFrame([("f", bundle), ("g", '{"resourceType": "Bundle"}'), ("h", "{")], f"{FILE} string, bundle string")
    rows = fhir.resources_of(texts).select(FILE, SEQUENCE, "resource_type", "id").collect()
    assert sorted(map(tuple, rows)) == [("f", 3, "other", None), ("f", 4, None, "x")]


def test_lookups_by_structs_equal_lookups_by_paths(spark):
    """No lookup names a member in its path: where it is missing, Spark would throw and catch in each row."""
    texts = [
        "null", "1.50", '"s"', "[]", "{}", "[[1]]", '{"a":null}', '{"a":1.0}', '{"a":""}', '{"a":{"b":2.50}}', '{"a":{"b":[]}}',
        '{"a":{"b":[3,{"c":4}]}}', '{"a":{"b":{"c":5}}}', '[{"a":{"b":[{"c":1e400}]}}]', '{"a":1,"a":{"b":7}}', '{"A":1}', '{"a":[{"b":1}]}',
    ]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.try_parse_json("t").alias("v"))
    paths = ["$", "$.a", "$.a.b", "$.a.b[0]", "$.a.b[1].c", "$[0].a.b[0].c", "$.a[0].b"]
    cases = [(p, k) for p in paths for k in ("string", "double", "variant", "array<variant>")]
    mine = [F.to_json(F.struct(fx.pick(F.col("v"), p, k).alias("x"))) for p, k in cases]
    theirs = [F.to_json(F.struct(F.try_variant_get("v", p, k).alias("x"))) for p, k in cases]
    for row in parsed.select("t", F.array(*mine).alias("mine"), F.array(*theirs).alias("theirs")).collect():
        assert row.mine == row.theirs, row.t
    plan = parsed.select(*[fx.pick(F.col("v"), p, k) for p, k in cases])._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_get" in plan and "$." not in plan


def test_an_entry_is_read_once_for_its_keys(spark, monkeypatch):
    """No text of its own is written for the resource, neither at staging nor for its table."""
    seen = plans_of(monkeypatch, spark, "fhir_encounters")["resources"]
    assert "StructField(resource,StructType(StructField(resourceType,VariantType,true)" in seen
    assert seen.count("StructField(id,VariantType,true)") <= 2 and "StructField(fullUrl,StringType,true), StructField(resource,StringType" not in seen


def test_an_encounter_looks_its_participants_up_at_once(spark, tmp_path):
    path = write_bundle(tmp_path / "b.json", {"resourceType": "Encounter", "id": "e"})
    rows = fhir.encounters(fhir.staged(fhir.resources_of(fhir.read_bundles(spark, path))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count(".participant, $,") == 1 and "StructField(individual,StringType" not in plan
    assert plan.count(".period, $,") == 1


def test_entries_in_odd_spellings(spark):
    """Blanks and escapes in names, repeated names, members of the same name further inside."""
    good = '{"resourceType": "Encounter", "id": "%s", "period": {"start": "2020-01-02"}}'
    entries = [
        '{"fullUrl": "u0", "resource" :\n\t' + good % "0" + "}",
        r'{"resource": ' + good % "1" + "}",
        '{"resource": "text", "resource": ' + good % "2" + "}",
        '{"resource": ' + good % "no" + ', "resource": "text"}',
        '{"resource": ' + good % "no" + ', "resource": null}',
        '{"resource": ' + good % "no" + ', "resource": [7], "fullUrl": "u", "resource": ' + good % "5" + "}",
        '{"x": {"resource": {"id": "no"}}, "resource": "text"}',
        '{"x": {"resource": {"id": "no"}}}',
        '{"x": [{"resource": {"id": "no"}}], "resource": ' + good % "8" + "}",
        '{"resource": [' + good % "no" + "]}",
        '"{\\"fullUrl\\": 1}"', "[]", "null", "7",
        '{"resource": ' + (good % "14").replace('"period"', '"note": "\\"resource\\":{", "period"') + "}",
    ]
    bundle = '{"resourceType": "Bundle", "entry": [%s]}' % ", ".join(entries)
    texts = spark.createDataFrame([("f", bundle)], f"{FILE} string, bundle string")
    staged = fhir.staged(fhir.resources_of(texts))
    rows = staged.filter("resource_type is not null").select(SEQUENCE, "resource_type", "id", "full_url").collect()
    urls = {0: "u0", 5: "u"}
    assert sorted(map(tuple, rows)) == [(i, "Encounter", str(i), urls.get(i)) for i in (0, 1, 2, 5, 8, 14)]
    found = fhir.encounters(staged).select("encounter_id", "admit_date").collect()
    assert sorted(map(tuple, found)) == [(str(i), "2020-01-02") for i in (0, 1, 14, 2, 5, 8)]


def test_participants_in_odd_shapes(spark):
    lists = [
        ('[{}, {"individual": null}, 7, null, [], {"individual": {"reference": "Practitioner/a"}}]', "a"),
        ('[{"individual": "Practitioner/b"}, {"individual": {"reference": "c"}}]', "b"),
        ('[{"individual": {}}, {"individual": {"reference": "c"}}]', None), ('[{"individual": 7}]', None), ("[]", None), ("null", None),
        ('{"individual": {"reference": "c"}}', None), ('[{"individual": {"reference": ""}}]', None), ('[{"individual": [1]}]', None),
    ]
    entries = [
        f'{{"resource": {{"resourceType": "Encounter", "id": "{i}", "participant": {people}, "period": {{"start": {i}, "end": "2020-01-02T03:04"}}}}}}'
        for i, (people, _) in enumerate(lists)
    ]
    bundle = '{"resourceType": "Bundle", "entry": [%s]}' % ", ".join(entries)
    texts = spark.createDataFrame([("f", bundle)], f"{FILE} string, bundle string")
    rows = fhir.encounters(fhir.staged(fhir.resources_of(texts))).orderBy(SEQUENCE)
    found = [tuple(r) for r in rows.select("provider_id", "admit_date", "discharge_date").collect()]
    assert found == [(provider, None, "2020-01-02") for _, provider in lists]


def test_days_of_long_years_are_whole(spark):
    days = {
        "2024-03-05T10:00:00Z": "2024-03-05", "2024-03": "2024-03", "2024": "2024", "": None, None: None, "10005-02-27": "10005-02-27",
        "297583-12-17T10:00:00Z": "297583-12-17", "+10005-02-27": "+10005-02-", "20240305T10:00-05:00": "20240305T1", "12345-6-7 or so": "12345-6-7 ",
        "2024\n03\n05 x": "2024\n03\n05", "\U0001f600" * 11: "\U0001f600" * 10,
    }
    rows = spark.createDataFrame([(d,) for d in days], "d string").select("d", fx.day_of(F.col("d")).alias("day")).collect()
    assert {r.d: r.day for r in rows} == days


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Customers by whose keys births are in years of four, five and seven digits, and their orders."""
    folder, connection = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        moved = f"{key} + CASE WHEN {key} < 50 THEN 0 WHEN {key} < 100 THEN 75000 ELSE 9200000 END AS {key}"
        connection.execute(f"CREATE TABLE {name} AS SELECT * REPLACE ({moved}) FROM '/root/testdata/sf0.001/{name}.parquet'")
        connection.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return connection, folder


@pytest.mark.parametrize("name", ["fhir_patients", "fhir_insurance", "fhir_audit", "fhir_surrogate_keys", "fhir_folder"])
def test_births_in_far_years(spark, far, name):
    connection, folder = far
    assert differences(spark, connection, name, QUERIES[name], ORACLES[name], folder) is None
