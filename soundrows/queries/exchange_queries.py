"""Exchange formats: bundles and feeds derived from the given tables, then flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundrows.operators.audit import Audit
from soundrows.plans.catalogue import clinical_registry
from soundrows.queries.register import AS_OF, query, table
from soundrows.session import scratch_path, stored
from soundrows.sources import fhir, hl7
from soundrows.sources.csv import read_csv
from soundrows.sources.origin import BLOCK, FILE, ORIGIN, SEQUENCE


# -- building bundles ----------------------------------------------------------------
#: Bundles that one task makes and opens.
BUNDLES_PER_TASK = 200_000


def bundles(rows: DataFrame, file: Column, *entries: Column) -> DataFrame:
    """One bundle per row.  Every bundle also holds entries that must be ignored."""
    listed = [F.lit('"oops"'), F.lit('{"resource": "text"}'), *entries]
    bundle = F.concat(
        F.lit('{"resourceType": "Bundle", "type": "collection", "entry": ['),
        F.concat_ws(", ", *listed),
        F.lit("]}"),
    )
    # Bundles would come as many files, hence as many tasks; a table may be one split.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BUNDLES_PER_TASK))
    spread = rows.select("*", file.alias(FILE)).repartition(tasks, FILE)
    return spread.select(FILE, bundle.alias("bundle"))


def staged(texts: DataFrame) -> DataFrame:
    return fhir.staged(fhir.resources_of(texts))


def place(prefix: str, *keys: str) -> Column:
    """A file name that sorts like its keys."""
    return F.concat_ws("/", F.lit(prefix), *[F.lpad(F.col(k).cast("string"), 12, "0")
                                             for k in keys])


def resource(kind: str, id_: Column, **fields: Column) -> Column:
    """An entry with its resource."""
    named = [F.lit(kind).alias("resourceType"), id_.alias("id")]
    body = F.to_json(F.struct(*named, *[value.alias(name) for name, value in fields.items()]))
    return F.concat(F.lit('{"fullUrl": "urn:uuid:'), id_, F.lit('", "resource": '), body, F.lit("}"))


def obj(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def ref(*parts) -> Column:
    return obj(reference=F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def tagged(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# -- patients and encounters ---------------------------------------------------------
def patient_bundles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    nation = F.col("c_nationkey")
    names = F.when(
        nation % 2 == 0,
        F.array(
            obj(use=F.lit("usual"), given=F.array(F.lit("Nick")), family=F.lit("Name")),
            obj(use=F.lit("official"), given=F.array(F.initcap("c_mktsegment")),
                family=F.col("c_name")),
        ),
    ).when(
        nation % 3 == 0,
        F.array(obj(use=F.lit("usual"), given=F.array(F.col("c_mktsegment")),
                    family=F.col("c_name"))),
    )
    born = F.date_add(F.lit("1890-01-01").cast("date"), (F.col("c_custkey") * 40).cast("int"))
    patient = resource(
        "Patient",
        tagged("c", "c_custkey"),
        name=names,
        gender=F.when(nation % 5 == 0, "unknown").when(nation % 2 == 0, "male")
        .otherwise("female"),
        # As a date: a timestamp overflows in the year 294,247.  Spark signs years of over four digits.
        birthDate=F.ltrim(born.cast("string"), F.lit("+")),
        address=F.array(obj(city=F.col("c_mktsegment"),
                            state=F.concat(F.lit("S"), nation.cast("string")))),
        meta=obj(lastUpdated=F.lit("1999-05-05T10:00:00Z")),
    )
    return bundles(rows, place("a", "c_custkey"), patient)


PATIENTS_SQL = """
    SELECT 'c' || c_custkey AS patient_id,
           CASE WHEN c_nationkey % 2 = 0
                THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:])
                WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS first_name,
           CASE WHEN c_nationkey % 2 = 0 OR c_nationkey % 3 = 0 THEN c_name END AS last_name,
           CASE WHEN c_nationkey % 5 = 0 THEN 'unknown' WHEN c_nationkey % 2 = 0 THEN 'M'
                ELSE 'F' END AS gender,
           strftime(DATE '1890-01-01' + CAST(c_custkey * 40 AS INTEGER), '%Y-%m-%d')
               AS birth_date,
           c_mktsegment AS city, 'S' || c_nationkey AS state,
           CAST(NULL AS VARCHAR) AS insurance_provider,
           '1999-05-05' AS registration_date, c_custkey
    FROM customer"""


@query("fhir_patients", f"SELECT * EXCLUDE c_custkey FROM ({PATIENTS_SQL})")
def fhir_patients(spark, folder):
    resources = staged(patient_bundles(spark, folder))
    return fhir.patients(resources).drop(*ORIGIN)


def encounter_bundles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    patient = tagged("c", "o_custkey")
    subject = F.when(status == "F", F.concat(F.lit("urn:uuid:"), patient)).when(
        status == "O", F.concat(F.lit("Patient/"), patient)
    ).otherwise(patient)
    kind = F.when(priority == "1-URGENT", "EMER").when(priority == "2-HIGH", "ACUTE").when(
        priority == "3-MEDIUM", "IMP").when(priority == "4-NOT SPECIFIED", "XYZ")
    doctor = F.concat(F.lit("Practitioner/d"), (F.col("o_custkey") % 17).cast("string"))
    encounter = resource(
        "Encounter",
        tagged("o", "o_orderkey"),
        subject=obj(reference=subject),
        participant=F.array(
            obj(individual=F.lit(None).cast("struct<reference:string>")),
            obj(individual=obj(reference=doctor)),
            obj(individual=obj(reference=F.lit("Practitioner/none"))),
        ),
        serviceProvider=F.when(
            F.col("o_custkey") % 4 != 0,
            ref("https://example.org/Organization/g", (F.col("o_custkey") % 4).cast("string")),
        ),
        period=obj(
            start=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
            end=day(F.date_add("o_orderdate", (F.col("o_orderkey") % 500 - 20).cast("int"))),
        ),
        **{"class": obj(code=kind)},
        hospitalization=obj(
            dischargeDisposition=F.when(
                status == "F", obj(text=F.lit("Home"), coding=F.array(obj(
                    display=F.lit("Other"), code=F.lit("oth"))))
            ).when(
                status == "O", obj(text=F.lit(""), coding=F.array(obj(
                    display=F.lit("Expired"), code=F.lit("exp"))))
            )
        ),
    )
    return bundles(rows, place("b", "o_orderkey"), encounter)


ENCOUNTERS_SQL = """
    SELECT 'o' || o_orderkey AS encounter_id, 'c' || o_custkey AS patient_id,
           'd' || (o_custkey % 17) AS provider_id,
           CASE WHEN o_custkey % 4 <> 0 THEN 'g' || (o_custkey % 4) END AS department_id,
           strftime(o_orderdate, '%Y-%m-%d') AS admit_date,
           strftime(o_orderdate::DATE + CAST(o_orderkey % 500 - 20 AS INTEGER), '%Y-%m-%d')
               AS discharge_date,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergency' WHEN '2-HIGH' THEN 'Urgent'
                WHEN '3-MEDIUM' THEN 'Elective' WHEN '4-NOT SPECIFIED' THEN 'Elective' END
               AS admission_type,
           CASE o_orderstatus WHEN 'F' THEN 'Home' WHEN 'O' THEN 'Expired' END
               AS discharge_disposition, o_orderkey
    FROM orders"""


@query("fhir_encounters", f"SELECT * EXCLUDE o_orderkey FROM ({ENCOUNTERS_SQL})")
def fhir_encounters(spark, folder):
    resources = staged(encounter_bundles(spark, folder))
    return fhir.encounters(resources).drop(*ORIGIN)


# -- diagnoses and procedures --------------------------------------------------------
@query("fhir_diagnoses", """
    SELECT 'e' || event_id AS diagnosis_id, 'u' || user_id AS encounter_id,
           CASE event_type WHEN 'purchase' THEN 'E11.9' WHEN 'view' THEN '44054006'
                WHEN 'click' THEN 'local' END AS icd10_code,
           CASE event_type WHEN 'purchase' THEN 'Diabetes' WHEN 'view' THEN 'view'
                WHEN 'click' THEN 'click' WHEN 'signup' THEN 'signup' END
               AS diagnosis_description,
           CASE WHEN event_type IN ('purchase', 'view', 'error') AND
                     row_number() OVER (
                         PARTITION BY user_id, event_type IN ('purchase', 'view', 'error')
                         ORDER BY CASE WHEN event_type = 'error' THEN ''
                                  ELSE strftime(ts, '%Y-%m-%d') END, event_id) = 1
                THEN 'True' ELSE 'False' END AS is_primary
    FROM events""")
def fhir_diagnoses(spark, folder):
    rows = table(spark, folder, "events")
    kind = F.col("event_type")

    def coding(system, code, display):
        return obj(system=F.lit(system), code=F.lit(code), display=F.lit(display))

    icd, snomed = "http://hl7.org/fhir/sid/icd-10-cm", "http://snomed.info/sct"
    codings = F.when(
        kind == "purchase",
        F.array(coding(snomed, "44054006", "Other"), coding(icd, "E11.9", "Diabetes")),
    ).when(kind == "view", F.array(coding("x", "y", "z"), coding(snomed, "44054006", ""))).when(
        kind == "click", F.array(coding("x", "local", "z"), coding("y", "second", "z"))
    )
    candidate = kind.isin("purchase", "view", "error")
    condition = resource(
        "Condition",
        tagged("e", "event_id"),
        encounter=ref("Encounter/", tagged("u", "user_id")),
        code=obj(text=F.when(kind != "error", kind), coding=codings),
        category=F.array(
            obj(coding=F.array(obj(code=F.lit("problem-list-item")))),
            obj(coding=F.array(obj(code=F.lit("x")), obj(
                code=F.when(candidate, "encounter-diagnosis").otherwise("other")))),
        ),
        onsetDateTime=F.when(kind == "view", day("ts")),
        recordedDate=F.when(kind.isin("purchase", "view"), day("ts")),
    )
    resources = staged(bundles(rows, place("e", "event_id"), condition))
    return fhir.diagnoses(resources).drop(*ORIGIN)


@query("fhir_procedures", """
    SELECT l_orderkey || '-' || l_linenumber AS procedure_id, 'o' || l_orderkey AS encounter_id,
           CASE l_linestatus WHEN 'O' THEN 'Scan' ELSE 'code' END AS procedure_name,
           CASE l_returnflag WHEN 'R' THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END
               AS procedure_date
    FROM lineitem""")
def fhir_procedures(spark, folder):
    rows = table(spark, folder, "lineitem")
    flag = F.col("l_returnflag")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    procedure = resource(
        "Procedure",
        F.concat_ws("-", "l_orderkey", "l_linenumber"),
        encounter=ref("urn:uuid:", tagged("o", "l_orderkey")),
        code=obj(coding=F.array(obj(
            display=F.when(F.col("l_linestatus") == "O", "Scan"), code=F.lit("code")))),
        performedDateTime=F.when(flag == "A", stamp),
        performedPeriod=F.when(flag == "N", obj(start=stamp)),
    )
    resources = staged(
        bundles(rows, place("l", "l_orderkey", "l_linenumber"), procedure)
    )
    return fhir.procedures(resources).drop(*ORIGIN)


# -- prescriptions -------------------------------------------------------------------
@query("fhir_prescriptions", """
    SELECT l_orderkey || '-' || l_linenumber AS prescription_id,
           'o' || l_orderkey AS encounter_id,
           CASE WHEN l_returnflag = 'A' THEN 'inline'
                WHEN l_returnflag = 'N' THEN 'contained ' || l_partkey
                WHEN l_partkey % 10 = 0 THEN NULL
                ELSE p_name || ' ' || p_partkey END AS medication_name,
           CASE l_linestatus WHEN 'O' THEN 'Oral' END AS route
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def fhir_prescriptions(spark, folder):
    """Medications are inline, contained, or resources of their own (the last one wins)."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    flag = F.col("l_returnflag")
    request = resource(
        "MedicationRequest",
        F.concat_ws("-", "l_orderkey", "l_linenumber"),
        encounter=ref("Encounter/", tagged("o", "l_orderkey")),
        medicationCodeableConcept=F.when(flag == "A", obj(text=F.lit("inline"))),
        medicationReference=F.when(flag == "N", ref("#m2")).otherwise(
            ref("Medication/", tagged("p", "l_partkey"))),
        contained=F.array(
            obj(id=F.lit("m1"), code=obj(text=F.lit("wrong"))),
            obj(id=F.lit("m2"), code=obj(text=tagged("contained ", "l_partkey"))),
        ),
        dosageInstruction=F.when(
            F.col("l_linestatus") == "O", F.array(obj(route=obj(text=F.lit("Oral"))))
        ),
    )
    earlier = resource("Medication", tagged("p", "p_partkey"), code=obj(text=F.lit("old")))
    name = F.concat_ws(" ", "p_name", "p_partkey")
    latest = resource(
        "Medication", tagged("p", "p_partkey"),
        code=F.when(F.col("p_partkey") % 10 != 0, obj(text=name)),
    )
    texts = bundles(lines, place("l", "l_orderkey", "l_linenumber"), request).unionByName(
        bundles(parts, place("p", "p_partkey"), earlier, latest)
    )
    return fhir.prescriptions(staged(texts)).drop(*ORIGIN)


# -- billing -------------------------------------------------------------------------
BILLING_SQL = """
    SELECT encounter_id, total_charge, insurance_paid, patient_paid,
           CASE WHEN kind = 0 THEN 'Pending'
                WHEN paid >= o_totalprice * 1000 - 0.01::DOUBLE THEN 'Paid'
                ELSE 'Partially Paid' END AS payment_status
    FROM (SELECT o_orderkey % 3 AS kind, o_totalprice, 'o' || o_orderkey AS encounter_id,
                 CAST(o_totalprice * 1000 AS VARCHAR) AS total_charge,
                 CASE WHEN o_orderkey % 3 = 0 THEN '0'
                      WHEN o_orderstatus = 'F' THEN CAST(o_totalprice * 1000 AS VARCHAR)
                      WHEN o_orderstatus = 'O' THEN '100' ELSE '0' END AS insurance_paid,
                 CASE WHEN o_orderkey % 3 = 0 THEN '0'
                      ELSE CAST(10.25::DOUBLE + o_custkey % 7 AS VARCHAR) END AS patient_paid,
                 10.25::DOUBLE + o_custkey % 7 + CASE o_orderstatus
                     WHEN 'F' THEN o_totalprice * 1000 WHEN 'O' THEN 100 ELSE 0 END AS paid
          FROM orders)"""


def billing_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """A claim per order; a benefit for two of three, half of them not naming the claim."""
    rows = table(spark, folder, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    total = F.col("o_totalprice") * 1000
    encounter = F.array(ref("urn:uuid:", tagged("o", "o_orderkey")))
    claim = resource(
        "Claim", tagged("claim", "o_orderkey"),
        item=F.array(obj(encounter=encounter)), total=obj(value=total),
    )
    amount = lambda value: obj(value=value)
    share = F.array(
        obj(category=obj(text=F.lit("Line Coinsurance Amount")), amount=amount(F.lit(10.25))),
        obj(category=obj(text=F.lit("Deductible")), amount=amount(F.lit(5000.0))),
    )
    more = F.array(
        obj(category=obj(text=F.lit("Other"), coding=F.array(
                obj(code=F.lit("x")), obj(code=F.lit("COINSURANCE")))),
            amount=amount(F.col("o_custkey") % 7)),
        obj(category=obj(text=F.lit("Other"), coding=F.array(
                obj(code=F.lit("coinsurance")), obj(code=F.lit("x")))),
            amount=amount(F.lit(7777))),
    )
    paid = F.when(status == "F", total.cast("string")).when(status == "O", "100")
    benefit = resource(
        "ExplanationOfBenefit", tagged("eob", "o_orderkey"),
        claim=F.when(key % 2 == 0, ref("Claim/", tagged("claim", "o_orderkey"))),
        encounter=ref("Encounter/never"),
        item=F.array(
            obj(encounter=F.lit(None).cast("array<struct<reference:string>>"),
                adjudication=F.to_json(share)),
            obj(encounter=encounter, adjudication=F.to_json(more)),
        ),
        total=F.array(
            obj(category=obj(text=F.lit("Benefit")), amount=amount(F.lit(1.0))),
            obj(category=obj(text=F.lit("Submitted Amount")), amount=amount(total)),
        ),
        payment=obj(amount=F.when(paid.isNotNull(), amount(paid))),
    )
    # Nested lists of different shapes are spliced in as JSON text.
    spliced = F.regexp_replace(benefit, r'"adjudication":"(\[.*?\])"', r'"adjudication":$1')
    spliced = F.regexp_replace(spliced, r'\\"', '"')
    spliced = F.regexp_replace(spliced, r'"payment":\{"amount":\{"value":"([^"]*)"\}\}',
                               r'"payment":{"amount":{"value":$1}}')
    return bundles(rows, place("c", "o_orderkey"), claim, F.when(key % 3 != 0, spliced))


@query("fhir_billing", BILLING_SQL)
def fhir_billing(spark, folder):
    resources = staged(billing_bundles(spark, folder))
    return fhir.billing(resources).drop(*ORIGIN)


# -- insurance and surrogate keys ----------------------------------------------------
@query("fhir_insurance", f"""
    SELECT p.* EXCLUDE c_custkey REPLACE (payer AS insurance_provider)
    FROM ({PATIENTS_SQL}) p LEFT JOIN (
        SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'Payer ' || o_orderpriority
                                  ELSE 'Plan ' || o_orderkey END, o_orderkey) AS payer
        FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def fhir_insurance(spark, folder):
    status = F.col("o_orderstatus")
    kind = ("struct<resourceType:string, payor:array<struct<display:string>>, "
            "type:struct<text:string>>")
    coverage = F.when(
        status == "F",
        obj(resourceType=F.lit("Coverage"),
            payor=F.array(obj(display=tagged("Payer ", "o_orderpriority"))),
            type=obj(text=F.lit("unused"))),
    ).when(
        status == "O",
        obj(resourceType=F.lit("Coverage"), payor=F.array(obj(display=F.lit(""))),
            type=obj(text=tagged("Plan ", "o_orderkey"))),
    )
    other = obj(resourceType=F.lit("Practitioner"),
                payor=F.array(obj(display=F.lit("no"))), type=obj(text=F.lit("no")))
    benefit = resource(
        "ExplanationOfBenefit", tagged("eob", "o_orderkey"),
        patient=ref("Patient/", tagged("c", "o_custkey")),
        contained=F.array(other.cast(kind), coverage.cast(kind)),
    )
    texts = patient_bundles(spark, folder).unionByName(
        bundles(table(spark, folder, "orders"), place("c", "o_orderkey"), benefit)
    )
    resources = staged(texts)
    filled = fhir.with_insurance(fhir.patients(resources), resources)
    return filled.drop(*ORIGIN)


def visit_resources(spark: SparkSession, folder: str) -> DataFrame:
    texts = patient_bundles(spark, folder).unionByName(encounter_bundles(spark, folder))
    return staged(texts)


@query("fhir_surrogate_keys", f"""
    WITH visits AS ({ENCOUNTERS_SQL}),
    seen AS (
        SELECT 'c' || c_custkey AS id, 0 AS t, 0 AS c, c_custkey AS place FROM customer
        UNION ALL SELECT encounter_id, 1, 0, o_orderkey FROM visits
        UNION ALL SELECT patient_id, 1, 1, o_orderkey FROM visits
        UNION ALL SELECT provider_id, 1, 2, o_orderkey FROM visits
        UNION ALL SELECT department_id, 1, 3, o_orderkey FROM visits
        WHERE department_id IS NOT NULL),
    first AS (SELECT id, min((t, c, place)) AS place FROM seen GROUP BY id),
    numbers AS (SELECT id, CAST(row_number() OVER (ORDER BY place) AS VARCHAR) AS n FROM first)
    SELECT e.n AS encounter_id, p.n AS patient_id, d.n AS provider_id, g.n AS department_id,
           admit_date, discharge_date, admission_type, discharge_disposition
    FROM visits v JOIN numbers e ON v.encounter_id = e.id JOIN numbers p ON v.patient_id = p.id
    JOIN numbers d ON v.provider_id = d.id LEFT JOIN numbers g ON v.department_id = g.id""")
def fhir_surrogate_keys(spark, folder):
    resources = visit_resources(spark, folder)
    tables = {
        "patients": stored(fhir.patients(resources), "patients"),
        "encounters": stored(fhir.encounters(resources), "encounters"),
    }
    return fhir.with_surrogate_keys(tables)["encounters"].drop(*ORIGIN)


# -- real files ----------------------------------------------------------------------
def written(lines: DataFrame, name: str, *order: str) -> str:
    """Write text rows as files, one per value of the column ``file``, lines in order."""
    path = scratch_path(lines.sparkSession, name)
    spread = lines.repartition("file").sortWithinPartitions("file", *order)
    spread.select("file", "value").write.partitionBy("file").text(path)
    return path


def file_name(number: Column, suffix: str) -> Column:
    return F.concat(F.lpad(number.cast("string"), 9, "0"), F.lit(suffix))


@query("fhir_folder", f"""
    SELECT * EXCLUDE (c_custkey, patient_id),
           CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR) AS patient_id
    FROM ({PATIENTS_SQL})""")
def fhir_folder(spark, folder):
    """Bundle files of up to 250 patients, with broken files between them, as one set."""
    single = patient_bundles(spark, folder)
    entry = F.explode(F.from_json("bundle", "entry array<string>").getField("entry"))
    key = F.substring_index(FILE, "/", -1).cast("long")
    grouped = (
        single.select(F.floor(key / 250).alias("n"), key.alias("key"), entry.alias("entry"))
        .filter(F.col("entry").startswith("{"))
        .groupBy("n").agg(F.sort_array(F.collect_list(F.struct("key", "entry"))).alias("e"))
    )
    bundle = F.concat(
        F.lit('{"resourceType": "Bundle", "entry": ['),
        F.concat_ws(", ", F.transform("e", lambda x: x["entry"])), F.lit("]}"),
    )
    sound = grouped.select(file_name(F.col("n") * 2, ".json").alias("file"), bundle.alias("value"))
    broken = grouped.select(file_name(F.col("n") * 2 + 1, ".json").alias("file"), F.lit('{"entry": [').alias("value"))
    path = written(sound.unionByName(broken), "bundles")
    return fhir.tables_of_folder(spark, path)["patients"].drop(*ORIGIN)


@query("csv_quotes", """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id,
           CASE WHEN doc_id % 3 = 0 THEN lang || '" wide' ELSE text END AS note, lang
    FROM documents""")
def csv_quotes(spark, folder):
    """Files with quoted cells over several lines next to files with stray quotes."""
    docs = table(spark, folder, "documents")
    stray = F.col("doc_id") % 3 == 0
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    cell = F.when(stray, F.concat("lang", F.lit('" wide'))).otherwise(quoted)
    file = file_name(F.floor(F.col("doc_id") / 5000) * 2 + stray.cast("long"), ".csv").alias("file")
    rows = docs.select(file, "doc_id", F.concat_ws(",", "doc_id", cell, "lang").alias("value"))
    header = rows.select("file", F.lit(-1).cast("long").alias("doc_id"), F.lit("doc_id,note,lang").alias("value")).distinct()
    return read_csv(spark, f"{written(rows.unionByName(header), 'csv-files', 'doc_id')}/*")


@query("fhir_ndjson", f"""
    WITH visits AS ({ENCOUNTERS_SQL}),
    seen AS (
        SELECT encounter_id AS id, 0 AS c, o_orderkey AS place FROM visits
        UNION ALL SELECT patient_id, 1, o_orderkey FROM visits
        UNION ALL SELECT provider_id, 2, o_orderkey FROM visits
        UNION ALL SELECT department_id, 3, o_orderkey FROM visits WHERE department_id IS NOT NULL),
    first AS (SELECT id, min((c, place)) AS place FROM seen GROUP BY id),
    numbers AS (SELECT id, CAST(row_number() OVER (ORDER BY place) AS VARCHAR) AS n FROM first)
    SELECT e.n AS encounter_id, p.n AS patient_id, d.n AS provider_id, g.n AS department_id,
           admit_date, discharge_date, admission_type, discharge_disposition
    FROM visits v JOIN numbers e ON v.encounter_id = e.id JOIN numbers p ON v.patient_id = p.id
    JOIN numbers d ON v.provider_id = d.id LEFT JOIN numbers g ON v.department_id = g.id""")
def fhir_ndjson(spark, folder):
    """One resource per line, malformed lines between them."""
    found = F.get(F.from_json("bundle", "entry array<string>").getField("entry"), F.lit(2))
    entries = encounter_bundles(spark, folder).select(
        F.substring_index(FILE, "/", -1).cast("long").alias("key"),
        F.from_json(found, "resource string").getField("resource").alias("resource"),
    )
    lines = entries.select(
        "key", F.explode(F.array("resource", F.lit("{cut off"), F.lit(""))).alias("value"),
        file_name(F.floor(F.col("key") / 5000), ".ndjson").alias("file"),
    )
    path = written(lines, "ndjson", "key")
    return fhir.tables_of_ndjson(spark, f"{path}/*")["encounters"].drop(*ORIGIN)


# -- audit of a bundle ---------------------------------------------------------------
def _missing(*columns):
    return [(f"not_null.{c}", None, f"{c} IS NULL") for c in columns]


AUDITED = {
    "patients": [
        *_missing("patient_id", "first_name", "last_name", "gender", "birth_date", "city",
                  "state", "insurance_provider", "registration_date"),
        ("unique.id", None, "false"),
        ("int.id", None, "false"),
        ("enum.gender", "gender IS NOT NULL", "gender = 'unknown'"),
        ("regex.state", None, "length(state) <> 2 OR NOT regexp_full_match(state, '[A-Z]*')"),
        ("date.birth", None, f"birth_date < '1900-01-01' OR birth_date > '{AS_OF}'"),
        ("date.registration", None, "false"),
        ("consistency.birth_before_registration", None, "birth_date > registration_date"),
        ("consistency.plausible_age", None,
         f"date_diff('day', birth_date::DATE, DATE '{AS_OF}') > 43830"),
    ],
    "encounters": [
        *_missing("encounter_id", "patient_id", "provider_id", "department_id", "admit_date",
                  "discharge_date", "admission_type", "discharge_disposition"),
        ("unique.id", None, "false"),
        ("int.id", None, "false"),
        ("date.admit", None, f"admit_date > '{AS_OF}'"),
        ("date.discharge", None, f"discharge_date > '{AS_OF}'"),
        ("enum.admission", "admission_type IS NOT NULL", "false"),
        ("enum.disposition", "discharge_disposition IS NOT NULL", "false"),
        ("consistency.discharge_after_admit", None, "discharge_date < admit_date"),
        ("consistency.los_plausible", None,
         "date_diff('day', admit_date::DATE, discharge_date::DATE) > 365"),
        ("fk.patient", None, "patient_id NOT IN (SELECT patient_id FROM patients)"),
        ("fk.provider", "false", "false"),
        ("fk.dept", "false", "false"),
    ],
}


@query("fhir_audit", f"""
    WITH patients AS ({PATIENTS_SQL}), encounters AS ({ENCOUNTERS_SQL})
    {" UNION ALL ".join(
        f"SELECT '{name}' AS dataset, '{name}.{rule}' AS rule_id, "
        f"CAST(count(*) FILTER (WHERE {checked or 'true'}) AS BIGINT) AS checked, "
        f"CAST(count(*) FILTER (WHERE {failed}) AS BIGINT) AS failed FROM {name}"
        for name, rules in AUDITED.items() for rule, checked, failed in rules)}""")
def fhir_audit(spark, folder):
    """A merged set of bundles, flattened, renumbered and audited."""
    tables = fhir.tables_of(visit_resources(spark, folder))
    results = Audit(tables, clinical_registry(), AS_OF).results()
    return results.select("dataset", "rule_id", "checked", "failed")


# -- HL7 feed ------------------------------------------------------------------------
def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of one feed in 60 or so blocks per thousand customers.

    Every tenth customer's PID has no id; every other tenth customer has no PID, so its
    visits belong to the patient above, which may be in an earlier block.
    """
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")

    def segment(name: str, size: int, **fields: Column) -> Column:
        parts = [F.lit(name)] + [
            fields.get(f"f{n}", F.lit("")) for n in range(1, size + 1)
        ]
        return F.concat_ws("|", *parts)

    key = F.col("c_custkey")
    born = F.date_add(F.lit("1950-01-01").cast("date"), (key % 9000).cast("int"))
    pid = segment(
        "PID", 33,
        f3=F.when(key % 10 != 0, F.concat(key.cast("string"), F.lit("^^^REG^PI"))).otherwise(""),
        f5=F.concat(F.col("c_name"), F.lit("^"), F.initcap("c_mktsegment"), F.lit("^X")),
        f7=F.concat(F.date_format(born, "yyyyMMdd"), F.lit("0930")),
        f8=F.when(key % 3 == 0, " M ").when(key % 3 == 1, "F").otherwise("X"),
        f11=F.concat(F.lit("1 St^^"), F.col("c_mktsegment"), F.lit("^S"),
                     F.col("c_nationkey").cast("string")),
        f33=F.when(key % 2 == 0, "20010101").otherwise("2001"),
    )
    order = F.col("o_orderkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    pv1 = segment(
        "PV1", 45,
        f2=F.when(status == "F", "I").when(status == "O", "E").otherwise("Z"),
        f3=F.concat(F.lit("W"), (order % 9).cast("string"), F.lit("^11^B")),
        f4=F.when(priority == "1-URGENT", " E").when(priority == "2-HIGH", "N").otherwise("?"),
        f7=F.concat((order % 40).cast("string"), F.lit("^Doctor")),
        f19=order.cast("string"),
        f36=F.when(status == "F", "01").when(status == "O", "99").otherwise(" "),
        f44=F.date_format("o_orderdate", "yyyyMMddHHmmss"),
        f45=F.lit("today"),
    )

    def lines(rows: DataFrame, customer: Column, at: Column, text: Column) -> DataFrame:
        return rows.select(
            F.lit("feed").alias(FILE),
            F.floor(customer / 16).alias(BLOCK),
            (customer * 1_000_000_000 + at).cast("bigint").alias(SEQUENCE),
            text.alias("value"),
        )

    header = F.lit("MSH|^~\\&|SOURCE|WARD|SINK|X|20010101||ADT^A08|7|T|2.4")
    with_pid = customers.filter(key % 10 != 5)
    buyer = F.col("o_custkey")
    written = (
        lines(customers, key, F.lit(0), header)
        .unionByName(lines(customers, key, F.lit(1), F.lit("  ")))
        .unionByName(lines(with_pid, key, F.lit(2), pid))
        .unionByName(lines(orders, buyer, order + 10, pv1))
    )
    return stored(written, "feed")


HL7_PATIENTS_SQL = """
    SELECT CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS patient_id,
           upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS first_name,
           c_name AS last_name,
           CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS gender,
           strftime(DATE '1950-01-01' + CAST(c_custkey % 9000 AS INTEGER), '%Y-%m-%d')
               AS birth_date,
           c_mktsegment AS city, 'S' || c_nationkey AS state,
           CAST(NULL AS VARCHAR) AS insurance_provider,
           CASE WHEN c_custkey % 2 = 0 THEN '2001-01-01' END AS registration_date
    FROM customer WHERE c_custkey % 10 <> 5"""


@query("hl7_patients", HL7_PATIENTS_SQL)
def hl7_patients(spark, folder):
    return hl7.patients(hl7.segments_of(feed(spark, folder))).drop(*ORIGIN)


HL7_ENCOUNTERS_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id,
           CASE WHEN o_custkey % 10 = 0 THEN NULL
                WHEN o_custkey % 10 = 5 THEN CAST(o_custkey - 1 AS VARCHAR)
                ELSE CAST(o_custkey AS VARCHAR) END AS patient_id,
           CAST(o_orderkey % 40 AS VARCHAR) AS provider_id,
           'W' || (o_orderkey % 9) AS department_id,
           strftime(o_orderdate, '%Y-%m-%d') AS admit_date,
           CAST(NULL AS VARCHAR) AS discharge_date,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'Emergency'
                WHEN o_orderpriority = '2-HIGH' THEN 'Newborn'
                WHEN o_orderstatus = 'F' THEN 'Elective'
                WHEN o_orderstatus = 'O' THEN 'Emergency' END AS admission_type,
           CASE o_orderstatus WHEN 'F' THEN 'Home' WHEN 'O' THEN '99' END
               AS discharge_disposition
    FROM orders"""


@query("hl7_encounters", HL7_ENCOUNTERS_SQL)
def hl7_encounters(spark, folder):
    return hl7.encounters(hl7.segments_of(feed(spark, folder))).drop(*ORIGIN)


def feed_files(spark: SparkSession, folder: str, name: str, value: Column) -> str:
    """The feed as files of up to 1,000 customers; every file begins with a patient."""
    customer = F.floor(F.col(SEQUENCE) / 1_000_000_000)
    lines = feed(spark, folder).select(
        file_name(F.floor(customer / 1000), ".hl7").alias("file"), SEQUENCE, value.alias("value")
    )
    return f"{written(lines, name, SEQUENCE)}/*"


@query("hl7_feed", HL7_ENCOUNTERS_SQL)
def hl7_feed(spark, folder):
    """Visits of feed files; line ends of three kinds."""
    end = F.when(F.col(SEQUENCE) % 3 == 0, "\r").when(F.col(SEQUENCE) % 3 == 1, "\r\n").otherwise("")
    path = feed_files(spark, folder, "feed-files", F.concat("value", end))
    return hl7.tables_of_feed(spark, path)["encounters"].drop(*ORIGIN)


@query("hl7_latin1", HL7_PATIENTS_SQL.replace("c_name AS last_name", "c_name || 'é' AS last_name"))
def hl7_latin1(spark, folder):
    """Patients of feed files in Latin-1."""
    accented = F.regexp_replace("value", r"(Customer#[0-9]+)\^", "$1é^")
    path = feed_files(spark, folder, "latin-files", F.encode(accented, "ISO-8859-1").cast("string"))
    return hl7.tables_of_feed(spark, path)["patients"].drop(*ORIGIN)


HL7_AUDITED = {
    "patients": [
        *_missing("patient_id", "first_name", "last_name", "gender", "birth_date", "city",
                  "state", "insurance_provider", "registration_date"),
        ("unique.id", "patient_id IS NOT NULL", "false"),
        ("int.id", "patient_id IS NOT NULL", "false"),
        ("enum.gender", "gender IS NOT NULL", "gender = 'X'"),
        ("regex.state", "state IS NOT NULL", "NOT regexp_full_match(state, '[A-Z][A-Z]')"),
        ("date.birth", "birth_date IS NOT NULL", "false"),
        ("date.registration", "registration_date IS NOT NULL", f"registration_date > '{AS_OF}'"),
        ("consistency.birth_before_registration", None, "birth_date > registration_date"),
        ("consistency.plausible_age", None, "false"),
    ],
    "encounters": [
        *_missing("encounter_id", "patient_id", "provider_id", "department_id", "admit_date",
                  "discharge_date", "admission_type", "discharge_disposition"),
        ("unique.id", None, "false"),
        ("int.id", None, "false"),
        ("date.admit", None, f"admit_date > '{AS_OF}'"),
        ("date.discharge", "false", "false"),
        ("enum.admission", "admission_type IS NOT NULL", "false"),
        ("enum.disposition", "discharge_disposition IS NOT NULL", "discharge_disposition = '99'"),
        ("consistency.discharge_after_admit", None, "false"),
        ("consistency.los_plausible", None, "false"),
        ("fk.patient", "patient_id IS NOT NULL",
         "patient_id NOT IN (SELECT patient_id FROM patients WHERE patient_id IS NOT NULL)"),
        ("fk.provider", "false", "false"),
        ("fk.dept", "false", "false"),
    ],
}


@query("hl7_audit", f"""
    WITH patients AS ({HL7_PATIENTS_SQL}), encounters AS ({HL7_ENCOUNTERS_SQL})
    {" UNION ALL ".join(
        f"SELECT '{name}' AS dataset, '{name}.{rule}' AS rule_id, "
        f"CAST(count(*) FILTER (WHERE {checked or 'true'}) AS BIGINT) AS checked, "
        f"CAST(count(*) FILTER (WHERE {failed}) AS BIGINT) AS failed FROM {name}"
        for name, rules in HL7_AUDITED.items() for rule, checked, failed in rules)}""")
def hl7_audit(spark, folder):
    """The feed's tables audited together."""
    tables = hl7.tables_of(feed(spark, folder))
    results = Audit(tables, clinical_registry(), AS_OF).results()
    return results.select("dataset", "rule_id", "checked", "failed")
