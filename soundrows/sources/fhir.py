"""FHIR R4 bundles flattened into tables.

A bundle becomes one row per resource: its position, keys, type and body.  Six tables
are selected from these rows; references between resources are joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundrows.errors import CheckError
from soundrows.fixed_values import (
    FHIR_DEFAULT_ADMISSION,
    FHIR_ENCOUNTER_CLASSES,
    FHIR_GENDERS,
    ID_COLUMNS,
)
from soundrows.functions import fhir as fx
from soundrows.functions.text import float_text, mapped, nonempty
from soundrows.operators.keyed import (
    DEFAULT_LIMITS,
    Limits,
    attach,
    fits_broadcast,
    lookup,
    most_frequent,
)
from soundrows.operators.numbering import numbered
from soundrows.session import Workers, stored
from soundrows.sources import bundles
from soundrows.sources.bundles import Bundles
from soundrows.sources.origin import BLOCK, FILE, ORIGIN, SEQUENCE, with_file_origin

# Which resource types a table is made of, in table order.
TABLE_TYPES = {
    "patients": ("Patient",),
    "encounters": ("Encounter",),
    "diagnoses": ("Condition",),
    "procedures": ("Procedure",),
    "prescriptions": ("MedicationRequest",),
    "billing": ("ExplanationOfBenefit", "Claim"),
}
USED_TYPES = tuple(sorted({t for types in TABLE_TYPES.values() for t in types}))
ROWS_PER_TASK = 200_000  # of what is sorted with its place
OTHER = "other"  # stands for all types that no table uses


# -- bundles to resources ------------------------------------------------------------
def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row per bundle file: (_src_file, bundle).  For small files; see ``bundles``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias(FILE), F.col("value").alias("bundle")
    )


def opened(texts: DataFrame) -> DataFrame:
    """Split bundles into (type, entries); ``sound`` is false for text that is no JSON.

    Entries are read as text, so one malformed entry does not lose the others.  Of a
    repeated key the last value counts, and no string is too long.
    """
    # A column of its own: as part of several expressions each of them would parse the text.
    texts = texts.select(
        FILE, "bundle", fx.shaped(F.col("bundle"), "resourceType string, entry array<string>").alias("shape")
    )
    shape = F.col("shape")
    is_object = F.ltrim(F.col("bundle")).startswith("{")
    listed = F.from_json(F.concat(F.lit("["), "bundle", F.lit("]")), "array<string>", fx.NO_LIMITS)
    sound = F.when(is_object, shape.getField(fx.MALFORMED).isNull()).otherwise(
        F.size(listed) == 1  # a list or a single value is JSON, too
    )
    return texts.select(
        FILE,
        F.coalesce(sound, F.lit(False)).alias("sound"),
        shape.getField("resourceType").alias("bundle_type"),
        shape.getField("entry").alias("entries"),
    )


def skipped(files: DataFrame) -> DataFrame:
    """(_src_file, reason) of the files that contribute nothing."""
    reason = (
        F.when(~F.col("sound"), "This is not JSON.")
        .when(~F.col("bundle_type").eqNullSafe(F.lit("Bundle")), "Not a bundle.")
        .when(F.col("n") <= 0, "Empty.")
    )
    return files.select(FILE, reason.alias("reason")).filter("reason is not null")


def resources_in(found: Bundles) -> DataFrame:
    """One row per object that the bundles hold as entries."""
    return _typed(
        found.entries.filter(_is_object(F.col("resource"))).select(
            FILE,
            F.lit(0).cast("bigint").alias(BLOCK),
            F.col(SEQUENCE).cast("bigint").alias(SEQUENCE),
            nonempty(F.col("full_url")).alias("full_url"),
            "resource",
        )
    )


def resources_of(texts: DataFrame) -> DataFrame:
    """One row per object that the bundles hold as entries' resources.

    Nothing is filtered on parsed values as rows: a pushed-down filter would parse the text
    again.  Entries without a resource object, which have no type, id or body, go within the
    list, before they are rows to be stored.  Most are told by their text, unparsed: values that
    do not fit cost an exception each.  An entry is read once, for its keys, and stays as it is:
    to write its resource as a text of its own would take two more readings.
    """
    listed = F.when(F.col("sound") & (F.col("bundle_type") == "Bundle"), F.col("entries"))
    entries = opened(texts).select(FILE, listed.alias("entries"))
    _last_key_wins(texts.sparkSession)

    def placed(entry: Column, place: Column) -> Column:
        # Objects among the entries have been written anew, without blanks or escapes in names.
        may_hold = F.ltrim(entry).startswith("{") & entry.contains('"resource":{')
        keys = F.when(may_hold, fx.shaped(entry, f"fullUrl string, {fx.in_entry(fx.KEY_MEMBERS)}"))
        return F.struct(place.cast("bigint").alias(SEQUENCE), entry.alias("entry"), keys.alias("e"))

    holding = F.filter(F.transform("entries", placed), lambda one: one["e"]["resource"].isNotNull())
    fits = F.col(f"e.{fx.MALFORMED}").isNull()
    return _with_keys(
        entries.select(FILE, F.inline(holding)).select(
            FILE,
            F.lit(0).cast("bigint").alias(BLOCK),
            SEQUENCE,
            nonempty(F.col("e.fullUrl")).alias("full_url"),
            "entry",
            F.col("e.resource").alias("body"),
            F.when(fits, F.lit(True)).otherwise(_last_is_sound(F.col("entry"))).alias("sound"),
        ),
        "entry",
    )


def _last_is_sound(entry: Column) -> Column:
    """Of an entry that did not fit: is the last value of its resource an object that does?"""
    last = F.from_json(entry, "resource string", fx.NO_LIMITS).getField("resource")
    others = fx.opened(last, [name for name in fx.KEY_MEMBERS if name != "resourceType"])
    return F.coalesce(_is_object(last) & others.getField(fx.MALFORMED).isNull(), F.lit(False))


def _is_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited resources: the form that splits and scales."""
    lines = with_file_origin(spark.read.text(path))
    return _typed(
        lines.select(*ORIGIN, F.lit(None).cast("string").alias("full_url"),
                     F.col("value").alias("resource"))
    )


def _typed(resources: DataFrame) -> DataFrame:
    """Type, keys and referable values of each resource; its text only if a table uses it."""
    _last_key_wins(resources.sparkSession)
    parsed = resources.select(
        *ORIGIN, "full_url", "resource", F.when(_is_object(F.col("resource")), fx.opened(F.col("resource"), fx.KEY_MEMBERS)).alias("body")
    )
    sound = F.col("body").isNotNull() & F.col(f"body.{fx.MALFORMED}").isNull()
    return _with_keys(parsed.withColumn("sound", sound), "resource")


def _with_keys(parsed: DataFrame, text: str) -> DataFrame:
    """The same of resources with an opened ``body``; ``text`` names the column of their texts."""
    sound, body = F.col("sound"), fx.Body("body")
    typed = parsed.select(
        *ORIGIN, "full_url", text, "sound",
        F.when(sound, fx.text_at(body, "$.resourceType")).alias("resource_type"),
        F.when(sound, fx.text_at(body, "$.id")).alias("id"),
        F.when(sound, fx.label_at(body, "$.code")).alias("label"),
        F.when(sound, fx.amount_text(body, "$.total.value")).alias("total_text"),
        F.when(sound, fx.amount(body, "$.total.value")).alias("total"),
    )
    used = F.col("resource_type").isin(*USED_TYPES)
    return typed.select(
        *ORIGIN,
        F.when(sound, F.col("full_url")).alias("full_url"),
        F.when(used, F.col("resource_type"))
        .when(F.col("resource_type").isNotNull(), OTHER).alias("resource_type"),
        "id", "label", "total_text", "total",
        F.when(used, F.col(text)).alias(text),
    )


def _last_key_wins(spark: SparkSession) -> None:
    """Of a repeated key inside a member the last value counts, as it does outside."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def staged(resources: DataFrame) -> DataFrame:
    """Write resources once, one folder per used type, so that every table reads only its own.

    Bodies stay text: a stored VARIANT may come back with whole numbers as decimals.  Each
    task keeps a file for each type open, so that no bodies are sorted by type.
    """
    resources.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", len(USED_TYPES) + 2)
    return stored(resources, "resources", partition_by=["resource_type"])


def of_type(resources: DataFrame, kind: str) -> DataFrame:
    """The resources of one type with their opened ``body``: the members its table uses.

    Their texts are those of the resources, or of the entries that hold them.
    """
    _last_key_wins(resources.sparkSession)
    if "entry" in resources.columns:
        body = fx.shaped(F.col("entry"), fx.in_entry(fx.MEMBERS[kind])).getField("resource")
    else:
        body = fx.opened(F.col("resource"), fx.MEMBERS[kind])
    return resources.filter(F.col("resource_type") == kind).withColumn("body", body)


def with_references(rows: DataFrame, value: Column | fx.Body, **paths: str) -> DataFrame:
    """Add the ids that references point to; each reference is looked up once per row."""
    found = rows.withColumns({f"{name}_at": fx.pick(value, f"{path}.reference", "variant") for name, path in paths.items()})
    written = found.withColumns({
        name: F.coalesce(fx.string_of(F.col(f"{name}_at")), fx.string_at(value, path)) for name, path in paths.items()
    })
    return written.withColumns({name: fx.referred_id(F.col(name)) for name in paths})


def with_amounts(rows: DataFrame, value: Column | fx.Body, **paths: str) -> DataFrame:
    """Add amounts as numbers and, as ``_text``, as written; each is looked up once per row."""
    found = rows.withColumns({
        column: part
        for name, path in paths.items()
        for column, part in (
            (name, fx.amount(value, path)),
            (f"{name}_as", fx.text_at(value, path)),
            (f"{name}_shape", F.schema_of_variant(fx.pick(value, path, "variant"))),
        )
    })
    return found.withColumns({
        f"{name}_text": fx.written_amount(F.col(f"{name}_shape"), F.col(name), F.col(f"{name}_as")) for name in paths
    })


def indexed(resources: DataFrame, wanted: DataFrame, **values: str) -> DataFrame:
    """(reference, values): what a reference resolves to, the last resource winning.

    ``wanted`` holds the references to be resolved; others are dropped before anything is
    grouped.  ``values`` names extracted columns, so no bodies are read.  A resource answers
    to its id.  A full URL counts where a reference can spell it: references are cut to the
    text after their last slash or after ``urn:uuid:``.
    """
    url = F.col("full_url")
    spelled = F.when(~url.contains("/") & ~url.startswith(fx.URN), url)
    own = F.when(F.col("resource_type").isNotNull(), nonempty(F.col("id")))
    keys = F.array_distinct(F.array_compact(F.array(spelled, own)))
    place = F.struct(*ORIGIN)
    asked = wanted.select("reference").filter("reference is not null").distinct()
    return (
        resources.select(
            F.explode(keys).alias("reference"),
            F.struct(place.alias("place"), *values.values()).alias("last"),
        )
        .join(asked, "reference", "left_semi")
        .groupBy("reference")
        .agg(F.max("last").alias("last"))
        .select(
            "reference",
            F.lit(True).alias("_found"),
            *[F.col(f"last.{column}").alias(name) for name, column in values.items()],
        )
    )


# -- resources to tables -------------------------------------------------------------

def patients(resources: DataFrame) -> DataFrame:
    body = fx.Body("body")
    named = of_type(resources, "Patient").withColumn("name", fx.official_name(body))
    gender = fx.text_at(body, "$.gender")
    return named.select(
        *ORIGIN,
        F.col("id").alias("patient_id"),
        fx.text_at(F.col("name"), "$.given[0]").alias("first_name"),
        fx.text_at(F.col("name"), "$.family").alias("last_name"),
        mapped(gender, FHIR_GENDERS, gender).alias("gender"),
        fx.date_at(body, "$.birthDate").alias("birth_date"),
        fx.text_at(body, "$.address[0].city").alias("city"),
        fx.text_at(body, "$.address[0].state").alias("state"),
        F.lit(None).cast("string").alias("insurance_provider"),
        fx.date_at(body, "$.meta.lastUpdated").alias("registration_date"),
    )


def encounters(resources: DataFrame) -> DataFrame:
    body = fx.Body("body")
    code = nonempty(fx.text_at(body, "$.class.code"))
    admission = mapped(
        code, FHIR_ENCOUNTER_CLASSES, F.when(code.isNotNull(), F.lit(FHIR_DEFAULT_ADMISSION))
    )
    rows = of_type(resources, "Encounter").withColumns({
        "_attending": fx.attending(body), "_period": fx.pick(body, "$.period", "struct<start: variant, end: variant>"),
    })
    rows = with_references(rows, body, patient_id="$.subject", department_id="$.serviceProvider")
    rows = with_references(rows, F.col("_attending"), provider_id="$")
    return rows.select(
        *ORIGIN,
        F.col("id").alias("encounter_id"),
        "patient_id", "provider_id", "department_id",
        fx.day_of(fx.string_of(F.col("_period.start"))).alias("admit_date"),
        fx.day_of(fx.string_of(F.col("_period.end"))).alias("discharge_date"),
        admission.alias("admission_type"),
        fx.label_at(body, "$.hospitalization.dischargeDisposition").alias(
            "discharge_disposition"
        ),
    )


def diagnoses(resources: DataFrame) -> DataFrame:
    """Conditions; the first encounter diagnosis of every encounter is the primary one.

    The primary's position is a pre-aggregated minimum per encounter, and rows are
    matched by position, so an encounter with very many conditions is no hot key.
    """
    body = fx.Body("body")
    code, description = fx.diagnosis_code(body)
    rows = stored(of_type(resources, "Condition").select(
        *ORIGIN,
        F.col("id").alias("diagnosis_id"),
        fx.reference_at(body, "$.encounter").alias("encounter_id"),
        code.alias("icd10_code"),
        description.alias("diagnosis_description"),
        F.coalesce(
            nonempty(fx.text_at(body, "$.onsetDateTime")),
            nonempty(fx.text_at(body, "$.recordedDate")),
            F.lit(""),
        ).alias("_since"),
        fx.is_encounter_diagnosis(body).alias("_candidate"),
    ), "conditions")
    primaries = (
        rows.filter(F.col("_candidate") & (F.col("encounter_id") != ""))
        .groupBy("encounter_id")
        .agg(F.min(F.struct("_since", *ORIGIN)).alias("first"))
        .select(*[F.col(f"first.{c}").alias(c) for c in ORIGIN],
                F.lit(True).alias("_primary"))
    )
    return rows.join(primaries, list(ORIGIN), "left").select(
        *ORIGIN, "diagnosis_id", "encounter_id", "icd10_code", "diagnosis_description",
        F.when(F.col("_primary"), "True").otherwise("False").alias("is_primary"),
    )


def procedures(resources: DataFrame) -> DataFrame:
    body = fx.Body("body")
    performed = F.coalesce(
        nonempty(fx.string_at(body, "$.performedDateTime")),
        fx.string_at(body, "$.performedPeriod.start"),
    )
    return with_references(of_type(resources, "Procedure"), body, encounter_id="$.encounter").select(
        *ORIGIN,
        F.col("id").alias("procedure_id"),
        "encounter_id",
        fx.label_at(body, "$.code").alias("procedure_name"),
        fx.day_of(performed).alias("procedure_date"),
    )


def prescriptions(resources: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Medication requests; a medication may be inline, another resource, or contained."""
    body = fx.Body("body")
    # Each step reads columns of the step before; as one expression it would be computed again
    # wherever it is mentioned, within the filter over contained resources for each of them.
    rows = of_type(resources, "MedicationRequest")
    opened = with_references(rows, body, encounter_id="$.encounter", _reference="$.medicationReference").select(
        *ORIGIN,
        F.col("id").alias("prescription_id"),
        "encounter_id",
        fx.label_at(body, "$.medicationCodeableConcept").alias("_label"),
        "_reference",
        fx.list_at(body, "$.contained").alias("_contents"),
        fx.label_at(body, "$.dosageInstruction[0].route").alias("route"),
    ).withColumn("reference", F.when(F.col("_label").isNull(), F.col("_reference")))
    contained = fx.first_where("_contents", lambda c: fx.text_at(c, "$.id") == F.substring("reference", 2, 1 << 30))
    requests = opened.withColumn(
        "_medication", F.when(F.col("reference").startswith("#"), contained)
    ).select(
        *ORIGIN, "prescription_id", "encounter_id", "_label", "reference",
        fx.label_at(F.col("_medication"), "$.code").alias("_contained"), "route",
    )
    rows = stored(requests, "requests")
    named = indexed(resources, rows, _name="label")
    resolved = lookup(rows, "reference", named, [F.col(c) for c in ORIGIN], limits)
    # A resource that was found but has no label does not fall back to contained ones.
    other = F.when(F.col("_found"), F.col("_name")).otherwise(F.col("_contained"))
    return resolved.select(
        *ORIGIN, "prescription_id", "encounter_id",
        F.coalesce("_label", other).alias("medication_name"), "route",
    )


def benefit_rows(resources: DataFrame) -> DataFrame:
    """What billing and insurers need from benefits, extracted once."""
    body = fx.Body("body")
    rows = of_type(resources, "ExplanationOfBenefit").withColumns({
        "_total": fx.submitted_total(body), "_shares": fx.patient_shares(body), "_items": fx.written_encounters(body),
    })
    rows = with_references(rows, body, reference="$.claim", _document="$.encounter", patient_id="$.patient")
    rows = with_amounts(rows, F.col("_total"), _submitted="$.amount.value")
    rows = with_amounts(rows, body, _insurance="$.payment.amount.value")
    return stored(rows.select(
        *ORIGIN,
        fx.billed_encounter(F.col("_items"), F.col("_document")).alias("encounter_id"),
        "reference", "_submitted_text", "_submitted", "_insurance_text", "_insurance",
        fx.patient_share(F.col("_shares")).alias("_patient"),
        nonempty(F.col("patient_id")).alias("patient_id"),
        fx.coverage_name(body).alias("payer"),
    ), "benefits")


def billing(
    resources: DataFrame, limits: Limits = DEFAULT_LIMITS, benefits: DataFrame | None = None
) -> DataFrame:
    """Benefits joined to their claims, then claims of encounters without a benefit.

    The rows get new places: all claims follow all benefits, whatever their files.
    """
    body = fx.Body("body")
    benefits = benefit_rows(resources) if benefits is None else benefits
    claimed = indexed(resources, benefits, _claimed_text="total_text", _claimed="total")
    position = [F.col(c) for c in ORIGIN]
    linked = lookup(benefits, "reference", claimed, position, limits)
    has_claimed = F.col("_claimed_text").isNotNull()
    total_text = F.when(has_claimed, F.col("_claimed_text")).otherwise(F.col("_submitted_text"))
    total = F.when(has_claimed, F.col("_claimed")).otherwise(F.col("_submitted"))
    paid_rows = linked.select(
        *ORIGIN,
        "encounter_id",
        total_text.alias("total_charge"),
        F.coalesce("_insurance_text", F.lit("0")).alias("insurance_paid"),
        F.coalesce(float_text(F.col("_patient")), F.lit("0")).alias("patient_paid"),
        fx.payment_status(
            total_text, total, F.col("_insurance_text"), F.col("_insurance"), F.col("_patient")
        ).alias("payment_status"),
    )
    claims = stored(of_type(resources, "Claim").select(
        *ORIGIN,
        nonempty(fx.claimed_encounter(body)).alias("encounter_id"),
        F.col("total_text").alias("total_charge"),
    ), "claims").filter(F.col("encounter_id").isNotNull())
    billed = (
        benefits.filter(F.col("encounter_id").isNotNull())
        .select("encounter_id").distinct().withColumn("_billed", F.lit(True))
    )
    bare = lookup(claims, "encounter_id", billed, position, limits).filter(
        F.col("_billed").isNull()
    )
    later = bare.select(
        *ORIGIN, "encounter_id", "total_charge",
        F.lit("0").alias("insurance_paid"),
        F.lit("0").alias("patient_paid"),
        F.lit("Pending").alias("payment_status"),
        F.lit(True).alias("_later"),
    )
    return in_one_order(paid_rows.withColumn("_later", F.lit(False)).unionByName(later), "_later")


def in_one_order(rows: DataFrame, *before: str) -> DataFrame:
    """The rows as if they came from one file: in order of ``before``, then of their places."""
    kept = [c for c in rows.columns if c not in (*ORIGIN, *before)]
    order = [F.col(c) for c in (*before, *ORIGIN)]
    return numbered(rows, order, "_number").select(
        F.lit("").alias(FILE),
        F.lit(0).cast("bigint").alias(BLOCK),
        (F.col("_number") - 1).alias(SEQUENCE),
        *kept,
    )


def with_insurance(
    patient_rows: DataFrame,
    resources: DataFrame,
    limits: Limits = DEFAULT_LIMITS,
    benefits: DataFrame | None = None,
) -> DataFrame:
    """Fill in the insurer from the coverage of a patient's latest benefit that names one."""
    benefits = benefit_rows(resources) if benefits is None else benefits
    payers = (
        benefits.filter(F.col("patient_id").isNotNull() & F.col("payer").isNotNull())
        .groupBy("patient_id")
        .agg(F.max_by("payer", F.struct(*ORIGIN)).alias("_payer"))
    )
    filled = lookup(
        patient_rows, "patient_id", payers, [F.col(c) for c in ORIGIN], limits
    )
    return filled.select(
        *[
            F.coalesce("_payer", c).alias(c) if c == "insurance_provider" else F.col(c)
            for c in patient_rows.columns
        ]
    )


def tasks_for(rows: DataFrame, copies: int = 1) -> int:
    """How many tasks share the work, so that none gets more rows however many there are."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * copies // ROWS_PER_TASK))


def surrogate_numbers(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(id, number, _rows): one number per id text, in order of first appearance.

    Appearance runs over tables, then id columns, then rows.  A table is read once for all its
    id columns, a bounded number of rows to a task: the first place of an id is found by sorting.
    """
    seen = []
    for table_at, rows in enumerate(tables.values()):
        ids = [c for c in rows.columns if c in ID_COLUMNS]
        spread = rows.select(*ORIGIN, *ids).repartition(tasks_for(rows), *ORIGIN)
        each = [
            F.struct(F.col(c).alias("id"), F.struct(F.lit(table_at).alias("t"), F.lit(at).alias("c"), *ORIGIN).alias("at"))
            for at, c in enumerate(rows.columns) if c in ID_COLUMNS
        ]
        seen += [spread.select(F.inline(F.array(*each))).filter("id is not null")] if ids else []
    first = (
        reduce(DataFrame.unionByName, seen)
        .groupBy("id")
        .agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("_rows"))
    )
    return numbered(first, [F.col("at")], "number").select("id", "number", "_rows")


def with_surrogate_keys(
    tables: Mapping[str, DataFrame], limits: Limits = DEFAULT_LIMITS
) -> dict[str, DataFrame]:
    """Replace the ids of all tables by shared whole numbers, as text.

    A small map is broadcast to the rows.  A large one meets the ids alone, all columns of
    a table in one join; rows are shuffled once, to get their numbers back.
    """
    numbers = surrogate_numbers(tables)
    if fits_broadcast(numbers, "id", limits):
        return {name: _numbered_by_broadcast(rows, numbers) for name, rows in tables.items()}
    hot = stored(most_frequent(numbers, "id", limits), "hot-ids")
    return {name: _numbered_by_position(rows, numbers, hot, limits) for name, rows in tables.items()}


def _numbered_by_broadcast(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    columns = rows.columns
    for column in [c for c in columns if c in ID_COLUMNS]:
        named = numbers.select(F.col("id").alias(column), F.col("number").cast("string").alias("_number"))
        joined = attach(rows, column, named, (), small=True)
        rows = joined.select(*[F.col("_number").alias(c) if c == column else F.col(c) for c in columns])
    return rows


def _numbered_by_position(rows: DataFrame, numbers: DataFrame, hot: DataFrame, limits: Limits) -> DataFrame:
    """Ids in long form (row, column, id), one join with the numbers, and back to columns."""
    ids = [c for c in rows.columns if c in ID_COLUMNS]
    placed = rows.withColumn("_row", F.struct(*ORIGIN))
    each = [F.struct(F.lit(place).alias("_column"), F.col(c).alias("id")) for place, c in enumerate(ids)]
    long = placed.select("_row", F.inline(F.array(*each))).filter("id is not null")
    named = numbers.select("id", F.col("number").alias("_number"))
    tasks = tasks_for(rows, len(ids))
    found = attach(long, "id", named, [F.col("_row"), F.col("_column")], hot, limits=limits, tasks=tasks)
    wide = found.repartition(tasks, "_row").groupBy("_row").agg(
        *[F.max(F.when(F.col("_column") == place, F.col("_number"))).alias(f"_n{place}") for place in range(len(ids))]
    )
    number_of = {c: f"_n{place}" for place, c in enumerate(ids)}
    return placed.repartition(tasks, "_row").join(wide, "_row", "left").select(
        *[F.col(number_of[c]).cast("string").alias(c) if c in number_of else F.col(c) for c in rows.columns]
    )


def tables_of(
    resources: DataFrame, limits: Limits = DEFAULT_LIMITS, merged: bool = False
) -> dict[str, DataFrame]:
    """The tables that have rows, with insurers and surrogate keys, in table order.

    Tables are stored before and after renumbering, so that bodies are parsed once and an
    audit reads finished columns.  ``merged`` counts rows through all files.
    """
    present = {
        row["resource_type"]
        for row in resources.filter(F.col("resource_type").isin(*USED_TYPES))
        .select("resource_type").distinct().collect()
    }
    benefits = benefit_rows(resources) if present & {"ExplanationOfBenefit", "Patient"} else None
    makers = {
        "patients": lambda: with_insurance(patients(resources), resources, limits, benefits),
        "encounters": lambda: encounters(resources),
        "diagnoses": lambda: diagnoses(resources),
        "procedures": lambda: procedures(resources),
        "prescriptions": lambda: prescriptions(resources, limits),
        "billing": lambda: billing(resources, limits, benefits),
    }
    if merged:
        makers = {name: partial(_made_in_one_order, make) for name, make in makers.items()}
    names = [name for name, types in TABLE_TYPES.items() if present & set(types)]
    tables = _stored_together({name: makers[name] for name in names})
    only_claims = "billing" in tables and "ExplanationOfBenefit" not in present
    if only_claims and tables["billing"].isEmpty():
        del tables["billing"]
    if not tables:
        raise CheckError(
            f"None of the resources makes a table (known types: {', '.join(USED_TYPES)})."
        )
    renumbered = with_surrogate_keys(tables, limits)
    return _stored_together({name: partial(dict.get, renumbered, name) for name in renumbered})


def _made_in_one_order(make: Callable[[], DataFrame]) -> DataFrame:
    return in_one_order(make())


def _stored_together(makers: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Write independent tables side by side."""
    with Workers(max_workers=max(len(makers), 1)) as pool:
        frames = pool.map(lambda name: stored(makers[name](), name), makers)
        return dict(zip(makers, frames))


def tables_of_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one bundle file; anything that is no usable bundle is an error."""
    found = bundles.read(spark, path, opened)
    shape = found.files.first()
    if shape is None or not shape["sound"]:
        raise CheckError("This is not JSON.")
    if shape["bundle_type"] != "Bundle":
        raise CheckError("This JSON is not a FHIR Bundle.")
    if shape["n"] <= 0:
        raise CheckError("The bundle is empty.")
    return tables_of(staged(resources_in(found)))


def tables_of_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of all ``*.json`` bundles of a folder, merged in file-name order."""
    return tables_of(staged(resources_in(bundles.read(spark, f"{folder}/*.json", opened))), merged=True)


def skipped_in_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder that ``tables_of_folder`` passes over, and why."""
    return skipped(bundles.read(spark, f"{folder}/*.json", opened).files)


def tables_of_ndjson(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables_of(staged(read_resources(spark, path)))
