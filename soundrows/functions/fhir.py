"""Column functions over FHIR resources whose used members are VARIANT values.

Paths that do not exist, or lead through a value of another shape, give NULL, so
malformed resources flow through instead of failing a job.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundrows.fixed_values import (
    ENCOUNTER_DIAGNOSIS,
    ICD10_SYSTEM,
    PATIENT_SHARE,
    PAYMENT_TOLERANCE,
    SNOMED_SYSTEM,
    SUBMITTED_LABELS,
)
from soundrows.functions.text import float_text, nonempty

URN = "urn:uuid:"
#: The members that tell what a resource is and what others may refer to.
KEY_MEMBERS = ("resourceType", "id", "code", "total")
#: The members that tables use, by type of resource.
MEMBERS = {
    "Patient": ("name", "gender", "birthDate", "address", "meta"),
    "Encounter": ("class", "subject", "participant", "serviceProvider", "period", "hospitalization"),
    "Condition": ("encounter", "code", "onsetDateTime", "recordedDate", "category"),
    "Procedure": ("encounter", "code", "performedDateTime", "performedPeriod"),
    "MedicationRequest": (
        "encounter", "medicationCodeableConcept", "medicationReference", "contained", "dosageInstruction",
    ),
    "ExplanationOfBenefit": ("claim", "encounter", "item", "total", "payment", "patient", "contained"),
    "Claim": ("item", "encounter"),
}
#: Nothing in a file is too long to be read.
NO_LIMITS = {
    "maxStringLen": str((1 << 31) - 1),
    "maxNumLen": str((1 << 31) - 1),
    "maxNestingDepth": "1000000",
}
MALFORMED = "_malformed"


def shaped(text: Column, shape: str) -> Column:
    """JSON text as a struct; ``_malformed`` holds text that is no JSON object."""
    options = {**NO_LIMITS, "columnNameOfCorruptRecord": MALFORMED}
    return F.from_json(text, f"{shape}, {MALFORMED} string", options)


def variants(members: Sequence[str]) -> str:
    return ", ".join(f"`{name}` variant" for name in members)


def opened(resource: Column, members: Sequence[str]) -> Column:
    """Members of a resource, each a VARIANT; all others are skipped unread."""
    return shaped(resource, variants(members))


def in_entry(members: Sequence[str]) -> str:
    """The shape of the same members within an entry of a bundle."""
    return f"resource struct<{variants(members)}>"


class Body:
    """An opened resource: paths begin with the name of a member."""

    def __init__(self, column: str):
        self.column = column

    def split(self, path: str) -> tuple[Column, str]:
        name, rest = re.match(r"\$\.(\w+)(.*)", path).groups()
        return F.col(self.column).getField(name), f"${rest}"


def pick(value: Column | Body, path: str, kind: str) -> Column:
    """What a path leads to, as a type; NULL where it is not there or does not fit.

    Objects are read as structs that have the wanted member.  A path with names would give the
    same, but by an exception in each row without the member, which costs more than parsing.
    """
    if isinstance(value, Body):
        value, path = value.split(path)
    steps = [step for step in re.findall(r"((?:\[\d+\])?)((?:\.\w+)*)", path[1:]) if any(step)] or [("", "")]
    for at, (place, names) in enumerate(steps, 1):
        members = names.split(".")[1:]
        shape = kind if at == len(steps) else "variant"
        for name in reversed(members):
            shape = f"struct<`{name}`: {shape}>"
        value = reduce(Column.getField, members, F.try_variant_get(value, f"${place}", shape))
    return value


def text_at(value: Column | Body, path: str) -> Column:
    return pick(value, path, "string")


def string_at(value: Column | Body, path: str) -> Column:
    """A JSON string; NULL for numbers, lists and objects."""
    is_string = F.schema_of_variant(pick(value, path, "variant")) == "STRING"
    return F.when(is_string, text_at(value, path))


def string_of(found: Column) -> Column:
    """The same of a VARIANT that is a column already, so that nothing is looked up again."""
    return F.when(F.schema_of_variant(found) == "STRING", text_at(found, "$"))


def list_at(value: Column | Body, path: str) -> Column:
    """The items of a JSON list; an empty array when there is no list."""
    return F.coalesce(
        pick(value, path, "array<variant>"),
        F.array().cast("array<variant>"),
    )


def is_object(value: Column) -> Column:
    return F.coalesce(text_at(value, "$").startswith("{"), F.lit(False))


def date_at(value: Column, path: str) -> Column:
    """The day of a FHIR date or dateTime, which is a JSON string."""
    return day_of(string_at(value, path))


def day_of(stamp: Column) -> Column:
    """The first ten characters; a day in a year of more than four digits is longer."""
    return nonempty(F.regexp_extract(stamp, r"(?s)^(?:[0-9]{5,}-[0-9]{2}-[0-9]{2}|.{0,10})", 0))


def written_reference(value: Column | Body, path: str) -> Column:
    """A reference as it is written: a reference object's text, or a plain string."""
    return F.coalesce(string_at(value, f"{path}.reference"), string_at(value, path))


def referred_id(written: Column) -> Column:
    """The id that a written reference points to."""
    return (
        F.when(written == "", F.lit(None).cast("string"))
        .when(written.startswith(URN), F.substring(written, len(URN) + 1, 1 << 30))
        .otherwise(F.substring_index(written, "/", -1))
    )


def reference_at(value: Column | Body, path: str) -> Column:
    """The id a reference points to: a reference object, or a plain string."""
    return referred_id(written_reference(value, path))


def label_at(value: Column, path: str) -> Column:
    """The human label of a CodeableConcept: its text, else its first coding."""
    return F.coalesce(
        nonempty(text_at(value, f"{path}.text")),
        nonempty(text_at(value, f"{path}.coding[0].display")),
        text_at(value, f"{path}.coding[0].code"),
    )


def first_where(items: Column, condition) -> Column:
    return F.get(F.filter(items, condition), F.lit(0))


def official_name(patient: Column) -> Column:
    """The official name, else the first one; items that are not objects are ignored."""
    names = F.filter(list_at(patient, "$.name"), is_object)
    official = first_where(names, lambda n: text_at(n, "$.use") == "official")
    return F.coalesce(official, F.get(names, F.lit(0)))


def attending(encounter: Column | Body) -> Column:
    """The first individual that a participant names; a VARIANT.

    All participants are looked up at once.  Nothing is written as JSON to tell whether it is there.
    """
    return first_where(
        pick(encounter, "$.participant", "array<struct<individual: variant>>"),
        lambda p: p["individual"].isNotNull() & ~F.is_variant_null(p["individual"]),
    )["individual"]


def diagnosis_code(condition: Column) -> tuple[Column, Column]:
    """(code, description): an ICD-10-CM coding, else SNOMED, else the first coding."""
    codings = list_at(condition, "$.code.coding")
    text = text_at(condition, "$.code.text")

    def coding_of(system: str) -> Column:
        return first_where(codings, lambda c: text_at(c, "$.system") == system)

    known = F.coalesce(coding_of(ICD10_SYSTEM), coding_of(SNOMED_SYSTEM))
    first = F.get(codings, F.lit(0))
    code = text_at(F.coalesce(known, first), "$.code")
    description = F.when(
        known.isNotNull(), F.coalesce(nonempty(text_at(known, "$.display")), text)
    ).otherwise(F.coalesce(nonempty(text), text_at(first, "$.display")))
    return code, description


def is_encounter_diagnosis(condition: Column) -> Column:
    return F.coalesce(
        F.exists(
            list_at(condition, "$.category"),
            lambda category: F.exists(
                list_at(category, "$.coding"),
                lambda coding: F.coalesce(
                    text_at(coding, "$.code") == ENCOUNTER_DIAGNOSIS, F.lit(False)
                ),
            ),
        ),
        F.lit(False),
    )


def amount_text(value: Column, path: str) -> Column:
    """An amount as written: whole numbers stay whole, others show as floats."""
    shape = F.schema_of_variant(pick(value, path, "variant"))
    return written_amount(shape, amount(value, path), text_at(value, path))


def written_amount(shape: Column, number: Column, text: Column) -> Column:
    fractional = shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT")
    return F.when(fractional, float_text(number)).otherwise(text)


def amount(value: Column, path: str) -> Column:
    return pick(value, path, "double")


def written_encounters(benefit: Column) -> Column:
    """The encounter that each item names, as it is written."""
    return F.transform(
        list_at(benefit, "$.item"), lambda item: written_reference(item, "$.encounter[0]")
    )


def billed_encounter(of_items: Column, of_document: Column) -> Column:
    """The encounter of the first item that has one, else of the whole document."""
    named = F.transform(of_items, lambda written: nonempty(referred_id(written)))
    return F.coalesce(F.get(F.array_compact(named), F.lit(0)), of_document)


def claimed_encounter(claim: Column) -> Column:
    return F.coalesce(
        nonempty(reference_at(claim, "$.item[0].encounter[0]")),
        reference_at(claim, "$.encounter"),
    )


def submitted_total(benefit: Column) -> Column:
    """The first total that is labelled as submitted."""
    return first_where(
        list_at(benefit, "$.total"),
        lambda total: F.coalesce(
            label_at(total, "$.category").isin(*SUBMITTED_LABELS), F.lit(False)
        ),
    )


def patient_shares(benefit: Column) -> Column:
    """The adjudicated amounts the patient owes."""
    adjudications = F.flatten(
        F.transform(list_at(benefit, "$.item"), lambda item: list_at(item, "$.adjudication"))
    )

    def is_share(entry: Column) -> Column:
        last = F.try_element_at(list_at(entry, "$.category.coding"), F.lit(-1))
        words = F.concat_ws(
            "\n",
            F.lower(label_at(entry, "$.category")),
            F.lower(text_at(last, "$.code")),
        )
        return words.contains(PATIENT_SHARE) & amount(entry, "$.amount.value").isNotNull()

    return F.transform(
        F.filter(adjudications, is_share), lambda entry: amount(entry, "$.amount.value")
    )


def patient_share(shares: Column) -> Column:
    """Sum of what the patient owes; NULL when there is none."""
    summed = F.aggregate(shares, F.lit(0.0), lambda total, share: total + share)
    return F.when(F.size(shares) > 0, F.bround(summed, 2))


def payment_status(
    total_text: Column, total: Column, insurance_text: Column, insurance: Column,
    patient: Column,
) -> Column:
    unreadable = (total_text.isNotNull() & total.isNull()) | (
        nonempty(insurance_text).isNotNull() & insurance.isNull()
    )
    owed = F.coalesce(total, F.lit(0.0))
    paid = F.coalesce(insurance, F.lit(0.0)) + F.coalesce(patient, F.lit(0.0))
    return (
        F.when(unreadable | (owed <= 0), "Pending")
        .when(paid >= owed - PAYMENT_TOLERANCE, "Paid")
        .when(paid > 0, "Partially Paid")
        .otherwise("Pending")
    )


def coverage_name(benefit: Column) -> Column:
    """The first contained coverage that names a payer or a type."""
    names = F.transform(
        F.filter(
            list_at(benefit, "$.contained"),
            lambda c: F.coalesce(text_at(c, "$.resourceType") == "Coverage", F.lit(False)),
        ),
        lambda c: nonempty(
            F.coalesce(nonempty(text_at(c, "$.payor[0].display")), label_at(c, "$.type"))
        ),
    )
    return F.get(F.array_compact(names), F.lit(0))
