"""The built-in catalogue: eight tables of a health-record extract, 94 rules.

The catalogue is data.  Rule ids, titles, allowed words, patterns and bounds are
fixed values: they appear in reports as they stand here.
"""

from __future__ import annotations

from soundrows.fixed_values import WARNING
from soundrows.operators.cells import Cells
from soundrows.plans.profile import Registry, profile_from

ICD10_CODE = r"^[A-TV-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$"
STATE_CODE = r"^[A-Z]{2}$"
LONGEST_LIFE_DAYS = 120 * 365.25
LONGEST_STAY_DAYS = 365
PAYMENT_SLACK = 0.01


def born_after_registration(cells: Cells):
    return cells.date("birth_date") > cells.date("registration_date")


def implausibly_old(cells: Cells):
    return cells.days_until_as_of("birth_date") > LONGEST_LIFE_DAYS


def left_before_arrival(cells: Cells):
    return cells.date("discharge_date") < cells.date("admit_date")


def implausibly_long_stay(cells: Cells):
    return cells.days_between("discharge_date", "admit_date") > LONGEST_STAY_DAYS


def paid_too_much(cells: Cells):
    paid = cells.number("insurance_paid") + cells.number("patient_paid")
    return paid > cells.number("total_charge") + PAYMENT_SLACK


def _link_to_encounter():
    return ("foreign_key", "fk.encounter", "encounter_id links to an encounter",
            dict(column="encounter_id", parent_table="encounters",
                 parent_column="encounter_id"))


def _id_rules(column):
    return [
        ("unique", "unique.id", f"{column} must be unique", dict(columns=column)),
        ("integer", "int.id", f"{column} must be an integer", dict(column=column)),
    ]


TABLES = {
    "departments": dict(
        title="Departments",
        description="Where care is given: the departments that other tables name.",
        id_column="department_id",
        detect=["department_id", "department_name", "department_type", "floor"],
        required=["department_id", "department_name", "department_type", "floor"],
        rules=[
            *_id_rules("department_id"),
            ("integer", "int.floor", "floor must be an integer", dict(column="floor")),
            ("allowed_values", "enum.type", "department_type is recognised",
             dict(column="department_type", severity=WARNING,
                  allowed=["Inpatient", "Outpatient", "Emergency", "Surgical", "Diagnostic"])),
        ],
    ),
    "providers": dict(
        title="Providers",
        description="Who gives care, and in which department.",
        id_column="provider_id",
        detect=["provider_id", "first_name", "last_name", "specialty", "department_id"],
        parents=["departments"],
        required=["provider_id", "first_name", "last_name", "specialty", "department_id",
                  "hire_date"],
        rules=[
            *_id_rules("provider_id"),
            ("integer", "int.dept", "department_id must be an integer",
             dict(column="department_id")),
            ("date", "date.hire", "hire_date is a valid past date",
             dict(column="hire_date", min_date="1950-01-01")),
            ("foreign_key", "fk.dept", "department_id links to a department",
             dict(column="department_id", parent_table="departments",
                  parent_column="department_id")),
        ],
    ),
    "patients": dict(
        title="Patients",
        description="Who receives care: person, place and insurer.",
        id_column="patient_id",
        detect=["patient_id", "first_name", "last_name", "gender", "birth_date"],
        required=["patient_id", "first_name", "last_name", "gender", "birth_date", "city",
                  "state", "insurance_provider", "registration_date"],
        rules=[
            *_id_rules("patient_id"),
            ("allowed_values", "enum.gender", "gender is M or F",
             dict(column="gender", allowed=["M", "F"])),
            ("regex", "regex.state", "state is a 2-letter code",
             dict(column="state", pattern=STATE_CODE, severity=WARNING,
                  hint="a 2-letter US state code")),
            ("date", "date.birth", "birth_date is valid and not in the future",
             dict(column="birth_date", min_date="1900-01-01")),
            ("date", "date.registration", "registration_date is valid and not future",
             dict(column="registration_date", min_date="1990-01-01")),
            ("consistency", "consistency.birth_before_registration",
             "birth_date must be on or before registration_date",
             dict(violation=born_after_registration,
                  columns=["birth_date", "registration_date"])),
            ("consistency", "consistency.plausible_age", "patient age must be under 120 years",
             dict(violation=implausibly_old, columns=["birth_date"], severity=WARNING)),
        ],
    ),
    "encounters": dict(
        title="Encounters",
        description="Stays and visits, which most other tables refer to.",
        id_column="encounter_id",
        detect=["encounter_id", "patient_id", "provider_id", "admit_date", "discharge_date"],
        parents=["patients", "providers", "departments"],
        required=["encounter_id", "patient_id", "provider_id", "department_id", "admit_date",
                  "discharge_date", "admission_type", "discharge_disposition"],
        rules=[
            *_id_rules("encounter_id"),
            ("date", "date.admit", "admit_date is a valid date", dict(column="admit_date")),
            ("date", "date.discharge", "discharge_date is a valid date",
             dict(column="discharge_date")),
            ("allowed_values", "enum.admission", "admission_type is recognised",
             dict(column="admission_type",
                  allowed=["Emergency", "Elective", "Urgent", "Newborn"])),
            ("allowed_values", "enum.disposition", "discharge_disposition is recognised",
             dict(column="discharge_disposition", severity=WARNING,
                  allowed=["Home", "Home Health Care", "Skilled Nursing Facility",
                           "Rehabilitation", "Transferred", "Left Against Medical Advice",
                           "Expired"])),
            ("consistency", "consistency.discharge_after_admit",
             "discharge_date must be on or after admit_date",
             dict(violation=left_before_arrival, columns=["admit_date", "discharge_date"])),
            ("consistency", "consistency.los_plausible",
             "length of stay must be 365 days or fewer",
             dict(violation=implausibly_long_stay, columns=["admit_date", "discharge_date"],
                  severity=WARNING)),
            ("foreign_key", "fk.patient", "patient_id links to a patient",
             dict(column="patient_id", parent_table="patients", parent_column="patient_id")),
            ("foreign_key", "fk.provider", "provider_id links to a provider",
             dict(column="provider_id", parent_table="providers",
                  parent_column="provider_id")),
            ("foreign_key", "fk.dept", "department_id links to a department",
             dict(column="department_id", parent_table="departments",
                  parent_column="department_id")),
        ],
    ),
    "diagnoses": dict(
        title="Diagnoses",
        description="Coded findings of a visit, one of them the main one.",
        id_column="diagnosis_id",
        detect=["diagnosis_id", "encounter_id", "icd10_code", "is_primary"],
        parents=["encounters"],
        required=["diagnosis_id", "encounter_id", "icd10_code", "diagnosis_description",
                  "is_primary"],
        rules=[
            *_id_rules("diagnosis_id"),
            ("regex", "regex.icd10", "icd10_code is a valid ICD-10 code",
             dict(column="icd10_code", pattern=ICD10_CODE,
                  hint="an ICD-10-CM code such as 'S72.0' or 'E11.9'")),
            ("boolean", "bool.primary", "is_primary is a boolean", dict(column="is_primary")),
            _link_to_encounter(),
            ("exactly_one", "consistency.one_primary",
             "each encounter must have exactly one primary diagnosis",
             dict(group="encounter_id", marker="is_primary", severity=WARNING)),
        ],
    ),
    "procedures": dict(
        title="Procedures",
        description="What was done on a visit.",
        id_column="procedure_id",
        detect=["procedure_id", "encounter_id", "procedure_name", "procedure_date"],
        parents=["encounters"],
        required=["procedure_id", "encounter_id", "procedure_name", "procedure_date"],
        rules=[
            *_id_rules("procedure_id"),
            ("date", "date.performed", "procedure_date is a valid date",
             dict(column="procedure_date")),
            _link_to_encounter(),
        ],
    ),
    "prescriptions": dict(
        title="Prescriptions",
        description="What was prescribed on a visit.",
        id_column="prescription_id",
        detect=["prescription_id", "encounter_id", "medication_name", "route"],
        parents=["encounters"],
        required=["prescription_id", "encounter_id", "medication_name", "route"],
        rules=[
            *_id_rules("prescription_id"),
            ("allowed_values", "enum.route", "route is recognised",
             dict(column="route", severity=WARNING,
                  allowed=["Oral", "Injection", "Inhalation", "IV", "IM", "Topical",
                           "Subcutaneous"])),
            _link_to_encounter(),
        ],
    ),
    "billing": dict(
        title="Billing",
        description="What a visit cost and who paid.",
        id_column="encounter_id",
        detect=["encounter_id", "total_charge", "insurance_paid", "patient_paid",
                "payment_status"],
        parents=["encounters"],
        required=["encounter_id", "total_charge", "insurance_paid", "patient_paid",
                  "payment_status"],
        rules=[
            ("unique", "unique.id", "encounter_id must be unique (one bill per encounter)",
             dict(columns="encounter_id")),
            ("number", "num.total", "total_charge must be >= 0",
             dict(column="total_charge", min_value=0)),
            ("number", "num.insurance", "insurance_paid must be >= 0",
             dict(column="insurance_paid", min_value=0)),
            ("number", "num.patient", "patient_paid must be >= 0",
             dict(column="patient_paid", min_value=0)),
            ("allowed_values", "enum.status", "payment_status is recognised",
             dict(column="payment_status",
                  allowed=["Paid", "Partially Paid", "Pending", "Written Off"])),
            ("consistency", "consistency.not_overpaid",
             "payments must not exceed the total charge",
             dict(violation=paid_too_much, severity=WARNING,
                  columns=["total_charge", "insurance_paid", "patient_paid"])),
            _link_to_encounter(),
        ],
    ),
}


def clinical_registry() -> Registry:
    """A fresh registry of the eight built-in tables; register more on it freely."""
    return Registry(profile_from(key, spec) for key, spec in TABLES.items())
