"""Vocabulary, tables, constants and wording that define the results.

Everything here is a plain value that has to be exactly what it is for a report
to come out right.  No behaviour lives in this module.
"""

# --- quality dimensions, in report order --------------------------------------
DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "integrity")

# --- severities and their weight in the overall score ---------------------------
ERROR = "error"
WARNING = "warning"
SEVERITY_WEIGHTS = {"error": 1.0, "warning": 0.4}

# --- report constants -----------------------------------------------------------
SAMPLE_ROWS = 8            # offending rows shown per rule
NOT_NULL_SAMPLE_COLUMNS = 6  # columns shown for a missing value
FIRST_DATA_LINE = 2        # the header is line 1
IMPERFECT_CEILING = 99.9   # shown instead of 100 when anything failed
GRADES = ((97, "A+"), (93, "A"), (90, "A-"), (85, "B"), (75, "C"), (60, "D"))
LOWEST_GRADE = "F"

# --- missing and typed text -----------------------------------------------------
# Characters a blank cell may consist of (Unicode white space).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Cells that a CSV reader takes for a missing value (exact match, no trimming).
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
BOOLEAN_TOKENS = ("true", "false", "1", "0", "t", "f", "yes", "no")
TRUE_TOKENS = ("true", "1", "t", "yes")
INFINITY_TOKENS = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
# The representable date window of a nanosecond clock; dates outside it are unparseable.
EARLIEST_DATE = "1677-09-22"
LATEST_DATE = "2262-04-11"
ISO_DATE_PATTERN = r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"

# --- report wording -------------------------------------------------------------
MESSAGES = {
    "not_null": "'{column}' must not be blank or missing.",
    "unique": "Key {columns} must be unique; duplicate values found.",
    "allowed_values": "'{column}' must be one of: {preview}.",
    "regex": "'{column}' is malformed.",
    "regex_hint": "'{column}' is malformed. Expected {hint}.",
    "integer": "'{column}' must be an integer.",
    "number": "'{column}' must be {bounds}.",
    "boolean": "'{column}' must be a boolean (True/False).",
    "date": "'{column}' must be a valid, plausible date.",
    "foreign_key": "'{column}' must reference an existing {table}.{parent_column}.",
    "skipped": "Skipped: {reason}",
}
SKIP_REASONS = {
    "column": "column '{column}' not present in dataset",
    "columns": "column(s) {columns} not present",
    "parent_table": "reference table '{table}' not provided "
                    "(upload it together to check this link)",
    "parent_column": "'{parent_column}' missing from '{table}'",
}
ALLOWED_VALUES_PREVIEW = 8

# --- history --------------------------------------------------------------------
HISTORY_LIMIT = 500
TREND_LIMIT = 365
HISTORY_OFF_TOKENS = ("off", "0", "false", "no")

# --- intake limits --------------------------------------------------------------
MAX_INPUT_BYTES = 26_214_400
MAX_INPUT_ROWS = 500_000

# --- FHIR R4 --------------------------------------------------------------------
ICD10_SYSTEM = "http://hl7.org/fhir/sid/icd-10-cm"
SNOMED_SYSTEM = "http://snomed.info/sct"
ENCOUNTER_DIAGNOSIS = "encounter-diagnosis"
SUBMITTED_LABELS = ("Submitted Amount", "submitted")
PATIENT_SHARE = "coinsurance"
FHIR_GENDERS = {"male": "M", "female": "F"}
FHIR_ENCOUNTER_CLASSES = {
    "EMER": "Emergency", "IMP": "Elective", "ACUTE": "Urgent", "NONAC": "Elective",
    "AMB": "Elective", "OBSENC": "Elective", "PRENC": "Elective", "SS": "Elective",
    "VR": "Elective", "HH": "Elective",
}
FHIR_DEFAULT_ADMISSION = "Elective"
# Columns that carry resource ids and are renumbered together.
ID_COLUMNS = (
    "patient_id", "encounter_id", "provider_id", "department_id",
    "diagnosis_id", "procedure_id", "prescription_id",
)
PAYMENT_TOLERANCE = 0.01

# --- HL7 v2 ---------------------------------------------------------------------
HL7_SEGMENTS = ("MSH", "PID", "PV1")
HL7_ADMISSION_TYPES = {
    "E": "Emergency", "U": "Urgent", "C": "Elective", "N": "Newborn",
    "R": "Elective", "L": "Elective", "A": "Urgent",
}
HL7_PATIENT_CLASSES = {"E": "Emergency", "I": "Elective", "O": "Elective", "U": "Urgent"}
HL7_DISPOSITIONS = {
    "01": "Home", "02": "Transferred", "03": "Skilled Nursing Facility",
    "05": "Transferred", "06": "Home Health Care", "07": "Left Against Medical Advice",
    "20": "Expired", "62": "Rehabilitation",
}
