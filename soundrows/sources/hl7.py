"""HL7 v2 ADT feeds flattened into patients and encounters.

A feed is read line by line, so large files split.  Every visit segment belongs to the
latest patient segment above it in its file, also across messages: the carry runs
inside each block, and one summary row per block hands it to the next block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundrows.errors import CheckError
from soundrows.fixed_values import (
    HL7_ADMISSION_TYPES,
    HL7_DISPOSITIONS,
    HL7_PATIENT_CLASSES,
    HL7_SEGMENTS,
)
from soundrows.functions import hl7 as hx
from soundrows.functions.text import mapped, nonempty, strip
from soundrows.operators.keyed import DEFAULT_LIMITS, attach, fits_broadcast
from soundrows.session import durable, stored
from soundrows.sources.origin import BLOCK, FILE, ORIGIN, SEQUENCE, with_file_origin


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a feed with their origin; UTF-8, or Latin-1 where a file is not."""
    lines = with_file_origin(spark.read.text(path))
    foreign = durable(
        lines.groupBy(FILE)
        .agg(F.bool_and(F.is_valid_utf8("value")).alias("_utf8"))
        .filter(~F.col("_utf8"))
    )
    if foreign.isEmpty():
        return lines
    marked = attach(
        lines, FILE, foreign, [F.col(c) for c in ORIGIN],
        small=fits_broadcast(foreign, FILE, DEFAULT_LIMITS),
    )
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return marked.select(
        *ORIGIN,
        F.when(F.col("_utf8").isNull(), F.col("value")).otherwise(latin).alias("value"),
    )


def segments_of(lines: DataFrame) -> DataFrame:
    """Known segments: (origin, kind, segment).  Blank lines are no segments."""
    segment = strip(F.col("value"))
    return lines.select(
        *ORIGIN, F.substring_index(segment, "|", 1).alias("kind"), segment.alias("segment")
    ).filter(F.col("kind").isin(*HL7_SEGMENTS))


def patients(segments: DataFrame) -> DataFrame:
    fields = F.col("fields")
    sex = hx.code(fields, 8)
    return with_fields(segments.filter("kind = 'PID'")).select(
        *ORIGIN,
        hx.component(fields, 3, 0).alias("patient_id"),
        hx.component(fields, 5, 1).alias("first_name"),
        hx.component(fields, 5, 0).alias("last_name"),
        nonempty(sex).alias("gender"),
        hx.day(fields, 7).alias("birth_date"),
        hx.component(fields, 11, 2).alias("city"),
        hx.component(fields, 11, 3).alias("state"),
        F.lit(None).cast("string").alias("insurance_provider"),
        hx.day(fields, 33).alias("registration_date"),
    )


def encounters(segments: DataFrame) -> DataFrame:
    fields = F.col("fields")
    leaving = hx.code(fields, 36)
    visits = {
        "encounter_id": hx.component(fields, 19, 0),
        "provider_id": hx.component(fields, 7, 0),
        "department_id": hx.component(fields, 3, 0),
        "admit_date": hx.day(fields, 44),
        "discharge_date": hx.day(fields, 45),
        "admission_type": F.coalesce(
            mapped(hx.code(fields, 4), HL7_ADMISSION_TYPES),
            mapped(hx.code(fields, 2), HL7_PATIENT_CLASSES),
        ),
        "discharge_disposition": mapped(leaving, HL7_DISPOSITIONS, nonempty(leaving)),
    }
    is_visit = F.col("kind") == "PV1"
    # Only the finished columns are shuffled, not whole segments.
    rows = with_fields(segments.filter("kind IN ('PID', 'PV1')")).select(
        *ORIGIN,
        "kind",
        F.when(~is_visit, F.struct(hx.component(fields, 3, 0).alias("id"))).alias("_own"),
        *[F.when(is_visit, value).alias(name) for name, value in visits.items()],
    )
    return with_latest_patient(rows).select(
        *ORIGIN, "encounter_id", "patient_id", *[c for c in visits if c != "encounter_id"]
    )


def with_fields(segments: DataFrame) -> DataFrame:
    return segments.withColumn("fields", hx.fields_of(F.col("segment")))


def with_latest_patient(rows: DataFrame) -> DataFrame:
    """Visits with the ``patient_id`` of the latest patient segment above them.

    ``_own`` is set on patient segments, also on those without an id: they reset the
    carry to NULL.
    """
    place = [FILE, BLOCK]
    above = (
        Window.partitionBy(*place)
        .orderBy(SEQUENCE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier_blocks = (
        Window.partitionBy(FILE)
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    handed_on = (
        rows.groupBy(*place)
        .agg(F.max_by("_own", F.when(F.col("kind") == "PID", F.col(SEQUENCE))).alias("_last"))
        .select(*place, F.last("_last", ignorenulls=True).over(earlier_blocks).alias("_before"))
    )
    carried = rows.withColumn("_inside", F.last("_own", ignorenulls=True).over(above))
    latest = F.coalesce("_inside", "_before").getField("id")
    return (
        carried.filter("kind = 'PV1'")
        .join(handed_on, place, "left")
        .withColumn("patient_id", latest)
    )


def tables_of(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables that have rows, materialised.

    Segments are stored once by kind, so the feed itself is read once.
    """
    segments = stored(segments_of(lines), "segments", partition_by=["kind"])
    kinds = {row["kind"] for row in segments.select("kind").distinct().collect()}
    if not kinds:
        raise CheckError(f"The feed has no segment of the kinds {', '.join(HL7_SEGMENTS)}.")
    tables = {}
    if "PID" in kinds:
        tables["patients"] = stored(patients(segments), "patients")
    if "PV1" in kinds:
        tables["encounters"] = stored(encounters(segments), "encounters")
    if not tables:
        raise CheckError("The feed has neither patients nor visits.")
    return tables


def tables_of_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables_of(read_feed(spark, path))
