"""CSV scan in which every cell is text."""

from __future__ import annotations

import csv as csv_format
import io
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundrows.errors import CheckError
from soundrows.functions.text import without_na_tokens
from soundrows.session import stored
from soundrows.sources.origin import BLOCK, FILE, ORIGIN, SEQUENCE, with_file_origin
from soundrows.sources.records import RECORD as RECORD_TEXT
from soundrows.sources.records import Records, split_records

BOM = "\ufeff"

RECORD = "_record"
PARSE_ERROR = "Could not parse CSV"


def unique_names(cells: list[str]) -> list[str]:
    """Names for all columns: later ones of equal names get the next free number."""
    names = [name or f"Unnamed: {n}" for n, name in enumerate(cells)]
    taken = set(names)
    seen: Counter[str] = Counter()
    unique = []
    for name in names:
        number, shown = seen[name], name
        while number and (shown := f"{name}.{number}") in taken:
            number += 1
        taken.add(shown)
        seen[name] = number + 1
        unique.append(shown)
    return unique


def without_quoted_cells(line: Column) -> Column:
    """What is left of a line when its complete quoted cells become empty."""
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), r'(^|,)"[^"]*"(?=,|$)', "$1")


@dataclass(frozen=True)
class Survey:
    """What one look at all lines tells.

    ``files``: name, header line and whether a line ends inside a quoted cell (broken).
    """

    headers: list[str]  # two different ones at most
    files: DataFrame

    @property
    def broken(self) -> list[str]:
        """Names of the files with line breaks in cells."""
        return [r[FILE] for r in self.files.filter("broken").select(FILE).orderBy(FILE).collect()]

    @property
    def any_broken(self) -> bool:
        return self.files.filter("broken").limit(1).count() > 0


def survey(spark: SparkSession, path: str) -> Survey:
    """Read all lines once."""
    lines = with_file_origin(spark.read.text(path))
    text = F.when(F.trim("value") != "", F.col("value"))
    opened = without_quoted_cells(F.col("value")).rlike('(^|,)"')  # and closed further down
    files = stored(
        lines.groupBy(FILE).agg(
            F.min_by(text, F.when(text.isNotNull(), F.struct(BLOCK, SEQUENCE))).alias("header"),
            F.max(opened).alias("broken"),
        ).filter("header is not null"),
        "csv-files",
    )
    headers = distinct_headers(files, "header")
    if not headers:
        raise CheckError(f"{PARSE_ERROR}: No columns to parse from file")
    return Survey(headers, files)


def distinct_headers(files: DataFrame, column: str) -> list[str]:
    """The header of all files; files of a folder must have the same one."""
    bare = F.ltrim(column, F.lit(BOM)).alias("header")
    headers = files.groupBy(bare).agg(F.min(FILE).alias(FILE)).take(2)
    if len(headers) > 1:
        shown = " and ".join(sorted(h[FILE] for h in headers))
        raise CheckError(f"{PARSE_ERROR}: {shown} have different headers")
    return [h["header"] for h in headers]


@dataclass(frozen=True)
class Source:
    """Column names, and the records when line breaks inside cells are read in blocks."""

    names: list[str]
    records: Records | None = None
    multi_line: bool = False


def source_of(spark: SparkSession, path: str, multi_line: bool | None) -> Source:
    found = survey(spark, path)
    broken = found.any_broken
    if multi_line is None and broken:
        records = split_records(spark, path)
        if records is not None:
            [header] = distinct_headers(records.headers, RECORD_TEXT)
            return Source(cells_of(header), records)
        multi_line = True
    if multi_line and broken:  # the header itself may have line breaks
        first = quoted(spark.read.option("multiLine", True)).csv(path).first()
        return Source(unique_names([(cell or "").removeprefix(BOM) for cell in first]), None, True)
    return Source(cells_of(found.headers[0]), None, bool(multi_line))


def cells_of(header: str) -> list[str]:
    return unique_names(next(csv_format.reader(io.StringIO(header, newline="")), []))


def quoted(options):
    """Two quotes inside a quoted cell are one."""
    return options.option("escape", '"')


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of a file, or of the files of a folder."""
    return source_of(spark, path, None).names


def read_csv(
    spark: SparkSession,
    path: str,
    strip_header: bool = True,
    multi_line: bool | None = None,
    origin: bool = False,
) -> DataFrame:
    """Read a CSV file or folder as text columns.

    Missing-value words become NULL; blank lines are skipped; short rows are padded.
    A row with more cells than the header fails the job that meets it, also when the
    surplus cells are empty.  A quote inside a cell opens nothing.

    Files with line breaks inside quotes are read in blocks, too (see ``records``);
    ``multi_line`` makes the reader take every file as one block instead, which also happens
    where carriage returns stand inside lines.  ``origin`` adds where rows come from.
    """
    source = source_of(spark, path, multi_line)
    names = source.names
    positions = [f"_c{n}" for n in range(len(names))]
    schema = T.StructType([T.StructField(p, T.StringType()) for p in [*positions, RECORD]])
    where = ORIGIN if origin else ()
    if source.records is None:
        reader = quoted(spark.read.schema(schema)).option("header", True).option("columnNameOfCorruptRecord", RECORD)
        rows = reader.option("multiLine", source.multi_line).csv(path)
        rows = with_file_origin(rows) if origin else rows
    else:
        options = {"escape": '"', "columnNameOfCorruptRecord": RECORD, "multiLine": "true"}
        cells = F.from_csv(RECORD_TEXT, ", ".join(f"{p} string" for p in schema.names), options)
        rows = source.records.rows.select(*where, cells.alias("cells")).select(*where, "cells.*")
    # The reader hands on the text of rows with too few or too many cells.  It refuses to
    # read that column alone, so a cell (nothing of it) goes along.
    nothing = F.substring(F.coalesce(positions[0], F.lit("")), 1, 0)
    record = F.rtrim(F.concat(F.col(RECORD), nothing), F.lit("\r\n"))
    commas = F.regexp_replace(without_quoted_cells(record), "[^,]", "")
    too_long = F.raise_error(F.lit(f"{PARSE_ERROR}: expected {len(names)} fields, saw more"))
    kept = rows.filter(
        F.when(record.isNull() | (F.length(commas) < len(names)), F.lit(True))
        .otherwise(too_long.cast("boolean"))
    )
    shown = [name.strip() if strip_header else name for name in names]
    return kept.select(
        *[without_na_tokens(F.col(p)).alias(name) for p, name in zip(positions, shown)], *where
    )


def stage_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parse a CSV file once into a stored table that keeps the rows' file position.

    An evaluation reads a table once per key set; stored columns are pruned, text is not.
    Unreadable rows surface here, before any rule runs.
    """
    table = read_csv(spark, path, origin=True, **options)
    try:
        return stored(table, "csv")
    except Exception as error:
        if PARSE_ERROR in str(error):
            raise CheckError(f"{PARSE_ERROR}: a row has too many fields") from error
        raise
