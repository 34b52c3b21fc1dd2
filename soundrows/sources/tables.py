"""Table sets: every registered table that a folder or catalog schema holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundrows.errors import CheckError
from soundrows.sources.csv import read_csv, stage_csv


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns ``path`` (local, HDFS, object store)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(hadoop_path)


def list_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Names of the tables in a folder, sorted; a table is a file or a folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(hadoop_path)]
    return sorted(n.removesuffix(suffix) for n in names if n.endswith(suffix))


def load_csv_tables(
    spark: SparkSession, folder: str, names: Iterable[str], staged: bool = False, **options
) -> dict[str, DataFrame]:
    """The named tables that exist as ``<folder>/<name>.csv``, in the given order.

    Header names are taken as they stand here; only a single-file check strips them.
    ``staged`` parses each file once into a stored table.
    """
    read = stage_csv if staged else read_csv
    return {
        name: read(spark, f"{folder}/{name}.csv", strip_header=False, **options)
        for name in names
        if path_exists(spark, f"{folder}/{name}.csv")
    }


def load_parquet_tables(
    spark: SparkSession, folder: str, names: Iterable[str]
) -> dict[str, DataFrame]:
    return {
        name: spark.read.parquet(f"{folder}/{name}.parquet")
        for name in names
        if path_exists(spark, f"{folder}/{name}.parquet")
    }


def load_catalog_tables(
    spark: SparkSession, names: Iterable[str], schema: str | None = None
) -> dict[str, DataFrame]:
    found = {}
    for name in names:
        full = f"{schema}.{name}" if schema else name
        if spark.catalog.tableExists(full):
            found[name] = spark.table(full)
    return found


def load_table(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    tables = load_csv_tables(spark, folder, [name], **options)
    if name not in tables:
        raise CheckError(f"No table '{name}' in '{folder}'.")
    return tables[name]


# -- intake guards: off unless a limit is passed ---------------------------------
def check_bytes(spark: SparkSession, path: str, limit: int) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getContentSummary(hadoop_path).getLength() > limit:
        raise CheckError(f"The input has more than {limit:,} bytes.")


def check_not_empty(table: DataFrame) -> None:
    if table.isEmpty():
        raise CheckError("The table has no rows.")


def check_rows(tables: Iterable[DataFrame], limit: int) -> None:
    """Refuse more than ``limit`` rows in all, without counting far beyond it."""
    total = 0
    for table in tables:
        total += table.select(F.lit(1)).limit(limit - total + 1).count()
        if total > limit:
            raise CheckError(f"The input has more than {limit:,} rows.")
