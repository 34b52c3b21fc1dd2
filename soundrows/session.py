"""Spark session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Column names that differ in case only are different columns.
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Profiles build many small expressions; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: The folders of intermediates that the current piece of work owns, if it owns any.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def build_session(app_name: str = "soundrows", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall
    back to a folder of its own: executors of a cluster do not share one.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_SETTING} to a folder that all executors share"
            )
        folder = tempfile.mkdtemp(prefix="soundrows-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once into reliable storage and cut its lineage."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints."""
    path = f"{checkpoint_dir(spark)}/soundrows-{name}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


class Workers(ThreadPoolExecutor):
    """Threads that make intermediates for whoever hands them work."""

    def submit(self, function, /, *args, **kwargs):
        return super().submit(copy_context().run, function, *args, **kwargs)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Own the intermediates that are made inside the block and remove them at its end.

    For work that ends in plain values: frames that still read them must not leave the
    block.  Blocks of several threads own their intermediates each; ``Workers`` that a block
    starts work for it.
    """
    owned: list[str] = []
    token = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in owned:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system owns it; a missing one is fine."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop_path, True)


def stored(frame: DataFrame, name: str, partition_by: Sequence[str] = (), **options: str) -> DataFrame:
    """Write ``frame`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint, later reads prune columns and partitions.  ``options`` are the
    writer's, such as ``compression``.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.options(**options).partitionBy(*partition_by).parquet(path)
    back = frame.sparkSession.read.schema(frame.schema).parquet(path)
    return back.select(*[f"`{c}`" for c in frame.columns])
