"""Skew-safe attachment of per-key values to rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.operators.cells import named


@dataclass(frozen=True)
class Limits:
    """What may be broadcast, and when a key counts as hot."""

    broadcast_bytes: int = 64 * 1024 * 1024
    hot_rows: int = 1_000_000
    hot_keys: int = 10_000
    salts: int = 256


DEFAULT_LIMITS = Limits()


def size_in_bytes(frame: DataFrame, key: str) -> int:
    """Measure a materialised key frame; an action over key lengths only."""
    size = F.sum(F.octet_length(key) + F.lit(64))
    return frame.agg(F.coalesce(size, F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(frame: DataFrame, key: str, limits: Limits) -> bool:
    return size_in_bytes(frame, key) <= limits.broadcast_bytes


def attach(
    rows: DataFrame,
    key: str,
    values: DataFrame,
    spread: Sequence[Column],
    hot: DataFrame | None = None,
    small: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    tasks: int | None = None,
) -> DataFrame:
    """Left-join ``values`` (one row per ``key``) to ``rows``, in ``tasks`` if given.

    * ``small`` (a measured frame): broadcast, no shuffle of the rows.
    * otherwise a shuffled join on the key and a salt.  Rows of the ``hot`` keys (a
      frame of at most ``limits.hot_keys`` names) and rows without a key are salted by
      ``spread``; the values of hot keys are repeated once per salt.  All other rows
      have salt 0, so nothing else is repeated.

    The salt depends on row contents alone: a recomputed task sends every row to the
    same place.
    """
    if small:
        return rows.join(F.broadcast(values), key, "left")
    if hot is None:
        hot = values.select(key).limit(0)
    often = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(*spread), F.lit(limits.salts))
    salted = F.col("_hot") | F.col(key).isNull()
    left = rows.join(often, key, "left").withColumn(
        "_salt", F.when(salted, salt).otherwise(F.lit(0)).cast("int")
    )
    if tasks:
        left = left.repartition(tasks, key, "_salt")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(limits.salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = (
        values.join(often, key, "left")
        .select(*[named(c) for c in values.columns], F.explode(salts).alias("_salt"))
    )
    return left.join(right, [key, "_salt"], "left").select(
        *[named(c) for c in rows.columns],
        *[named(c) for c in values.columns if c != key],
    )


def hot_keys(rows: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The most frequent keys of ``rows``: at most ``hot_keys``, each with many rows."""
    counted = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return most_frequent(counted, key, limits)


def most_frequent(counted: DataFrame, key: str, limits: Limits) -> DataFrame:
    """Names of the hot keys in a frame of (key, _rows)."""
    return (
        counted.filter(F.col(key).isNotNull() & (F.col("_rows") >= limits.hot_rows))
        .orderBy(F.desc("_rows"), key)
        .limit(limits.hot_keys)
        .select(key)
    )


def lookup(
    rows: DataFrame,
    key: str,
    values: DataFrame,
    spread: Sequence[Column],
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``attach`` for rows whose hot keys are not known yet.

    Reads the key column of ``rows`` once more to count it.
    """
    return attach(rows, key, values, spread, hot_keys(rows, key, limits), limits=limits)
