"""Poisson replication: counts against an inversion by hand, means, order."""

import hashlib
import math
from collections import Counter

from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import mixing


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def plain_poisson(mean, u):
    n, p = 0, math.exp(-mean)
    below = p
    while below <= u:
        n += 1
        p *= mean / n
        below += p
    return n


def counts_of(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_counts_equal_inversion(spark):
    docs = documents(spark, ["t"] * 300).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    out = mixing.mixed(docs, {"s0": 1.0, "s1": 4.0}, size=10.0)
    got = counts_of(out)
    for i in range(300):
        rate = {0: 3000 * 0.2 / 100, 1: 3000 * 0.8 / 100, 2: 0.0}[i % 3]
        parts = max(1, math.ceil(rate / 16))
        want = sum(plain_poisson(rate / parts, uniform(20, j, i)) for j in range(1, parts + 1)) if rate else 0
        assert got[i] == want
    assert abs(sum(got.values()) - 3000) < 5 * math.sqrt(3000)


def test_every_copy_has_its_number_and_place(spark):
    docs = documents(spark, ["t"] * 200).withColumn("source", F.lit("s")).withColumn("copy", F.lit("own"))
    out = mixing.mixed(docs, size=3.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "copy_", "place"]
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    for i, n in Counter(r.doc_id for r in rows).items():
        assert sorted(r.copy_ for r in rows if r.doc_id == i) == list(range(1, n + 1))
    order = [r.place for r in sorted(rows, key=lambda r: r.part)]
    assert order == sorted(order) and len({r.part for r in rows}) > 1
    assert mixing.mixed(docs, size=3.0).collect() == out.collect()


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a", None), (1, "b", None), (None, None, "s"), (None, "", "s"), (2, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in mixing.mixed(docs, size=20.0).collect())
    assert got[1, "a"] == got[1, "b"] and got[None, None] == got[None, ""]
    assert mixing.mixed(docs.limit(0)).count() == 0
    # Many sources: rates joined by shuffle with salted hot sources give the same rows.
    joined = mixing.mixed(docs, size=20.0)
    mixing.fits_broadcast, kept = (lambda *a: False), mixing.fits_broadcast
    try:
        assert sorted(mixing.mixed(docs, size=20.0).collect(), key=str) == sorted(joined.collect(), key=str)
    finally:
        mixing.fits_broadcast = kept
