"""Duplicate passages against a plain search of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import suffixes


def plain(rows, length=50):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(first.get(s, doc), doc)
    out = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        gone = set()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < doc:
                    gone.update(range(i, i + length))
        spans = sum(i - 1 not in gone for i in gone)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        out[doc, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé dx\n") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(6, 60)) for _ in range(8)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "y" * 50, "ab" * 300, "ab" * 40, "b" + "ab" * 25]
    for _ in range(60):
        parts = [prose(rng.randint(0, 30)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        texts.append("".join(parts))
    for _ in range(12):
        copy = list(rng.choice(texts[9:]))
        for _ in range(rng.randrange(3)):
            if copy:
                copy[rng.randrange(len(copy))] = "Z"
        texts.append("".join(copy))
    texts += [texts[20]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("unit_bytes, entries", [(1 << 20, 1 << 20), (500, 300), (1, 4000)])
def test_equals_all_strings(spark, unit_bytes, entries):
    rows = list(enumerate(corpus(11)))
    docs = documents(spark, [t for _, t in rows]).withColumn("unit", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    out = suffixes.digest(suffixes.deduplicated(docs, unit_bytes=unit_bytes, bucket_entries=entries))
    assert Counter(map(tuple, out.collect())) == plain(rows)


def test_null_and_repeated_ids_and_other_lengths(spark):
    texts = corpus(12)
    rows = [(None if i % 11 == 0 else i % 17 - 5, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length in (12, 30, 64):
        out = suffixes.digest(suffixes.deduplicated(docs, length, unit_bytes=2000))
        assert Counter(map(tuple, out.collect())) == plain(rows, length)
    assert suffixes.deduplicated(docs.limit(0)).count() == 0


def test_spans_are_the_removed_bytes(spark):
    texts = corpus(13)
    for r in suffixes.deduplicated(documents(spark, texts)).collect():
        raw = bytearray((texts[r.doc_id] or "").encode())
        for s in reversed(r.spans):
            del raw[s.start : s.end]
        assert bytes(raw) == bytes(r.kept)


def test_covers_and_code():
    for v, cover in suffixes.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    rng = np.random.default_rng(1)
    for bits in (9, 31, 58, 64):
        for n in (1, 5, 3000):
            values = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(max(0, 63 - bits)))
            low, packed = suffixes.pack(values, bits)
            assert (suffixes.unpack(n, low, packed) == values).all()


def test_units_can_be_dropped(spark):
    suffixes.deduplicated(documents(spark, ["a", "b"])).collect()
    names = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith(suffixes.UNITS)]
    assert names()
    suffixes.drop_units(spark)
    assert not names()
