"""Packing: ids against the tokenizer, and sequences against best-fit of one piece at a time."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import encoders, packing

TEXTS = [
    None, "", " ", "one two three", "Größe, ÉTÉ! Don't you'll 3.14 naïve", "x" * 5000, "a b " * 3000, "one two three",
    "tab\tline\r\nend\x0b　wide", "日本語 text ﬁ Å é ª º µ × ÷ ÿ ß", "<|endoftext|> a.<|startoftext|>,b",
    "a.b a,'s .'s it's,it", "  ", "İstanbul ΣΑΣ", "end.", "é,è;ê", "word " * 20_000 + "Ω",
]


def best_fit(sizes, capacity):
    """Sequences of best-fit, largest first."""
    gaps = np.zeros(capacity + 1, int)
    n = 0
    for size in sorted(sizes, reverse=True):
        fitting = np.flatnonzero(gaps[size:])
        if len(fitting):
            gap = size + fitting[0]
            gaps[gap] -= 1
        else:
            gap, n = capacity, n + 1
        gaps[gap - size] += 1
    return n


def sequences_of(rows, capacity):
    """How many sequences; all must be gapless and within the capacity."""
    members = defaultdict(list)
    for row in rows:
        members[row.sequence_id].append((row.offset, row.length))
    for parts in members.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(members)


def items(spark, sizes):
    return spark.createDataFrame([(i * 7, int(x)) for i, x in enumerate(sizes)], "number long, length long").repartition(5)


@pytest.fixture(scope="module")
def tokenizer():
    return encoders.json_tokenizer(encoders.file_bytes(encoders.vocabulary_file(packing.VOCABULARY)), False)


def test_ids_and_places(spark, tokenizer):
    docs = documents(spark, TEXTS).withColumn("piece", F.lit("clash")).withColumn("number", F.lit(1)).withColumn("ids", F.lit(2))
    pieces = packing.pieces(docs)
    rows = packing.digest(pieces).collect()
    by_doc = defaultdict(dict)
    for row in rows:
        by_doc[row.doc_id][row.piece] = row
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert sorted(by_doc[i]) == list(range(-(-len(ids) // 2048)))
        for piece, row in by_doc[i].items():
            part = np.array(ids[2048 * piece : 2048 * piece + 2048], "<u4")
            assert (row.start, row.length, row.ids_crc32) == (2048 * piece, len(part), zlib.crc32(part.tobytes()))
    n = sequences_of(rows, 2048)
    assert n == best_fit([r.length for r in rows], 2048)
    whole = packing.sequences(packing.packed(pieces)).collect()
    assert len(whole) == n and all(len(r.ids) == 4 * r.length for r in whole)


def test_whole_way_equals_pieces_of_chunks(tokenizer):
    """Chunks of odd characters, alone and between words."""
    encoder = encoders.WordEncoder(encoders.file_bytes(encoders.vocabulary_file(packing.VOCABULARY)))
    odd = [chr(c) for c in [*range(1, 0x180), 0x2028, 0x3000, 0x301, 0x3A3, 0x130, 0x1F600]]
    texts = [f"{before}{c}{after}" for c in odd for before in ("a", ",", " ", "é") for after in ("b", ".", " ", "'s")]
    import pyarrow as pa

    from soundrows.llm.textbytes import buffer_of

    values, places = encoder.ids(*buffer_of(pa.array(texts)))
    for k, text in enumerate(texts):
        assert values[places[k] : places[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("in_one_task", [0, 300, 1 << 15])
def test_rounds_are_close_to_best_fit(spark, in_one_task):
    sizes = np.minimum(2048, np.exp(np.random.default_rng(3).normal(6.5, 1, 1200)).astype(int) + 1)
    frame = items(spark, sizes).withColumnRenamed("length", "size")
    rows = packing.placed(frame, 2048, in_one_task).join(frame, "number").withColumnRenamed("size", "length").collect()
    assert len(rows) == len(sizes) == len({r.number for r in rows})
    assert sequences_of(rows, 2048) <= 1.005 * best_fit(sizes, 2048)


def test_equal_sizes(spark):
    """One size holds all rows: the numbers to open with are dealt by hash."""
    frame = items(spark, [700] * 900).withColumnRenamed("length", "size")
    rows = packing.placed(frame, 2048, 100).join(frame, "number").withColumnRenamed("size", "length").collect()
    assert len({r.number for r in rows}) == 900
    assert sequences_of(rows, 2048) <= 1.02 * best_fit([700] * 900, 2048)


def test_tiny_pieces_are_bundled(spark):
    sizes = np.random.default_rng(5).integers(1, 9, 20_000)
    frame = items(spark, sizes)
    assert packing.bundled(frame.withColumnRenamed("length", "size")) is not None
    rows = packing.packed(frame.withColumn("id", F.col("number"))).collect()
    assert len({r.number for r in rows}) == len(rows) == len(sizes)
    assert sequences_of(rows, 2048) <= 1.05 * best_fit(sizes, 2048) + 1


def test_empty_table_and_odd_ids(spark):
    docs = documents(spark, ["a"])
    assert packing.digest(packing.pieces(docs.limit(0))).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", None)], "doc_id string, text string")
    rows = packing.digest(packing.pieces(twice)).collect()
    assert sorted((r.doc_id or "", r.length) for r in rows) == [("", 3), ("", 3), ("x", 1)]
    assert len({r.sequence_id for r in rows}) == 1
