"""Records of comma-separated text whose quoted cells may hold line breaks, read in blocks.

A block of a file does not know whether it begins inside a quoted cell.  But a line is a
function of two states: given that a quoted cell is open before it or not, one is open
after it or not.  The lines of a block compose to one such function, and a scan over the
blocks of a file, from its beginning, tells the state in which each block begins.  Then
every block is cut into records by itself.  What the borders cut is put together again:
the open record at the end of a block, and what the following blocks have of it.

Plan: two scans of the lines by as many tasks as there are blocks.  The first sends on one
row for each block, the second adds the text of at most two cut records for each block; the
third scan is the caller's, of whole records.  The blocks that begin inside a cell are
broadcast, up to a limit (see ``with_starts``).

A quote opens a cell only at its beginning; two quotes inside a quoted cell are one; the
first single quote ends it.  A cell that is never closed goes on to the end of the file.
Only line feeds end lines; a carriage return before them belongs to them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundrows.session import stored
from soundrows.sources.origin import BLOCK, FILE, SEQUENCE

# What runs in Python workers is shipped by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD = "record"
MOST_BROADCAST = 1 << 20  # rows of some 32 bytes
#: Whole records, the open end of a block, and what a block has of a record begun before.
WHOLE, OPEN, MIDDLE, LAST = 0, 1, 2, 3


def opens(text: Column) -> Column:
    """Is a quoted cell open at the end of a text that begins outside?  Without doubled quotes."""
    left = F.regexp_replace(text, r'(^|,)"[^"]*"[^,]*(?=,|$)', "$1")
    return left.rlike('(^|,)"')


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their block, and whether a cell is open after them, by the state before."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), "value"
    )
    single = F.replace(F.rtrim("value", F.lit("\r")), F.lit('""'), F.lit(""))
    rest = F.substring(single, F.locate('"', single) + 1, F.length(single))
    return lines.select(
        FILE, BLOCK, "value", opens(single).alias("open0"),
        (~single.contains('"') | opens(rest)).alias("open1"),
        F.rtrim("value", F.lit("\r")).contains("\r").alias("odd"),
    )


def states(open0: np.ndarray, open1: np.ndarray, state: bool) -> np.ndarray:
    """The state before each line, and after the last one."""
    fixed = open0 == open1
    turns = np.cumsum(~fixed & open0)  # lines that exchange the states
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = last >= 0
    value = np.where(known, open0[last], state) if len(fixed) else np.empty(0, bool)
    since = turns - np.where(known, turns[last], 0) if len(fixed) else turns
    return np.concatenate([[state], value ^ (since % 2 == 1)]).astype(bool)


def block_runs(batch: pa.RecordBatch):
    """(file, block, first row, row after the last) of a batch's runs of rows of one block."""
    if not batch.num_rows:
        return
    blocks = batch.column(BLOCK).to_numpy()
    names = batch.column(FILE).dictionary_encode()
    files = names.indices.to_numpy()
    edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])) + 1
    bounds = [0, *edges.tolist(), batch.num_rows]
    for first, last in zip(bounds, bounds[1:]):
        yield names.dictionary[int(files[first])].as_py(), int(blocks[first]), first, last


def compose(batches):
    """A row for each block: the state after it, by the state before it."""
    key, after, odd = None, (False, True), False
    for batch in batches:
        open0, open1, odds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("open0", "open1", "odd"))
        for file, block, first, last in block_runs(batch):
            if key != (file, block):
                if key:
                    yield composed(key, after, odd)
                key, after, odd = (file, block), (False, True), False
            after = tuple(bool(states(open0[first:last], open1[first:last], s)[-1]) for s in after)
            odd = odd or bool(odds[first:last].any())
    if key:
        yield composed(key, after, odd)


def composed(key: tuple[str, int], after: tuple[bool, bool], odd: bool) -> pa.RecordBatch:
    values = [[key[0]], [key[1]], [after[0]], [after[1]], [odd]]
    return pa.record_batch(
        [pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))],
        names=[FILE, BLOCK, "open0", "open1", "odd"],
    )


def begins_inside(blocks: DataFrame) -> DataFrame:
    """The blocks that begin inside a quoted cell: a scan over the functions of a file's blocks."""
    fixed = F.col("open0") == F.col("open1")
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    turned = blocks.withColumn("turn", (~fixed & F.col("open0")).cast("int"))
    turned = turned.withColumn("turns", F.coalesce(F.sum("turn").over(before), F.lit(0)))
    last = F.last(F.when(fixed, F.struct("open0", "turns")), ignorenulls=True).over(before)
    value = F.coalesce(last["open0"], F.lit(False)).cast("int")
    since = F.col("turns") - F.coalesce(last["turns"], F.lit(0))
    return turned.select(FILE, BLOCK, ((value + since) % 2 == 1).alias("inside")).filter("inside")


class Cutter:
    """Cuts the lines of blocks into records."""

    def __init__(self):
        self.key, self.header_due = None, False
        self.rows: list[tuple] = []

    def begin(self, file: str, block: int, inside: bool) -> None:
        self.key, self.inside, self.line = (file, block), inside, 0
        self.begun: list[str] | None = [] if inside else None
        self.begun_line, self.of_before, self.header_due = 0, inside, block == 0

    def put(self, part: int, line: int, text: str) -> None:
        header = self.header_due and bool(text.strip().strip("﻿"))
        self.header_due &= not header
        self.rows.append((*self.key, line, part, header, text))

    def add(self, values: list[str], before: np.ndarray) -> None:
        starts = np.flatnonzero(~before[:-1]).tolist()
        is_open, n = bool(before[-1]), len(values)
        if self.begun is not None:
            self.begun += values[: starts[0] if starts else n]
            if starts or not is_open:
                self.put(LAST if self.of_before else WHOLE, self.begun_line, "\n".join(self.begun))
                self.begun = None
        for start, end in zip(starts, [*starts[1:], n]):
            if end == n and is_open:
                self.begun, self.begun_line, self.of_before = values[start:], self.line + start, False
            else:
                self.put(WHOLE, self.line + start, values[start] if end == start + 1 else "\n".join(values[start:end]))
        self.line += n
        self.inside = is_open

    def end(self) -> None:
        if self.key and self.begun is not None:
            self.put(MIDDLE if self.of_before else OPEN, self.begun_line, "\n".join(self.begun))

    def taken(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        columns = zip(*self.rows) if self.rows else [()] * 6
        self.rows = []
        return pa.record_batch(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)],
            names=[FILE, BLOCK, SEQUENCE, "part", "header", RECORD],
        )


def cut(batches):
    cutter = Cutter()
    for batch in batches:
        open0, open1, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("open0", "open1", "inside"))
        for file, block, first, last in block_runs(batch):
            if cutter.key != (file, block):
                cutter.end()
                cutter.begin(file, block, bool(inside[first]))
            values = batch.column("value").slice(first, last - first).to_pylist()
            cutter.add(values, states(open0[first:last], open1[first:last], cutter.inside))
        yield cutter.taken()
    cutter.end()
    yield cutter.taken()


def joined(parts: DataFrame, text: str, *flags: str) -> DataFrame:
    """What block borders cut, put together: with place and flags of its first part."""
    order = [F.col(BLOCK), (F.col("part") == OPEN).cast("int")]
    number = F.sum((F.col("part") == OPEN).cast("int")).over(Window.partitionBy(FILE).orderBy(*order))
    pieces = F.sort_array(F.collect_list(F.struct(order[0], order[1].alias("opens"), SEQUENCE, text, *flags)))
    together = parts.withColumn("number", number).groupBy(FILE, "number").agg(pieces.alias("pieces"))
    first = F.col("pieces")[0]
    separator = "\n" if text == RECORD else ""
    return together.select(
        FILE, *[first[c].alias(c) for c in (BLOCK, SEQUENCE, *flags)],
        F.array_join(F.transform("pieces", lambda p: p[text]), separator).alias(text),
    )


def in_block_order(text: str) -> Column:
    """An aggregate: a file's texts, one for each block, end to end."""
    pieces = F.sort_array(F.collect_list(F.struct(BLOCK, text)))
    return F.array_join(F.transform(pieces, lambda p: p[text]), "")


def with_starts(texts: DataFrame, starts: DataFrame) -> DataFrame:
    """Texts in their order, with the columns of ``starts``, one row for each block.

    Up to ``MOST_BROADCAST`` blocks are broadcast.  Beyond, each block's texts go through one
    shuffle and are put in order again.
    """
    columns = [c for c in starts.columns if c not in (FILE, BLOCK)]
    keyed = starts.select(F.xxhash64(FILE).alias("_file"), F.col(BLOCK).alias("_block"), *columns)
    same = (F.xxhash64(FILE) == F.col("_file")) & (F.col(BLOCK) == F.col("_block"))
    if starts.count() <= MOST_BROADCAST:
        return texts.join(F.broadcast(keyed), same, "left").drop("_file", "_block")
    numbered = texts.withColumn("_place", F.monotonically_increasing_id())
    sorted_again = numbered.join(starts, [FILE, BLOCK], "left").repartition(FILE, BLOCK)
    return sorted_again.sortWithinPartitions(FILE, BLOCK, "_place").drop("_place")


@dataclass(frozen=True)
class Records:
    """``rows``: file, block, sequence, record; ``headers``: the same of each file's first record."""

    rows: DataFrame
    headers: DataFrame


def split_records(spark: SparkSession, path: str) -> Records | None:
    """The records of files, blank ones left out.

    None where carriage returns stand inside lines: some files use them as line ends.
    """
    lines = lines_of(spark, path)
    kind = f"{FILE} string, {BLOCK} long"
    blocks = stored(
        lines.select(FILE, BLOCK, "open0", "open1", "odd").mapInArrow(compose, f"{kind}, open0 boolean, open1 boolean, odd boolean"),
        "blocks",
    )
    if blocks.filter("odd").limit(1).count():
        return None
    inside = stored(begins_inside(blocks).withColumn("inside", F.lit(True)), "inside")
    marked = with_starts(lines.select(FILE, BLOCK, "value", "open0", "open1"), inside)
    marked = marked.select(FILE, BLOCK, "value", "open0", "open1", F.coalesce("inside", F.lit(False)).alias("inside"))
    found = marked.mapInArrow(cut, f"{kind}, {SEQUENCE} long, part int, header boolean, {RECORD} string")
    parts = stored(found.filter(F.col("part") != WHOLE), "parts")
    every = found.filter(F.col("part") == WHOLE).drop("part").unionByName(joined(parts, RECORD, "header"))
    every = every.withColumn(RECORD, F.rtrim(RECORD, F.lit("\r"))).filter(F.trim(RECORD) != "")
    columns = [FILE, BLOCK, SEQUENCE, RECORD]
    return Records(every.filter("not header").select(*columns), every.filter("header").select(*columns))
