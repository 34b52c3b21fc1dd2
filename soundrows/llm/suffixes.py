"""Duplicate passages by sorting suffixes in buckets, with a difference cover.

A byte goes when it lies in a ``length``-byte string that also starts in a document with a
smaller id.  Only whether two suffixes agree on ``length`` bytes matters, so suffixes are
sorted to that depth, one bucket at a time, in these steps:

1. Cover sample.  Places of a document in a difference cover of period v (|D| of v places)
   are named by their next ``length - v + 1`` bytes.  For any two suffixes there is an
   offset below v at which both have a sampled place, so if they agree on ``length``
   bytes they share the name there.  Sorting the names bucket by bucket leaves those that
   several documents have; only suffixes with one among their next v places go on.
2. Long ties.  Neighbouring suffixes are joined to stretches between places chosen by their
   content.  Stretches are sorted by fingerprints of their suffixes; one that a smaller
   document has too settles all its suffixes at once.
3. Suffix buckets.  What is left is sorted by short fingerprints of ``length`` bytes, which
   drops suffixes that occur in one document only, and then by long ones; suffixes that
   tie get the least document id among them.
4. Each document loses the bytes under settled and tied suffixes.

Ties are told apart by fingerprints of 96 bits, not by comparing text.  Fingerprints
travel as sorted runs per (unit, bucket) in an Elias-Fano code; answers are one bit each.

Scale: documents are packed into units of bounded size, written once as a table bucketed by
unit, which all passes read without shuffling texts.  The number of buckets follows the
corpus, so a task sorts a bounded part.  A string sends one entry per unit, however often it
occurs there.

Defined results for odd input: a NULL or empty text has no bytes; texts shorter than
``length`` lose nothing; a document without an id loses nothing and takes nothing from
others; documents with equal ids do not take from each other; an empty table gives an empty
result; extra columns are ignored.

The result reads the table of units, which stays in the session's catalog until
``drop_units`` removes it.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import narrowed, small_batches
from soundrows.llm.shingles import constants, mix
from soundrows.llm.textbytes import covered, pieces, ranges
from soundrows.session import scratch_path, stored

#: Difference covers (perfect difference sets) by period.
COVERS = {31: (1, 5, 11, 24, 25, 27), 13: (0, 1, 3, 9), 7: (0, 1, 3), 1: (0,)}
LEAST_NAME = 20
UNIT_BYTES = 4 << 20
UNITS = "soundrows_units_"
BUCKET_ENTRIES = 2 << 20
SPARE_BITS = 9  # short fingerprints have this many bits more than needed to count them
ANCHOR_MASK = np.uint64(31)  # a stretch begins where a fingerprint's low bits are zero
STRETCH = 256  # or after this many suffixes
FACTORS = tuple(
    np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
)
WEIGHTS = constants(STRETCH, 61), constants(STRETCH, 62)


@dataclass(frozen=True)
class Plan:
    """Settings of a run; bits and buckets (as powers of two) follow the corpus."""

    length: int
    period: int
    name_bits: int
    name_buckets: int
    stretch_buckets: int
    short_bits: int
    short_buckets: int
    suffix_buckets: int

    @property
    def name_bytes(self) -> int:
        return self.length - self.period + 1


def plan_for(length: int, total_bytes: int, bucket_entries: int) -> Plan:
    period = max(v for v in COVERS if length - v + 1 >= min(LEAST_NAME, length))
    sample = max(1, total_bytes * len(COVERS[period]) // period)
    power = lambda entries: max(0, math.ceil(math.log2(max(1, entries / bucket_entries))))
    bits = lambda entries: min(62, math.ceil(math.log2(entries + 1)) + SPARE_BITS)
    return Plan(
        length, period, bits(sample), power(sample), power(total_bytes // 64),
        bits(total_bytes // 4), power(total_bytes // 4), power(total_bytes // 32),
    )


class Unit:
    """Documents end to end: bytes, first byte and length of each, their ids."""

    def __init__(self, table: pa.Table):
        row = table.select(["unit", "ids", "lengths", "data"]).slice(0, 1)
        self.number = row.column("unit")[0].as_py()
        raw = np.frombuffer(row.column("data")[0].as_buffer(), np.uint8)
        self.size = len(raw)
        self.data = np.concatenate([raw, np.zeros(64, np.uint8)])
        ids = row.column("ids")[0].values
        self.has_id = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.lengths = row.column("lengths")[0].values.to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.document = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def fingerprints(self, places: np.ndarray, length: int, factor: int) -> np.ndarray:
        """A 64-bit fingerprint of the ``length`` bytes at each place."""
        out = np.full(len(places), length, np.uint64)
        a, b = FACTORS[factor], FACTORS[(factor + 1) % len(FACTORS)]
        for at in range(0, length, 8):
            word = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))[places + at]
            if length - at < 8:
                word &= np.uint64((1 << (8 * (length - at))) - 1)
            out = (out ^ word) * a
            out ^= out >> np.uint64(32)
            out *= b
            out ^= out >> np.uint64(29)
        return out

    def sample(self, plan: Plan) -> np.ndarray:
        """Sampled places of all documents that are long enough."""
        usable = self.has_id & (self.lengths >= plan.length)
        starts, lengths = self.starts[usable], self.lengths[usable]
        parts = []
        for d in COVERS[plan.period]:
            counts = np.maximum(0, (lengths - plan.name_bytes - d) // plan.period + 1)
            steps = ranges(np.zeros(len(counts), np.int64), counts)
            parts.append(np.repeat(starts + d, counts) + steps * plan.period)
        return np.sort(np.concatenate(parts))

    def names(self, plan: Plan) -> tuple[np.ndarray, "Sorted"]:
        places = self.sample(plan)
        values = self.fingerprints(places, plan.name_bytes, 0) >> np.uint64(64 - plan.name_bits)
        return places, Sorted(values)

    def suffixes(self, plan: Plan, shared: np.ndarray) -> np.ndarray:
        """Places of whole strings that have a shared name among their next places."""
        first = np.maximum(shared - plan.period + 1, self.starts[self.document[shared]])
        near = covered(first, shared + 1 - first, self.size)
        places = np.flatnonzero(near)
        of = self.document[places]
        return places[places + plan.length <= (self.starts + self.lengths)[of]]


class Sorted:
    """Values sorted, their runs of equal ones, and the way back to the input's order."""

    def __init__(self, values: np.ndarray, second: np.ndarray | None = None):
        self.order = np.argsort(values)
        ordered = values[self.order]
        new = np.ones(len(values), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if second is not None:
            other = second[self.order]
            if (~new[1:] & (other[1:] != other[:-1])).any():
                self.order = np.lexsort((second, values))
                ordered, other = values[self.order], second[self.order]
                new[1:] = (ordered[1:] != ordered[:-1]) | (other[1:] != other[:-1])
        self.firsts = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.values = ordered[self.firsts]

    def back(self, of_run: np.ndarray) -> np.ndarray:
        """For each input value what its run has."""
        out = np.empty(len(self.order), of_run.dtype)
        out[self.order] = of_run[self.run]
        return out

    def least(self, what: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(what[self.order], self.firsts) if len(what) else what

    def most(self, what: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(what[self.order], self.firsts) if len(what) else what


def pack(values: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Elias-Fano: whole low bytes as they are, high parts as marks in a bit string."""
    n = len(values)
    low = min(
        (x for x in range(1, 9) if bits - 8 * x <= 26),
        key=lambda x: 8 * x * n + (1 << max(0, bits - 8 * x)),
    )
    high = (values >> np.uint64(8 * low)).astype(np.int64) if low < 8 else np.zeros(n, np.int64)
    marks = np.zeros(n + (1 << max(0, bits - 8 * low)), bool)
    marks[high + np.arange(n)] = True
    parts = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8)[:, :low]
    return low, parts.tobytes() + np.packbits(marks).tobytes()


def unpack(n: int, low: int, packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    parts = np.zeros((n, 8), np.uint8)
    parts[:, :low] = raw[: n * low].reshape(n, low)
    marks = np.flatnonzero(np.unpackbits(raw[n * low :]))[:n]
    high = (marks - np.arange(n)).astype(np.uint64)
    values = parts.reshape(-1).view(np.uint64)
    return values | (high << np.uint64(8 * low)) if low < 8 else values


def cuts(values: np.ndarray, bits: int, buckets: int):
    """The runs of sorted values that share their top bits: (bucket, first, last)."""
    if not len(values):
        return
    tops = (values >> np.uint64(bits - buckets)).astype(np.int64) if buckets else np.zeros(len(values), np.int64)
    firsts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    for first, last in zip(firsts.tolist(), [*firsts[1:].tolist(), len(values)]):
        yield int(tops[first]), first, last


def below(values: np.ndarray, bits: int) -> np.ndarray:
    return values & np.uint64((1 << bits) - 1) if bits < 64 else values


NAMES = "unit long, bucket int, n int, low int, packed binary, several binary"
#: Entries of a bucket, or (bucket -1) a unit's places, to be told about later.
ENTRIES = "unit long, bucket int, n int, low int, packed binary, rest binary, document binary, ids binary"
ANSWERS = "unit long, step int, bucket int, n int, flags binary"


def rows_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def short_rows(unit: Unit, short: Sorted, documents: np.ndarray, bits: int, buckets: int) -> pa.Table:
    """Distinct short fingerprints by bucket, and which of them several documents have."""
    several = short.least(documents) != short.most(documents)
    rows = []
    for bucket, first, last in cuts(short.values, bits, buckets):
        low, packed = pack(below(short.values[first:last], bits - buckets), bits - buckets)
        flags = np.packbits(several[first:last]).tobytes()
        rows.append((unit.number, bucket, last - first, low, packed, flags))
    return rows_table(rows, NAMES)


def name_rows(batches, plan: Plan):
    """The names of the cover sample of each unit."""
    for batch in batches:
        for i in range(batch.num_rows):
            unit = Unit(pa.Table.from_batches([batch.slice(i, 1)]))
            places, names = unit.names(plan)
            table = short_rows(unit, names, unit.ids[unit.document[places]], plan.name_bits, plan.name_buckets)
            yield from table.to_batches()


def shared(table: pa.Table, step: int) -> pa.Table:
    """Of one bucket: per unit one bit for each value, whether other documents have it."""
    rows = table.to_pylist()
    values = np.concatenate([unpack(r["n"], r["low"], r["packed"]) for r in rows])
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8))[: r["n"]] for r in rows])
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    found = several.astype(bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return answers(rows, found, step)


def answers(rows: list[dict], flags: np.ndarray, step: int) -> pa.Table:
    out, first = [], 0
    for r in rows:
        out.append((r["unit"], step, r["bucket"], r["n"], np.packbits(flags[first : first + r["n"]]).tobytes()))
        first += r["n"]
    return rows_table(out, ANSWERS)


def answered(table: pa.Table, step: int, values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The answers of a unit's buckets, in the order of its sorted values."""
    found = {
        r["bucket"]: r["flags"] for r in table.to_pylist() if r["step"] == step
    }
    out = np.zeros(len(values), bool)
    for bucket, first, last in cuts(values, bits, buckets):
        out[first:last] = np.unpackbits(np.frombuffer(found[bucket], np.uint8))[: last - first]
    return out


def entry_rows(
    unit: Unit, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, rest: np.ndarray, buckets: int
) -> pa.Table:
    """Distinct entries by bucket, each with the least document id that has it.

    A last row keeps all places: (start, length, number of its entry, whether the unit
    has the entry in a smaller document).
    """
    entries = Sorted(values, rest)
    ids_of = unit.ids[unit.document[starts]]
    least = entries.least(ids_of)
    later = ids_of > entries.back(least)
    rank = entries.back(np.arange(len(least), dtype=np.uint32))
    rest = rest[entries.order][entries.firsts]
    ids, index = np.unique(least, return_inverse=True)
    index = index.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
    packed_ids = zlib.compress(np.diff(ids, prepend=0).tobytes(), 1)
    rows = []
    for bucket, first, last in cuts(entries.values, 64, buckets):
        here = slice(first, last)
        low, packed = pack(below(entries.values[here], 64 - buckets), 64 - buckets)
        rows.append(
            (unit.number, bucket, last - first, low, packed,
             rest[here].tobytes(), index[here].tobytes(), packed_ids)
        )
    # Starts ascend, so their steps are small numbers.
    state = (np.diff(starts, prepend=0).astype(np.uint32), lengths.astype(np.uint16), rank)
    rows.append(
        (unit.number, -1, len(starts), 0, zlib.compress(state[0].tobytes(), 1), state[1].tobytes(),
         state[2].tobytes(), np.packbits(later).tobytes())
    )
    return rows_table(rows, ENTRIES)


class Places:
    """A unit's places from an earlier pass, with what was found out about them."""

    def __init__(self, told: pa.Table, step: int, buckets: int):
        states = [r for r in told.to_pylist() if r["step"] == -step]
        if not states:
            self.starts = self.lengths = np.empty(0, np.int64)
            self.settled = np.empty(0, bool)
            return
        n, state = states[0]["bucket"], states[0]
        self.starts = np.cumsum(np.frombuffer(zlib.decompress(state["flags"]), np.uint32).astype(np.int64))
        self.lengths = np.frombuffer(state["rest"], np.uint16).astype(np.int64)
        rank = np.frombuffer(state["document"], np.uint32)
        self.settled = np.unpackbits(np.frombuffer(state["ids"], np.uint8))[:n].astype(bool)
        # Buckets are runs of the sorted entries, so their answers follow each other.
        rows = sorted((r for r in told.to_pylist() if r["step"] == step), key=lambda r: r["bucket"])
        flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: r["n"]] for r in rows]
        if flags:
            self.settled |= np.concatenate(flags).astype(bool)[rank]

    def windows(self, settled: bool) -> np.ndarray:
        """All suffixes at places that are settled, or not."""
        which = self.settled if settled else ~self.settled
        return ranges(self.starts[which], self.lengths[which])


def stretch_rows(unit_table: pa.Table, told: pa.Table, plan: Plan) -> pa.Table:
    """Suffixes with a shared name, joined to stretches."""
    unit = Unit(unit_table)
    places, names = unit.names(plan)
    flags = answered(told, 1, names.values, plan.name_bits, plan.name_buckets)
    suffixes = unit.suffixes(plan, places[names.back(flags)])
    del places, names, flags
    if not len(suffixes):
        return rows_table([], ENTRIES)
    prints = unit.fingerprints(suffixes, plan.length, 1)
    starts = (prints & ANCHOR_MASK) == 0
    starts[0] = True
    starts[1:] |= np.diff(suffixes) != 1
    firsts = np.flatnonzero(starts)
    lengths = np.diff(np.r_[firsts, len(suffixes)])
    pieces_of = -(-lengths // STRETCH)  # long stretches are cut
    firsts = np.repeat(firsts, pieces_of) + ranges(np.zeros(len(pieces_of), np.int64), pieces_of) * STRETCH
    lengths = np.diff(np.r_[firsts, len(suffixes)])
    offset = np.arange(len(suffixes)) - np.repeat(firsts, lengths)
    values = mix(np.add.reduceat(prints * WEIGHTS[0][offset], firsts) + lengths.astype(np.uint64))
    rest = np.add.reduceat(prints * WEIGHTS[1][offset], firsts)
    rest = mix(rest + unit.fingerprints(suffixes[firsts], plan.length, 2)) >> np.uint64(32)
    return entry_rows(unit, suffixes[firsts], lengths, values, rest.astype(np.uint32), plan.stretch_buckets)


def open_suffixes(unit: Unit, told: pa.Table, plan: Plan) -> tuple[np.ndarray, Sorted]:
    """Suffixes that no stretch has settled, sorted by short fingerprints."""
    places = Places(told, 2, plan.stretch_buckets).windows(False)
    values = unit.fingerprints(places, plan.length, 1) >> np.uint64(64 - plan.short_bits)
    return places, Sorted(values)


def open_rows(unit_table: pa.Table, told: pa.Table, plan: Plan) -> pa.Table:
    unit = Unit(unit_table)
    places, short = open_suffixes(unit, told, plan)
    return short_rows(unit, short, unit.ids[unit.document[places]], plan.short_bits, plan.short_buckets)


def suffix_rows(unit_table: pa.Table, told: pa.Table, plan: Plan) -> pa.Table:
    """Suffixes whose short fingerprint several documents have."""
    unit = Unit(unit_table)
    places, short = open_suffixes(unit, told, plan)
    flags = answered(told, 3, short.values, plan.short_bits, plan.short_buckets)
    places = places[short.back(flags)]
    if not len(places):
        return rows_table([], ENTRIES)
    values = unit.fingerprints(places, plan.length, 1)
    rest = (unit.fingerprints(places, plan.length, 2) >> np.uint64(32)).astype(np.uint32)
    return entry_rows(unit, places, np.ones(len(places), np.int64), values, rest, plan.suffix_buckets)


def tied_with_smaller(table: pa.Table, step: int) -> pa.Table:
    """Of one bucket: is the entry in a document before the unit's first with it?"""
    rows = table.to_pylist()
    values, rest, least = [], [], []
    for r in rows:
        ids = np.cumsum(np.frombuffer(zlib.decompress(r["ids"]), np.int64))
        index = np.frombuffer(r["document"], np.uint16 if len(r["document"]) == 2 * r["n"] else np.uint32)
        values.append(unpack(r["n"], r["low"], r["packed"]))
        rest.append(np.frombuffer(r["rest"], np.uint32))
        least.append(ids[index])
    least = np.concatenate(least)
    ordered = Sorted(np.concatenate(values), np.concatenate(rest))
    return answers(rows, ordered.back(ordered.least(least)) < least, step)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def kept_rows(unit_table: pa.Table, told: pa.Table, plan: Plan) -> pa.Table:
    """Per document of a unit its removed spans and the bytes that are left."""
    unit = Unit(unit_table)
    found = [Places(told, 2, plan.stretch_buckets), Places(told, 4, plan.suffix_buckets)]
    starts = np.concatenate([x.starts[x.settled] for x in found])
    lengths = np.concatenate([x.lengths[x.settled] for x in found])
    gone = covered(starts, lengths + plan.length - 1, unit.size)
    spans, kept = [], []
    for first, size in zip(unit.starts.tolist(), unit.lengths.tolist()):
        mine = gone[first : first + size]
        if not mine.any():
            spans.append([])
            kept.append(unit.data[first : first + size].tobytes())
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, mine, False])).tolist()
        spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
        kept.append(unit.data[first : first + size][~mine].tobytes())
    return pa.table(
        {
            "doc_id": unit_table.column("ids")[0].values,
            "n_bytes": pa.array(unit.lengths),
            "spans": pa.array(spans, SPANS),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def unit_rows(batches, unit_bytes: int):
    """Documents packed into units of at most ``unit_bytes``, or one longer text."""
    base = TaskContext.get().partitionId() << 32
    number, ids, lengths, data = 0, [], [], []

    def unit():
        return pa.record_batch(
            [
                pa.array([base + number], pa.int64()),
                pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
                pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                pa.array([b"".join(data)], pa.binary()),
                pa.array([sum(map(len, data))], pa.int64()),
            ],
            names=["unit", "ids", "lengths", "data", "n_bytes"],
        )

    for batch, raw, offsets in pieces(batches, most=unit_bytes):
        if data and sum(map(len, data)) + len(raw) > unit_bytes:
            yield unit()
            number, ids, lengths, data = number + 1, [], [], []
        ids.append(batch.column("doc_id"))
        lengths.append(np.diff(offsets))
        data.append(raw.tobytes())
    if data:
        yield unit()


def units_table(docs: DataFrame, unit_bytes: int) -> DataFrame:
    """The units, written once and bucketed by unit: later passes shuffle no texts."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda b: unit_rows(b, unit_bytes),
        "unit long, ids array<long>, lengths array<long>, data binary, n_bytes long",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{UNITS}{uuid.uuid4().hex}"
    writer = packed.write.bucketBy(n, "unit").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "units")).saveAsTable(name)
    return spark.table(name)


def drop_units(spark) -> None:
    """Forget the tables of units of earlier runs (their files are the owner's to remove)."""
    for found in spark.catalog.listTables():
        if found.name.startswith(UNITS):
            spark.sql(f"DROP TABLE IF EXISTS {found.name}")


def deduplicated(
    docs: DataFrame,
    length: int = 50,
    unit_bytes: int = UNIT_BYTES,
    bucket_entries: int = BUCKET_ENTRIES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document row: doc_id, n_bytes, removed spans and the kept bytes.

    Spans are places in the UTF-8 bytes, ends exclusive; what is kept need not be UTF-8.
    """
    units = units_table(narrowed(docs, doc_id=doc_id, text=text), unit_bytes)
    total = units.agg(F.sum("n_bytes")).first()[0] or 0
    plan = plan_for(length, total, bucket_entries)
    by_unit = units.groupBy("unit")

    def passed(work, told: DataFrame, schema: str) -> DataFrame:
        """``work`` on every unit with all that was told about it."""
        return by_unit.cogroup(told.groupBy("unit")).applyInArrow(lambda u, t: work(u, t, plan), schema)

    def by_bucket(rows: DataFrame, work, step: int, name: str) -> DataFrame:
        found = rows.filter("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: work(t, step), ANSWERS)
        return stored(found, name)

    def and_places(entries: DataFrame, found: DataFrame, step: int) -> DataFrame:
        """Answers, and the rows of places (as step -step)."""
        places = entries.filter("bucket < 0").select(
            "unit", F.lit(-step).alias("step"), F.col("n").alias("bucket"), "n",
            F.col("packed").alias("flags"), "rest", "document", "ids",
        )
        return found.unionByName(places, allowMissingColumns=True)

    names = units.mapInArrow(lambda b: name_rows(b, plan), NAMES)
    stretches = stored(passed(stretch_rows, by_bucket(names, shared, 1, "names"), ENTRIES), "stretches")
    settled = and_places(stretches, by_bucket(stretches, tied_with_smaller, 2, "stretch-ties"), 2)
    several = by_bucket(passed(open_rows, settled, NAMES), shared, 3, "short")
    told = settled.unionByName(several, allowMissingColumns=True)
    suffixes = stored(passed(suffix_rows, told, ENTRIES), "suffixes")
    tied = and_places(suffixes, by_bucket(suffixes, tied_with_smaller, 4, "suffix-ties"), 4)
    told = settled.unionByName(tied, allowMissingColumns=True)
    kind = docs.select(doc_id).schema[0].dataType
    out = passed(
        kept_rows, told, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def digest(kept: DataFrame) -> DataFrame:
    """The contract's columns of ``deduplicated``."""
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
