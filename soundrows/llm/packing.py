"""Best-fit packing of documents into sequences of a fixed capacity.

Documents are encoded, each is closed by an end id, and only those longer than the capacity
are cut, into full pieces and a rest.  Full pieces are sequences of their own.

Method: bulk-synchronous best-fit.  Each round range-sorts the pieces still to be placed
and the gaps of the open sequences by size in one order (pieces before gaps of equal size)
and sweeps it: every gap takes the largest piece before it that no gap before has taken.
The sweep is distributed.  Tasks sum up +1 for a piece and -1 for a gap over their part of
the order, the sums of the parts before are added, and a piece and a gap match when the gap
is the first one to come down to the level of the piece.  Pieces that have the same gap as
their successor stand on different levels: that rank resolves the conflict, and the smaller
piece goes on to the next gap.  Gaps shrink by what they took, and the next round follows.

When no piece fits a gap, sequences are opened with the largest pieces: as many as the
tokens left need at least, but one for each piece over half the capacity.  While the
sequences that were opened first are filled, a round offers the largest pieces only, half
as many as there are gaps, so that small ones are left for the narrow gaps of the end.
That keeps close to the best-fit of one piece at a time, at a few dozen rounds.  The last
rounds move few rows; once pieces and gaps together are at most ``IN_ONE_TASK`` rows, the same
rounds go on in one task.

Tiny pieces far beyond the number of sequences would need a round each to fill a sequence.
When those of up to 1/16 of the capacity are more than 8 times the sequences that the tokens
need, those beyond 8 times are joined to bundles of up to 1/8 of the capacity first, which
are placed as one piece; the others stay loose for the narrow gaps.

Scale: rounds move (number, size) rows only, about 20 bytes a piece, and only those that can
match; ids stay where they were written.  A level of the sweep holds at most two rows for
each size, so no key is larger than that.  The driver sees counts by size, at most one
number for each size up to the capacity.

Defined results for odd input: a NULL or empty text is the end id alone; repeated rows and
NULL ids are documents of their own; texts of any length are encoded whole; ties between
equal sizes are resolved by piece number; an empty table gives no piece; other columns of
the input are ignored and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundrows.llm import encoders
from soundrows.llm.frames import narrowed, small_batches
from soundrows.llm.textbytes import pieces as text_pieces
from soundrows.session import durable, stored

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
OUT_BYTES = 4 << 20
#: Pieces offered for each open gap while the first sequences are filled.
OFFERED = 0.5
BUNDLED = 16  # tiny pieces are up to this part of the capacity
BUCKETS = 1 << 16
#: From so many pieces and open gaps on, the last rounds run in one task.
IN_ONE_TASK = 1 << 15
TINY_PER_SEQUENCE = 8


def encode_batches(batches, file: bytes, capacity: int, end_id: int):
    """Pieces of the documents, with their ids."""
    name = "words_" + hashlib.sha256(file).hexdigest()
    encoder = encoders.kept_by_worker(name, lambda: encoders.WordEncoder(file))
    end = np.array([end_id], "<u4")
    for batch, data, offsets in text_pieces(batches):
        values, places = encoder.ids(data, offsets)
        values = values.astype("<u4")
        rows, size = [], 0
        for k, id_ in enumerate(batch.column("id")):
            ids = np.concatenate([values[places[k] : places[k + 1]], end])
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                rows.append((id_.as_py(), piece, start, len(part), part.tobytes()))
                size += 4 * len(part)
                if size >= OUT_BYTES:
                    yield piece_batch(rows, batch)
                    rows, size = [], 0
        if rows:
            yield piece_batch(rows, batch)


def piece_batch(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, numbers, starts, lengths, tokens = zip(*rows)
    return pa.record_batch(
        [pa.array(ids, batch.schema.field("id").type), pa.array(numbers, pa.int32()),
         pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(tokens, pa.binary())],
        names=["id", "piece", "start", "length", "ids"],
    )


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All pieces: number, id, piece, start, length, ids (little-endian unsigned 32 bits).

    ``vocabulary`` is a file that the driver can read.  The frame is stored.
    """
    small_batches(docs.sparkSession)
    file = encoders.file_bytes(vocabulary or encoders.vocabulary_file(VOCABULARY))
    shared = docs.sparkSession.sparkContext.broadcast(file)
    docs = narrowed(docs, id=doc_id, text=text)
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(
        lambda batches: encode_batches(batches, shared.value, capacity, end_id),
        f"id {kind}, piece int, start long, length long, ids binary",
    )
    return stored(rows.withColumn("number", F.monotonically_increasing_id()), "pieces", compression="zstd")


def levels(batches):
    """Rows of one part of the order with the running sum of their steps inside it."""
    level = 0
    for batch in batches:
        steps = 1 - 2 * batch.column("gap").to_numpy(zero_copy_only=False).astype(np.int64)
        after = level + np.cumsum(steps)
        # A piece stands on the level it reaches, a gap on the one it leaves.
        own = np.where(steps > 0, after, after + 1)
        yield pa.record_batch([*batch.columns, pa.array(own, pa.int64()), pa.array(after, pa.int64())],
                              names=[*batch.schema.names, "level", "after"])
        level = int(after[-1]) if len(after) else level


def swept(state: DataFrame) -> DataFrame:
    """Match the pieces and gaps of ``state`` (number, size, gap).

    Adds to gaps ``piece`` and ``piece_size``, what they take, and to pieces ``matched``.
    """
    order = ["size", "gap", "number"]
    ordered = state.select("number", "size", "gap").repartitionByRange(*order).sortWithinPartitions(*order)
    local = durable(
        ordered.mapInArrow(levels, "number long, size int, gap boolean, level long, after long")
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id())
    )
    # One sum for each part: where it ends.
    ends = local.groupBy("part").agg(F.max_by("after", "place").alias("end")).collect()
    before, sums = 0, []
    for part, end in sorted((r["part"], r["end"]) for r in ends):
        sums.append((part, before))
        before += end
    offsets = F.broadcast(local.sparkSession.createDataFrame(sums, "part int, before long"))
    on_level = local.join(offsets, "part").withColumn("level", F.col("level") + F.col("before"))
    by_place = Window.partitionBy("level").orderBy("place")
    # Going up and coming down alternate on a level.
    last = F.lag(F.struct("number", "size")).over(by_place)
    return on_level.select(
        "number", "size", "gap",
        F.when(F.col("gap"), last["number"]).alias("piece"),
        F.when(F.col("gap"), last["size"]).alias("piece_size"),
        (~F.col("gap") & F.coalesce(F.lead("gap").over(by_place), F.lit(False))).alias("matched"),
    )


class Counts:
    """How many pieces wait and how many gaps are open, of each size up to the capacity."""

    def __init__(self, capacity: int):
        self.sizes = np.arange(capacity + 1)
        self.waiting, self.open = (np.zeros(capacity + 1, np.int64) for _ in range(2))

    def add(self, changes: DataFrame) -> None:
        """Add a frame of (gap, size, n)."""
        for row in changes.groupBy("gap", "size").agg(F.sum("n").alias("n")).collect():
            (self.open if row["gap"] else self.waiting)[row["size"]] += row["n"]

    def least(self) -> int:
        return int(np.flatnonzero(self.waiting)[0])

    def widest(self) -> int:
        return int(np.flatnonzero(self.open).max(initial=0))

    def needed(self) -> int:
        """Sequences that the pieces that wait need at least."""
        half = len(self.sizes) // 2
        return max(int(self.waiting[half + 1 :].sum()), -(-int((self.waiting * self.sizes).sum()) // (len(self.sizes) - 1)))


def placed(items: DataFrame, capacity: int = CAPACITY, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Place items (number, size) into sequences: number, sequence_id, offset.

    A sequence is called by the number of its first item.
    """
    items = items.select(F.col("number").cast("long").alias("number"), F.col("size").cast("int").alias("size"))
    full = items.filter(F.col("size") >= capacity)
    done = [full.select("number", F.col("number").alias("sequence_id"), F.lit(0).alias("offset"))]
    state = items.filter(F.col("size") < capacity).withColumn("gap", F.lit(False))
    counts = Counts(capacity)
    counts.add(state.withColumn("n", F.lit(1)))
    fills = 0  # how often sequences were opened
    while counts.waiting.any():
        if counts.waiting.sum() + counts.open.sum() <= in_one_task:
            done.append(finished(state, capacity, fills))
            break
        least, widest = counts.least(), counts.widest()
        if widest < least:
            state = stored(opened(state.filter("not gap"), counts, capacity), "state")
            done.append(state.filter("gap").select("number", F.col("number").alias("sequence_id"), F.lit(0).alias("offset")))
            counts = Counts(capacity)
            counts.add(state.withColumn("n", F.lit(1)))
            fills += 1
            continue
        lowest = least if fills > 1 else lowest_offered(counts)
        takes_part = (F.col("size") >= lowest) & (F.col("gap") | (F.col("size") <= widest))
        resting = ~takes_part & (~F.col("gap") | (F.col("size") >= least))
        sweep = stored(
            swept(state.filter(takes_part)).unionByName(state.filter(resting), allowMissingColumns=True), "sweep"
        )
        matches = sweep.filter("piece is not null")
        done.append(matches.select(
            F.col("piece").alias("number"), F.col("number").alias("sequence_id"),
            (F.lit(capacity) - F.col("size")).alias("offset"),
        ))
        narrowed = F.col("size") - F.col("piece_size")
        change = lambda gap, size, n: F.struct(F.lit(gap).alias("gap"), size.alias("size"), F.lit(n).alias("n"))
        counts.add(matches.select(F.inline(F.array(
            change(False, F.col("piece_size"), -1), change(True, F.col("size"), -1), change(True, narrowed, 1)
        ))))
        counts.open[:least] = 0
        size = F.when(F.col("piece").isNotNull(), narrowed).otherwise(F.col("size"))
        left = F.col("matched").isNull() | ~F.col("matched")
        state = sweep.filter(left).select("number", size.alias("size"), "gap").filter(F.col("size") > 0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def finished(state: DataFrame, capacity: int, fills: int) -> DataFrame:
    """The same rounds in one task, for a state of few rows: number, sequence_id, offset."""
    return state.coalesce(1).mapInArrow(
        lambda batches: finish(batches, capacity, fills), "number long, sequence_id long, offset int"
    )


def finish(batches, capacity: int, fills: int):
    columns = [[], [], []]
    for batch in batches:
        for column, name in zip(columns, ("number", "size", "gap")):
            column.append(batch.column(name).to_numpy(zero_copy_only=False))
    if not columns[0]:
        return
    number, size, gap = (np.concatenate(c) for c in columns)
    size, gap = size.astype(np.int64), gap.astype(bool)
    counts = Counts(capacity)
    placements = []
    while not gap.all():
        counts.waiting = np.bincount(size[~gap], minlength=capacity + 1)
        counts.open = np.bincount(size[gap], minlength=capacity + 1)
        least, widest = counts.least(), counts.widest()
        if widest < least:
            last = np.lexsort((number, -size * ~gap))[: counts.needed()]
            placements.append((number[last], number[last], np.zeros(len(last), np.int64)))
            kept = ~gap
            kept[last] = True
            gap[:] = False
            gap[last], size[last] = True, capacity - size[last]
            number, size, gap = number[kept], size[kept], gap[kept]
            fills += 1
            continue
        lowest = least if fills > 1 else lowest_offered(counts)
        order = np.lexsort((number, gap, size))
        order = order[(size[order] >= lowest) & (gap[order] | (size[order] <= widest))]
        after = np.cumsum(1 - 2 * gap[order].astype(np.int64))
        level = after + gap[order]
        by_level = order[np.lexsort((np.arange(len(order)), level))]
        level = np.sort(level)
        pair = np.flatnonzero((level[1:] == level[:-1]) & gap[by_level[1:]] & ~gap[by_level[:-1]])
        piece, taker = by_level[pair], by_level[pair + 1]
        placements.append((number[piece], number[taker], capacity - size[taker]))
        size[taker] -= size[piece]
        kept = ~gap | (size >= least)
        kept[piece] = False
        number, size, gap = number[kept], size[kept], gap[kept]
    if placements:
        placed_numbers, takers, offsets = (np.concatenate(c) for c in zip(*placements))
        yield pa.record_batch(
            [pa.array(placed_numbers), pa.array(takers), pa.array(offsets.astype(np.int32))],
            names=["number", "sequence_id", "offset"],
        )


def lowest_offered(counts: Counts) -> int:
    """The least size whose pieces, with all larger ones that fit, keep to the offer."""
    fitting = counts.waiting[: counts.widest() + 1]
    larger = np.cumsum(fitting[::-1])[::-1]
    offer = max(1, int(OFFERED * counts.open[counts.least() :].sum()))
    within = np.flatnonzero((larger <= offer) & (larger > 0))
    return int(within[0]) if len(within) else int(np.flatnonzero(fitting)[-1])


def opened(left: DataFrame, counts: Counts, capacity: int) -> DataFrame:
    """The state after sequences were opened with the largest pieces: their gaps, and the rest.

    Of the last size that is needed, numbers are taken by the order of their hashes.
    """
    needed = counts.needed()
    larger = np.cumsum(counts.waiting[::-1])[::-1]
    size = int(np.flatnonzero(larger >= needed)[-1])
    missing = needed - int(larger[size + 1 :].max(initial=0))
    bucket = F.pmod(F.xxhash64("number"), F.lit(BUCKETS))
    found = left.filter(F.col("size") == size).groupBy(bucket.alias("bucket")).count().collect()
    last = BUCKETS
    for number, count in sorted((r["bucket"], r["count"]) for r in found):
        missing -= count
        if missing <= 0:
            last = number
            break
    taken = (F.col("size") > size) | ((F.col("size") == size) & (bucket <= last))
    gap_size = F.when(taken, F.lit(capacity) - F.col("size")).otherwise(F.col("size"))
    return left.select("number", gap_size.cast("int").alias("size"), taken.alias("gap"))


def bundled(items: DataFrame, capacity: int = CAPACITY) -> DataFrame | None:
    """Tiny pieces beyond what sequences can hold in a few rounds, joined to bundles.

    None if there are not that many, else for every item: number, size, bundle (the number
    that stands for it) and inside (its offset there).
    """
    tiny = capacity // BUNDLED
    total, n_tiny = items.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum((F.col("size") <= tiny).cast("long")), F.lit(0))
    ).first()
    loose = TINY_PER_SEQUENCE * (-(-total // capacity))
    if n_tiny <= loose:
        return None
    share = int(BUCKETS * loose / n_tiny)
    joins = (F.col("size") <= tiny) & (F.pmod(F.xxhash64("number"), F.lit(BUCKETS)) >= share)
    items = items.select(F.col("number").cast("long").alias("number"), F.col("size").cast("int").alias("size"))
    order = ["size", "number"]
    small = items.filter(joins).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = small.mapInArrow(lambda batches: bundles(batches, tiny), "number long, size int, bundle long, inside int")
    alone = items.filter(~joins).select("number", "size", F.col("number").alias("bundle"), F.lit(0).alias("inside"))
    return stored(alone.unionByName(joined), "bundles")


def bundles(batches, most: int):
    """Join neighbours: a bundle ends when it has ``most`` tokens or the task's batch ends."""
    for batch in batches:
        if batch.num_rows:
            numbers, sizes = (batch.column(c).to_numpy() for c in ("number", "size"))
            before = np.cumsum(sizes.astype(np.int64)) - sizes
            bundle = before // most
            first = np.searchsorted(bundle, bundle)  # its first member
            yield pa.record_batch(
                [batch.column("number"), batch.column("size"), pa.array(numbers[first], pa.int64()),
                 pa.array((before - before[first]).astype(np.int32))],
                names=["number", "size", "bundle", "inside"],
            )


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with their sequence_id and their offset in it."""
    sizes = pieces.select("number", F.col("length").cast("int").alias("size"))
    joined = bundled(sizes, capacity)
    if joined is None:
        return pieces.join(placed(sizes, capacity), "number")
    wholes = stored(joined.groupBy(F.col("bundle").alias("number")).agg(F.sum("size").alias("size")), "wholes")
    places = placed(wholes, capacity).withColumnRenamed("number", "bundle")
    members = joined.join(places, "bundle").select(
        "number", "sequence_id", (F.col("offset") + F.col("inside")).alias("offset")
    )
    return pieces.join(members, "number")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, end to end: sequence_id, length, ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda out, part: F.concat(out, part["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"))


def digest(pieces: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id") -> DataFrame:
    """Pack the pieces; per piece where it is and the CRC-32 of its ids, which are not moved."""
    rows = pieces.select(
        "number", F.col("id").alias(doc_id), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return packed(rows, capacity).drop("number").withColumn("offset", F.col("offset").cast("long"))
