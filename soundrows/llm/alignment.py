"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

A text is encoded by a byte-level vocabulary (A, of a blank and the text) and by a piece
vocabulary (B, which adds that blank itself).  Both give the ends of their tokens as byte
offsets.  Offsets where both end cut the tokens into groups.

Method: diagonal run skipping.  From a common end, with the current shift between the
indices of A and B, stretches of equal ends are found by exponential probing: whole slices
of the two end arrays are compared, of 4, 8, 16, ... ends, and the last slice is halved.  A
stretch is so many groups of one token each.  Where ends differ, the group is resolved
locally: the side that ends first goes on, until both end together; the shift has changed.
Each step of this staircase is one link, a pair of tokens whose byte ranges overlap.

Plan: tasks encode, align and count; they store a row per document (tokens, groups, links
by id pair) and partial sums of the links by id pair.  The sums are added in one shuffle
and stay distributed.  To give the counts back to documents, the most frequent pairs (at
most ``MOST_COMMON`` of them, chosen by a threshold of which the driver knows the count)
are broadcast; all other pairs of a document are joined by shuffle.  So no pair that stands
in every text makes a hot key, and no table that grows with the corpus is broadcast.

Defined results for odd input: texts that are NULL, empty, or that one of the vocabularies
does not give back byte by byte have no tokens, groups or links.  Texts of any length are
aligned whole, one at a time (memory follows the longest).  Ties for the highest count all
count as best.  Repeated rows and NULL ids are rows of their own.  An empty table gives
empty results; other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.llm import encoders
from soundrows.llm.frames import narrowed, small_batches
from soundrows.llm.textbytes import pieces, ranges
from soundrows.session import stored

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Pairs whose counts are broadcast, at most; 16 bytes each.
MOST_COMMON = 1 << 18
#: Pairs that a task adds up before it hands them on.
MOST_SUMS = 1 << 20
#: Bits of a pair's number that hold the id of B.
B_BITS = 24
OUT_BYTES = 4 << 20
END = 8  # bytes of an end
FIRST_PROBE = 4  # ends of the first slice


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Align two arrays of increasing byte ends whose last ends are equal.

    Gives the indices of A's and of B's tokens for every link, and for each side the
    indices of the tokens that do not end a group.
    """
    flat_a, flat_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n, m = len(list_a), len(list_b)
    run_a, run_b, run_lengths = [], [], []
    link_a, link_b, inner_a, inner_b = [], [], [], []
    i = j = 0
    while i < n:
        x, y = list_a[i], list_b[j]
        if x == y:
            run = stretch(flat_a, flat_b, i, j, min(n - i, m - j))
            run_a.append(i)
            run_b.append(j)
            run_lengths.append(run)
            i += run
            j += run
            continue
        while x != y:
            link_a.append(i)
            link_b.append(j)
            if x < y:
                inner_a.append(i)
                i += 1
                x = list_a[i]
            else:
                inner_b.append(j)
                j += 1
                y = list_b[j]
        link_a.append(i)
        link_b.append(j)
        i += 1
        j += 1
    lengths = np.array(run_lengths, np.int64)
    whole_a = ranges(np.array(run_a, np.int64), lengths)
    whole_b = ranges(np.array(run_b, np.int64), lengths)
    return (
        np.concatenate([whole_a, np.array(link_a, np.int64)]),
        np.concatenate([whole_b, np.array(link_b, np.int64)]),
        np.array(inner_a, np.int64),
        np.array(inner_b, np.int64),
    )


def stretch(flat_a: bytes, flat_b: bytes, i: int, j: int, room: int) -> int:
    """How many ends from i and j on are equal: the first is; slices double, then halve."""
    at_a, at_b, most, run, step = END * i, END * j, END * room, END, END * FIRST_PROBE
    while run + step <= most and flat_a[at_a + run : at_a + run + step] == flat_b[at_b + run : at_b + run + step]:
        run += step
        step *= 2
    while step > END:
        step //= 2
        if run + step <= most and flat_a[at_a + run : at_a + run + step] == flat_b[at_b + run : at_b + run + step]:
            run += step
    return run // END


def written(ids_a: np.ndarray, ids_b: np.ndarray, inner_a: np.ndarray, inner_b: np.ndarray) -> bytes:
    """The groups as text: ids of A, a bar, ids of B; groups with semicolons between."""
    last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    last_a[inner_a] = False
    last_b[inner_b] = False
    after_a, after_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    first_b = np.concatenate([[0], after_b[:-1]])
    size = len(ids_a) + len(ids_b)
    ids, marks = np.empty(size, np.int64), np.empty(size, np.uint8)
    places_a = np.arange(len(ids_a)) + first_b[group_a]
    places_b = np.arange(len(ids_b)) + after_a[group_b]
    ids[places_a], ids[places_b] = ids_a, ids_b
    marks[places_a] = np.where(last_a, ord("|"), ord(","))
    marks[places_b] = np.where(last_b, ord(";"), ord(","))
    width = len(str(int(ids.max())))
    letters = np.empty((size, width + 1), np.uint8)
    shown = np.ones((size, width + 1), bool)
    left = ids
    for k in range(width - 1, -1, -1):
        shown[:, k] = (left > 0) | (k == width - 1)
        left, digit = np.divmod(left, 10)
        letters[:, k] = digit + ord("0")
    letters[:, width] = marks
    return letters[shown].tobytes()[:-1]


class Aligner:
    """Encodes texts by two vocabularies; made once per worker."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.a, self.b = encoders.json_tokenizer(file_a, plain_specials=True), encoders.piece_tokenizer(file_b)
        self.tokens_a, self.tokens_b = encoders.byte_level_tokens(file_a), encoders.piece_tokens(self.b)
        self.lengths_a = np.array([len(t) for t in self.tokens_a], np.int64)
        self.lengths_b = np.array([len(t) for t in self.tokens_b], np.int64)
        self.cuts = not encoders.joins_words(self.tokens_b)
        self.table = encoders.ChunkTable(self.encode, sides=2)

    def encode(self, chunks: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a side does not give the bytes back."""
        texts = [chunk.decode() for chunk in chunks]
        out = []
        for chunk, text, b in zip(chunks, texts, self.b.encode(texts, num_threads=1)):
            a = self.a.encode(" " + text, add_special_tokens=False).ids
            raw = b" " + chunk
            same_bytes = given_back(self.tokens_a, a) == raw == given_back(self.tokens_b, b)
            out.append((a, b) if same_bytes else ([], []))
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Per text the ids of both sides, or None when it has no tokens."""
        inside = np.ones(len(data), bool)
        if self.cuts:
            inside[encoders.between_words(data, offsets)] = False
        (a, b), firsts = encoders.encoded(data, offsets, inside, np.zeros(len(data), bool), self.table)
        lost = np.concatenate([[0], np.cumsum(a.lengths == 0)])[firsts]
        places_a, places_b = (np.concatenate([[0], np.cumsum(side.lengths)])[firsts] for side in (a, b))
        for k in range(len(firsts) - 1):
            if firsts[k] == firsts[k + 1] or lost[k] < lost[k + 1]:
                yield None
            else:
                yield a.values[places_a[k] : places_a[k + 1]], b.values[places_b[k] : places_b[k + 1]]

    def of(self, found: tuple[np.ndarray, np.ndarray] | None):
        """(tokens of A, of B, groups, links, groups as text, id pairs, links of each)."""
        if found is None:
            return 0, 0, 0, 0, b"", np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = found
        link_a, link_b, inner_a, inner_b = groups(np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b]))
        pairs = (a[link_a].astype(np.int64) << B_BITS) | b[link_b]
        pairs, counts = np.unique(pairs, return_counts=True)
        text = written(a, b, inner_a, inner_b)
        return len(a), len(b), len(a) - len(inner_a), len(link_a), text, pairs, counts


def given_back(tokens: list[bytes], ids: Sequence[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


class Sums:
    """Links by pair, added up within a task."""

    def __init__(self):
        self.pairs, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((pairs, counts))
        self.waiting += len(pairs)
        if self.waiting >= MOST_SUMS:
            self.merge()

    def merge(self) -> None:
        pairs = np.concatenate([self.pairs, *[p for p, _ in self.more]])
        counts = np.concatenate([self.counts, *[c for _, c in self.more]])
        self.pairs, places = np.unique(pairs, return_inverse=True)
        self.counts = np.zeros(len(self.pairs), np.int64)
        np.add.at(self.counts, places, counts)
        self.more, self.waiting = [], 0

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All sums so far, in parts."""
        self.merge()
        for first in range(0, len(self.pairs), 1 << 16):
            yield self.pairs[first : first + (1 << 16)], self.counts[first : first + (1 << 16)]
        self.pairs, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)


COLUMNS = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<long>"


def lists(arrays: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def batch_of(kind: int, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    ids, numbers, n_a, n_b, n_groups, n_links, texts, pairs, counts = zip(*rows)
    whole = [pa.array(x, pa.int64()) for x in (numbers, n_a, n_b, n_groups, n_links)]
    return pa.record_batch(
        [pa.array([kind] * len(rows), pa.int32()), pa.array(ids, id_type), *whole,
         pa.array(texts, pa.binary()).cast(pa.string()), lists(pairs), lists(counts)],
        names=["kind", "id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts"],
    )


def align_batches(batches, file_a: bytes, file_b: bytes):
    """Documents (kind 0) and the task's sums of links by pair (kind 1)."""
    name = "aligner_" + hashlib.sha256(file_a + file_b).hexdigest()
    aligner, sums, id_type = encoders.kept_by_worker(name, lambda: Aligner(file_a, file_b)), Sums(), pa.null()
    for batch, data, offsets in pieces(batches):
        id_type = batch.schema.field("id").type
        rows, size = [], 0
        for id_, number, ids in zip(batch.column("id"), batch.column("row"), aligner.ids(data, offsets)):
            *numbers, groups_text, pairs, counts = aligner.of(ids)
            rows.append((id_.as_py(), number.as_py(), *numbers, groups_text, pairs, counts))
            sums.add(pairs, counts)
            size += len(groups_text) + 16 * len(pairs)
            if size >= OUT_BYTES:
                yield batch_of(0, rows, id_type)
                rows, size = [], 0
        if rows:
            yield batch_of(0, rows, id_type)
        if len(sums.pairs) >= MOST_SUMS:
            yield from summed(sums, id_type)
    yield from summed(sums, id_type)


def summed(sums: Sums, id_type: pa.DataType):
    for pairs, counts in sums.taken():
        yield batch_of(1, [(None, None, None, None, None, None, None, pairs, counts)], id_type)


def common_sums(batches, common: np.ndarray, counts_of: np.ndarray, best: np.ndarray):
    """Per document what the common pairs give, and the pairs that are left."""
    for batch in batches:
        rows, lefts, left_counts = [], [], []
        for pairs, counts in zip(batch.column("pairs"), batch.column("counts")):
            pairs, counts = (x.values.to_numpy(zero_copy_only=False) for x in (pairs, counts))
            places = np.minimum(np.searchsorted(common, pairs), max(len(common) - 1, 0))
            known = common[places] == pairs if len(common) else np.zeros(len(pairs), bool)
            at, n = places[known], counts[known]
            rows.append((int((n * counts_of[at]).sum()), int(n[best[at]].sum())))
            lefts.append(pairs[~known])
            left_counts.append(counts[~known])
        if rows:
            sums, bests = zip(*rows)
            yield pa.record_batch(
                [batch.column("row"), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), lists(lefts), lists(left_counts)],
                names=["row", "common_sum", "common_best", "pairs", "counts"],
            )


@dataclass(frozen=True)
class Alignment:
    """``documents``: row, id, n_a, n_b, n_groups, n_links, groups (as text), pairs, counts.

    ``pairs``: pair, a_id, b_id, n (links of this pair in all documents) and best (no other
    pair of this B id has more).
    """

    documents: DataFrame
    pairs: DataFrame

    def scores(self) -> DataFrame:
        """Per row of ``documents``: n_best and count_sum over its links."""
        spark = self.pairs.sparkSession
        common = self.common().toArrow()
        order = np.argsort(common.column("pair").to_numpy())
        shared = spark.sparkContext.broadcast(
            tuple(common.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        )
        rows = self.documents.select("row", "pairs", "counts").mapInArrow(
            lambda batches: common_sums(batches, *shared.value),
            "row long, common_sum long, common_best long, pairs array<long>, counts array<long>",
        )
        each = rows.select(
            "row", "common_sum", "common_best", F.explode_outer(F.arrays_zip("pairs", "counts")).alias("left")
        ).select(
            "row", "common_sum", "common_best",
            F.coalesce("left.pairs", -1 - F.col("row")).alias("pair"),  # a row without any is no hot key
            F.col("left.counts").alias("links"),
        )
        joined = each.join(self.pairs.select("pair", "n", "best"), "pair", "left")
        zero = F.lit(0).cast("long")
        return joined.groupBy("row").agg(
            (F.max("common_best") + F.coalesce(F.sum(F.when(F.col("best"), F.col("links"))), zero)).alias("n_best"),
            (F.max("common_sum") + F.coalesce(F.sum(F.col("links") * F.col("n")), zero)).alias("count_sum"),
        )

    def common(self) -> DataFrame:
        """The most frequent pairs: all from the least power of two on that keeps to the limit."""
        powers = self.pairs.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("power")).count().collect()
        total, least = 0, 62
        for power, count in sorted(((r["power"], r["count"]) for r in powers), reverse=True):
            total += count
            if total > MOST_COMMON:
                break
            least = power
        return self.pairs.filter(F.col("n") >= F.lit(1 << least)).select("pair", "n", "best")


def aligned(
    docs: DataFrame,
    byte_level: str | None = None,
    piece_model: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Alignment:
    """Align the texts by two vocabulary files (paths that the driver can read)."""
    spark = docs.sparkSession
    small_batches(spark)
    files = [byte_level or encoders.vocabulary_file(BYTE_LEVEL), piece_model or encoders.vocabulary_file(PIECES)]
    shared = spark.sparkContext.broadcast([encoders.file_bytes(f) for f in files])
    docs = narrowed(docs, id=doc_id, text=text)
    kind = docs.schema["id"].dataType.simpleString()
    work = stored(
        docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            lambda batches: align_batches(batches, *shared.value), f"kind int, id {kind}, {COLUMNS}"
        ),
        "alignment",
        ["kind"],
        compression="zstd",
    )
    parts = work.filter("kind = 1").select(F.explode(F.arrays_zip("pairs", "counts")).alias("part"))
    sums = stored(
        parts.groupBy(F.col("part.pairs").alias("pair")).agg(F.sum("part.counts").alias("n")).select(
            "pair",
            F.shiftright("pair", B_BITS).cast("int").alias("a_id"),
            F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("int").alias("b_id"),
            "n",
        ),
        "pairs",
    )
    highest = sums.groupBy("b_id").agg(F.max("n").alias("highest"))
    pairs = sums.join(highest, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best"))
    return Alignment(work.filter("kind = 0").drop("kind"), stored(pairs, "pairs"))


def digest(alignment: Alignment, doc_id: str = "doc_id") -> DataFrame:
    """Per document its counts and the SHA-256 of its groups ('' without tokens)."""
    sha = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    own = alignment.documents.select(
        "row", F.col("id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", sha.alias("groups_sha256")
    )
    return own.join(alignment.scores(), "row").drop("row")
