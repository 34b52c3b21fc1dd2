"""Benchmark decontamination by suffix arrays over shards of the training texts.

The benchmark is the stated query set.  Every task cuts its documents into shards, builds
a suffix array over the word suffixes of each shard and binary-searches all benchmark
suffixes in it.  A range of the suffix array gives the places of a benchmark window;
places are extended word by word to the longest verbatim matches.

Scale: documents are scanned once per benchmark block and never shuffled.  A block holds a
bounded number of benchmark bytes (one longer item makes a block of its own) and is the
only thing broadcast; a larger benchmark means more blocks, not a larger broadcast.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results for odd input: a NULL or empty text has no words and no matches; an item
without words matches nothing; an item shorter than the window is one window; repeated
documents are judged one by one; repeated items give their id once; an item without an id
matches but adds nothing to the list of ids; an empty table gives an empty result.
Extra columns, whatever their names, are kept by ``decontaminate`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import Renamed, narrowed, small_batches
from soundrows.llm.textbytes import ALPHANUMERIC, Words, covered, pieces, ranges
from soundrows.session import stored

WINDOW = 10
BLOCK_BYTES = 16 << 20
ANCHOR = 3
PAIRS_AT_ONCE = 1 << 20


class Block:
    """Part of the benchmark, ready to be searched for.

    ``text`` holds the word numbers of all items (0 ends an item).  ``starts`` are the
    suffixes that begin a whole window, ``window_of`` their distinct window.
    """

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        self.window = window
        self.ids = ids
        data = pa.array(texts, pa.large_string())
        chunk = next(pieces([pa.record_batch({"text": data})], most=1 << 62), None)
        words = Words(chunk[1], chunk[2], ALPHANUMERIC) if chunk else None
        if not words or not len(words):
            self.vocabulary = []
            return
        encoded = words.array().dictionary_encode()
        self.vocabulary = encoded.dictionary.to_pylist()
        self.text = separated(encoded.indices.to_numpy().astype(np.int64) + 1, words, window)
        begins = words.firsts[:-1] + np.arange(len(words.counts))
        own = np.minimum(words.counts, window)
        n_starts = np.where(words.counts > 0, words.counts - own + 1, 0)
        self.starts = ranges(begins, n_starts)
        self.item_of = np.repeat(np.arange(len(words.counts)), n_starts)
        lengths = own[self.item_of]
        self.bits = len(self.vocabulary).bit_length()
        self.per_key = 62 // self.bits
        places = np.arange(window)
        heads = np.where(
            places < lengths[:, None], self.text[self.starts[:, None] + places], 0
        )
        rows = np.column_stack([heads, lengths])
        distinct, self.window_of = np.unique(rows, axis=0, return_inverse=True)
        self.window_of = self.window_of.reshape(-1)
        self.lengths = distinct[:, -1]
        top = (1 << self.bits) - 1
        self.low = self.keys(distinct[:, :-1])
        self.high = self.keys(
            np.where(places < self.lengths[:, None], distinct[:, :-1], top)
        )
        order = np.argsort(self.window_of, kind="stable")
        self.suffixes = order  # suffixes of window u: order[bounds[u]:bounds[u + 1]]
        self.bounds = np.searchsorted(self.window_of[order], np.arange(len(distinct) + 1))
        self.anchor = min(ANCHOR, int(self.lengths.min()), self.per_key)
        self.anchors = np.unique(self.packed(distinct, 0, self.anchor))

    def packed(self, rows: np.ndarray, first: int, last: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        for j in range(first, last):
            key = (key << self.bits) | rows[:, j]
        return key

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """The words of each row as a few integers that sort in the same way."""
        return [
            self.packed(rows, j, min(j + self.per_key, self.window))
            for j in range(0, self.window, self.per_key)
        ]


def separated(codes: np.ndarray, words: Words, pad: int) -> np.ndarray:
    """Word numbers with a 0 after each text and ``pad`` more at the end."""
    out = np.zeros(len(codes) + len(words.counts) + pad, np.int64)
    out[np.arange(len(codes)) + words.text_numbers()] = codes
    return out


def below(keys: list, places: np.ndarray, wanted: list, equal: bool) -> np.ndarray:
    """Is the suffix at each place smaller than (or ``equal`` to) the wanted key?"""
    less = np.zeros(len(places), bool)
    same = np.ones(len(places), bool)
    for have, want in zip(keys, wanted):
        value = have[places]
        less |= same & (value < want)
        same &= value == want
    return less | same if equal else less


def bound(keys: list, wanted: list, after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once in the sorted suffixes."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while True:
        active = np.flatnonzero(low < high)
        if not len(active):
            return low
        middle = (low[active] + high[active]) // 2
        go = below(keys, middle, [w[active] for w in wanted], after)
        low[active[go]] = middle[go] + 1
        high[active[~go]] = middle[~go]


class Shard:
    """The suffix array of some documents, restricted to suffixes that can match.

    A suffix takes part when its first ``anchor`` words begin a benchmark window; no
    other suffix can match a whole window.  Suffixes are sorted by their first
    ``window`` words, ties stay in text order.
    """

    def __init__(self, words: Words, codes: np.ndarray, block: Block):
        self.block = block
        self.firsts = words.firsts + np.arange(len(words.firsts))
        self.text = separated(codes, words, block.window)
        n = len(self.text) - block.window
        key = np.zeros(n, np.int64)
        usable = np.ones(n, bool)
        for j in range(block.anchor):
            part = self.text[j : j + n]
            key = (key << block.bits) | part
            usable &= part > 0
        usable = np.flatnonzero(usable)
        key = key[usable]
        found = np.searchsorted(block.anchors, key)
        found[found == len(block.anchors)] = 0
        suffixes = usable[block.anchors[found] == key]
        keys = block.keys(self.text[suffixes[:, None] + np.arange(block.window)])
        order = np.lexsort(keys[::-1])
        self.array = suffixes[order]
        keys = [k[order] for k in keys]
        self.low = bound(keys, block.low, False)
        self.high = bound(keys, block.high, True)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows and the window at each."""
        counts = self.high - self.low
        return self.array[ranges(self.low, counts)], np.repeat(np.arange(len(counts)), counts)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1

    def matches(self, places: np.ndarray, windows: np.ndarray) -> Iterator[tuple]:
        """Maximal verbatim matches: (place, benchmark suffix, words), a slice at a time."""
        block = self.block
        counts = block.bounds[windows + 1] - block.bounds[windows]
        ends = np.cumsum(counts)
        first = 0
        while first < len(places):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
            here = slice(first, last)
            place = np.repeat(places[here], counts[here])
            suffix = block.suffixes[ranges(block.bounds[windows[here]], counts[here])]
            start = block.starts[suffix]
            # A match that goes on to the left is part of a longer one.
            inner = (
                (start > 0)
                & (place > 0)
                & (block.text[start - 1] == self.text[place - 1])
                & (block.text[start - 1] > 0)
            )
            inner &= block.item_of[suffix] == block.item_of[np.maximum(suffix - 1, 0)]
            place, suffix, start = place[~inner], suffix[~inner], start[~inner]
            length = block.lengths[block.window_of[suffix]].copy()
            active = np.arange(len(place))
            while len(active):
                mine = self.text[place[active] + length[active]]
                theirs = block.text[start[active] + length[active]]
                active = active[(mine == theirs) & (mine > 0)]
                length[active] += 1
            yield place, suffix, length
            first = last


def codes_of(words: Words, vocabulary: pa.Array) -> np.ndarray:
    """Benchmark number of each word, 0 for words that the benchmark does not have."""
    found = pc.index_in(words.array(), value_set=vocabulary)
    return pc.fill_null(found, -1).to_numpy().astype(np.int64) + 1


def shards(batches, block: Block, text: str = "text"):
    """Each piece of a task's documents with its suffix array (None: nothing to match)."""
    vocabulary = pa.array(block.vocabulary, pa.large_binary())
    for batch, data, offsets in pieces(batches, text):
        words = Words(data, offsets, ALPHANUMERIC)
        shard = None
        if block.vocabulary and len(words):
            shard = Shard(words, codes_of(words, vocabulary), block)
        yield batch, words, shard


JUDGED = "doc_id {0}, n_words long, hits array<int>, items array<string>, longest int"


def judge(batches, block: Block):
    """Per document: hit words (their numbers), the items found and the longest match."""
    for batch, words, shard in shards(batches, block):
        n = batch.num_rows
        hits: list = [[]] * n
        items: list = [[]] * n
        longest = np.zeros(n, np.int64)
        if shard is not None:
            places, windows = shard.occurrences()
            if len(places):
                flags = covered(places, block.lengths[windows], len(shard.text))
                docs = shard.documents(places)
                order = np.argsort(docs, kind="stable")
                touched, begins = np.unique(docs[order], return_index=True)
                for doc, here in zip(touched, np.split(windows[order], begins[1:])):
                    of_doc = flags[shard.firsts[doc] : shard.firsts[doc + 1]]
                    hits[doc] = np.flatnonzero(of_doc).astype(np.int32)
                    here = np.unique(here)
                    counts = block.bounds[here + 1] - block.bounds[here]
                    found = np.unique(block.item_of[block.suffixes[ranges(block.bounds[here], counts)]])
                    named = {block.ids[i] for i in found.tolist()} - {None}
                    items[doc] = sorted(str(i) for i in named)
                for place, _, length in shard.matches(places, windows):
                    np.maximum.at(longest, shard.documents(place), length)
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(words.counts, pa.int64()),
                pa.array(hits, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.string())),
                pa.array(longest.astype(np.int32)),
            ],
            names=["doc_id", "n_words", "hits", "items", "longest"],
        )


def list_matches(batches, block: Block):
    """Every maximal match as a row, and nothing for the other documents."""
    for batch, words, shard in shards(batches, block):
        if shard is None:
            continue
        ids = batch.column("doc_id")
        for place, suffix, length in shard.matches(*shard.occurrences()):
            docs = shard.documents(place)
            item = block.item_of[suffix]
            item_first = np.searchsorted(block.item_of, item)
            yield pa.record_batch(
                [
                    ids.take(pa.array(docs)),
                    pa.array([None if block.ids[i] is None else str(block.ids[i]) for i in item.tolist()], pa.string()),
                    pa.array((place - shard.firsts[docs]).astype(np.int64)),
                    pa.array((block.starts[suffix] - block.starts[item_first]).astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                ],
                names=["doc_id", "item_id", "doc_word", "item_word", "n_words"],
            )


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes``; items are dealt by a hash."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    dealt = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    for number in range(n):
        rows = benchmark.filter(dealt == number).collect()
        yield Block([r["item_id"] for r in rows], [r["text"] for r in rows], window)


def broadcast_blocks(docs, benchmark, window, block_bytes, work, schema):
    """``work`` over all documents for each benchmark block."""
    spark = docs.sparkSession
    small_batches(spark)
    frames = []
    for block in blocks(benchmark, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        frames.append(docs.mapInArrow(lambda b, shared=shared: work(b, shared.value), schema))
    return frames


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted ids), longest match.

    With more than one benchmark block the rows are numbered and stored once, so that the
    hit words of the blocks can be united per row.
    """
    docs = narrowed(docs, doc_id=doc_id, text=text)
    benchmark = narrowed(benchmark, item_id=item_id, text=item_text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = JUDGED.format(kind)
    parts = broadcast_blocks(docs, benchmark, window, block_bytes, judge, schema)
    if len(parts) == 1:
        return parts[0].select(
            "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items", "longest"
        )
    rows = stored(
        docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc_id"), "text"),
        "decontaminate",
    )
    schema = JUDGED.format(rows.schema["doc_id"].dataType.simpleString())
    parts = broadcast_blocks(rows, benchmark, window, block_bytes, judge, schema)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    union = lambda name: F.array_distinct(F.flatten(F.collect_list(name)))
    return every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.size(union("hits")).cast("long").alias("n_hit"),
        F.array_sort(union("items")).alias("items"),
        F.max("longest").alias("longest"),
    ).select("doc_id.doc_id", "n_words", "n_hit", "items", "longest")


def verbatim_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Maximal verbatim matches of at least a window: where they begin and their words."""
    docs = narrowed(docs, doc_id=doc_id, text=text)
    benchmark = narrowed(benchmark, item_id=item_id, text=item_text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long"
    parts = broadcast_blocks(docs, benchmark, window, block_bytes, list_matches, schema)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def keep_clean(batches, block: Block, text: str):
    """The rows without any benchmark window."""
    for batch, words, shard in shards(batches, block, text):
        if shard is None:
            yield batch
            continue
        keep = np.ones(batch.num_rows, bool)
        keep[shard.documents(shard.occurrences()[0])] = False
        yield batch.filter(pa.array(keep))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    small_batches(docs.sparkSession)
    renamed = Renamed(docs)
    column = renamed.name(text)
    kept = renamed.frame
    for block in blocks(narrowed(benchmark, item_id=item_id, text=item_text), window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        kept = kept.mapInArrow(
            lambda b, shared=shared: keep_clean(b, shared.value, column), kept.schema
        )
    return renamed.back(kept)


def digest(frame: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    return frame.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
