"""Texts of an Arrow batch as one byte buffer, and their words as offsets into it.

All helpers run inside tasks.  A batch is worked off in pieces of a bounded number of
bytes (one longer text makes a piece of its own), so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 8 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True inside the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def as_text(column) -> pa.LargeStringArray:
    """One array of texts with 64-bit offsets; NULL becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts."""
    texts = as_text(column)
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches, column: str = "text", most: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        data, offsets = buffer_of(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            here = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[here[0] : here[-1]], here - here[0]
            first = last


class Words:
    """Words of several texts.

    ``letters`` holds the (lower-cased) word bytes without separators, ``places`` the
    n + 1 offsets of the words in it, ``counts`` the words per text and ``firsts`` the
    number of the first word of each text (and the total at the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        inside = word_bytes[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        starts[begins] = inside[begins]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        lasts = begins[1:] - 1
        ends[lasts] = inside[lasts]
        first_byte = np.flatnonzero(starts)
        lengths = np.flatnonzero(ends) + 1 - first_byte
        self.letters = LOWER[data[inside]]
        self.places = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=self.places[1:])
        self.firsts = np.searchsorted(first_byte, offsets)
        self.counts = np.diff(self.firsts)

    def __len__(self) -> int:
        return len(self.places) - 1

    def array(self) -> pa.LargeBinaryArray:
        """The words as an Arrow array over the same memory."""
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(),
            len(self),
            [None, pa.py_buffer(self.places), pa.py_buffer(np.ascontiguousarray(self.letters))],
        )

    def text_numbers(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the runs ``starts[i] ... starts[i] + lengths[i] - 1``, end to end."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def covered(starts: np.ndarray, lengths: np.ndarray | int, size: int) -> np.ndarray:
    """Flags of the places 0 ... size - 1 that lie in any of the runs."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.subtract.at(change, starts + lengths, 1)
    return np.cumsum(change[:-1]) > 0


def runs(
    data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` member bytes that stay inside one text."""
    inside = members[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[begins] = inside[begins]
    ends[begins[1:] - 1] = inside[begins[1:] - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = last - first >= least
    return first[long], last[long]
