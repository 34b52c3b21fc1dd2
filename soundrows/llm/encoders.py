"""Token ids of whole texts, with each distinct chunk encoded once per worker.

A text is cut where a tokenizer can join nothing across the cut, and the ids of the chunks
are put end to end.  Chunks repeat as words do: the distinct ones of a piece of text are
looked up in a table that the Python worker keeps from task to task, and only unknown ones
are encoded.  Long chunks are not kept and a full table is started anew, so memory is bounded.
"""

from __future__ import annotations

import json
import os
import sys
import types
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from soundrows.llm.textbytes import byte_set, ranges

MOST_FILE_BYTES = 64 << 20
MOST_KEPT = 1 << 20  # chunks of a table
LONGEST_KEPT = 64  # bytes of a chunk that is kept

#: Bytes that every tokenizer used here treats as white space.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A))
SENTENCE_MARKS = byte_set((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F))
#: First bytes of characters that are not white space: printable ASCII, and all but the
#: blocks that hold white space or control characters (U+0080, U+1000, U+2000, U+3000).
PLAIN_FIRST = byte_set((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
FIRST = byte_set((0x00, 0x7F), (0xC0, 0xFF))

#: Second bytes of the signs U+00D7 and U+00F7.
TIMES_OR_DIVIDED = byte_set((0x97, 0x97), (0xB7, 0xB7))

Encode = Callable[[list[bytes]], Sequence[tuple[Sequence[int], ...]]]


def vocabulary_file(name: str) -> str:
    """Where a file of the installed public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    """A vocabulary file, to be broadcast; its size is checked."""
    if (size := Path(path).stat().st_size) > MOST_FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {MOST_FILE_BYTES}")
    return Path(path).read_bytes()


def kept_by_worker(name: str, make: Callable):
    """What a Python worker makes once and keeps for its later tasks."""
    home = sys.modules.setdefault("_soundrows_worker", types.ModuleType("_soundrows_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


class Ragged:
    """Rows of numbers end to end."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def rows(self, numbers: np.ndarray) -> Ragged:
        lengths = self.lengths[numbers]
        return Ragged(self.values[ranges(self.starts[numbers], lengths)], lengths)

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(
            np.concatenate([self.values, other.values]), np.concatenate([self.lengths, other.lengths])
        )


def ragged(rows: Sequence[Sequence[int]]) -> Ragged:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return Ragged(np.fromiter((x for row in rows for x in row), np.int32, int(lengths.sum())), lengths)


class ChunkTable:
    """Ids of distinct chunks by one or more tokenizers (``sides`` of them).

    ``encode`` gives for each of a list of chunks a tuple with the ids of every side.
    """

    def __init__(self, encode: Encode, sides: int = 1):
        self.encode, self.sides = encode, sides
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_binary())
        self.ids = [ragged([])] * self.sides

    def of(self, chunks: pa.LargeBinaryArray) -> list[Ragged]:
        """Per side the ids of distinct chunks."""
        if len(self.keys) >= MOST_KEPT:
            self.clear()
        known = pc.index_in(chunks, value_set=self.keys)
        unknown = known.is_null().to_numpy(zero_copy_only=False)
        fresh = chunks.filter(pa.array(unknown))
        rows = self.encode(fresh.to_pylist())
        more = [ragged([row[side] for row in rows]) for side in range(self.sides)]
        places = np.empty(len(chunks), np.int64)
        places[~unknown] = known.drop_null().to_numpy()
        places[unknown] = len(self.keys) + np.arange(len(fresh))
        both = [old + new for old, new in zip(self.ids, more)]
        out = [side.rows(places) for side in both]
        short = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= LONGEST_KEPT)
        self.keys = pa.concat_arrays([self.keys, fresh.take(pa.array(short))])
        self.ids = [old + new.rows(short) for old, new in zip(self.ids, more)]
        return out


def encoded(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cut: np.ndarray, table: ChunkTable
) -> tuple[list[Ragged], np.ndarray]:
    """Ids of several texts: per side the ids of every chunk, and the first chunk of each text.

    Chunks are runs of bytes that are ``inside``, cut before each place of ``cut``.
    """
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[begins] = inside[begins]
    first_byte = np.flatnonzero(starts)
    firsts = np.searchsorted(first_byte, offsets)
    before = np.cumsum(inside)
    places = np.append(before[first_byte] - 1, before[-1] if len(before) else 0).astype(np.int64)
    letters = np.ascontiguousarray(data[inside])
    chunks = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first_byte), [None, pa.py_buffer(places), pa.py_buffer(letters)]
    ).dictionary_encode()
    numbers = chunks.indices.to_numpy()
    return [side.rows(numbers) for side in table.of(chunks.dictionary)], firsts


def between_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of blanks between two characters that surely are no white space, in one text.

    Byte-level and piece vocabularies join nothing across such a blank, and both give the
    word after it as they would give it at the start of a text.
    """
    places = np.flatnonzero(data == 0x20)
    places = places[(places > 0) & (places < len(data) - 1)]
    back = places - 1
    for _ in range(3):  # the first byte of the character before
        back = np.where(FIRST[data[back]], back, np.maximum(back - 1, 0))
    good = PLAIN_FIRST[data[back]] & PLAIN_FIRST[data[places + 1]]
    good &= ~np.isin(places, offsets) & ~np.isin(places + 1, offsets)
    return places[good]


def json_tokenizer(file: bytes, plain_specials: bool):
    """A tokenizer of the tokenizers library that works in this thread alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file.decode())
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def piece_tokenizer(file: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=file)


class WordEncoder:
    """Ids by a vocabulary that lower-cases and drops white space (its words end in a mark).

    Texts are cut at blanks, tabs and line breaks, and between a letter and a sentence mark.
    Chunks of Latin letters need no normalisation beyond lower case, so they go straight to
    the vocabulary's merges; all others take the whole way.
    """

    def __init__(self, file: bytes):
        self.tokenizer = json_tokenizer(file, plain_specials=False)
        self.model = self.tokenizer.model
        stands_for = {b: c for c, b in byte_level_bytes().items()}
        accented = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.byte_level = str.maketrans({c: "".join(stands_for[b] for b in c.encode()) for c in accented})
        self.table = ChunkTable(self.encode)

    def encode(self, chunks: list[bytes]) -> list[tuple[list[int]]]:
        return [(self.one(chunk.decode()),) for chunk in chunks]

    def one(self, chunk: str) -> list[int]:
        if len(chunk) <= LONGEST_KEPT and chunk.isalpha() and max(chunk) <= "ÿ" and not LATIN_OTHER & set(chunk):
            return [token.id for token in self.model.tokenize(chunk.lower().translate(self.byte_level))]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts end to end, and the n + 1 places of the texts in them."""
        letter = LETTERS[data]
        accent = data == 0xC3  # first bytes of U+00C0 to U+00FF, but for two signs
        accent[:-1] &= ~TIMES_OR_DIVIDED[data[1:]]
        letter |= accent
        letter[1:] |= accent[:-1]
        mark = SENTENCE_MARKS[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        [rows], firsts = encoded(data, offsets, ~BLANKS[data], cut, self.table)
        ends = np.concatenate([[0], np.cumsum(rows.lengths)])
        return rows.values, ends[firsts]


#: Letters of Latin-1 that are no plain letters of a word: ordinal signs and micro.
LATIN_OTHER = {"ª", "º", "µ"}


def byte_level_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes take the characters
    from U+0100 on in their order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(file: bytes) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens are their text."""
    content = json.loads(file)
    to_byte = byte_level_bytes()
    added = {token["id"]: token["content"].encode() for token in content["added_tokens"]}
    tokens = {i: bytes(to_byte[c] for c in t) for t, i in content["model"]["vocab"].items() if i not in added}
    tokens |= added
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def piece_tokens(processor) -> list[bytes]:
    """The bytes of every id of a piece vocabulary with byte fallback."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


def joins_words(tokens: list[bytes]) -> bool:
    """Does any piece have a blank after another character?  Then texts must not be cut."""
    return any(b" " in token.lstrip(b" ") for token in tokens)
