"""Sets of word shingles, as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np

from soundrows.llm.textbytes import NOT_SPACE, Words

WIDTH = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    raw = b"".join(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest() for i in range(n))
    return np.frombuffer(raw, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once."""
    encoded = words.array().dictionary_encode()
    raw = b"".join(
        hashlib.blake2b(word, digest_size=8).digest() for word in encoded.dictionary.to_pylist()
    )
    return np.frombuffer(raw, np.uint64)[encoded.indices.to_numpy()]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Per text its distinct shingles: sorted hashes of ``width`` words in a row.

    A text with fewer words has one shingle, all its words; a text without words none.
    """
    words = Words(data, offsets, NOT_SPACE)
    if not len(words):
        return [np.empty(0, np.uint64)] * len(words.counts)
    factors = constants(width, 5)
    hashes = word_hashes(words)
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + n] * factors[j]
    rolled = mix(rolled)
    out = []
    for first, last in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        if last - first >= width:
            out.append(np.unique(rolled[first : last - width + 1]))
        elif last > first:
            own = (hashes[first:last] * factors[: last - first]).sum(dtype=np.uint64)
            out.append(mix(own[None] + np.full(1, last - first, np.uint64) * GOLDEN))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int, seed: int = 1) -> np.ndarray:
    """MinHash: per set and coordinate the least value of a hash, as 32 bits of it.

    Empty sets get zeros.
    """
    out = np.zeros((len(sets), coordinates), np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    every = np.concatenate([sets[i] for i in full])
    firsts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    for j, (a, b) in enumerate(zip(constants(coordinates, seed), constants(coordinates, seed + 1))):
        values = (every ^ b) * a
        values ^= values >> np.uint64(29)
        least = np.minimum.reduceat(values * GOLDEN, firsts)
        out[full, j] = ((least * a) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Is 100 * intersection >= percent * union of two sorted sets?"""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both)
