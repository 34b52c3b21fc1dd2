"""Spelling variants: words one edit apart, and the form each rare word stands for.

Words are counted over all texts; those long and frequent enough become the vocabulary.
Two words are near if one inserted, deleted or replaced code point makes them equal.

Method: a trie as a relation.  A node is a prefix of a padded word; the edge table leads from
nodes to those ``AHEAD`` code points further down.  A frontier of states (word, position,
node, edits) moves along it.  States without an edit stand on all prefixes of their own word;
each of them may take one edit there: a code point of the trie is read instead of the word's
own (replaced) or before it (inserted; deletions are insertions seen from the other word).
States with an edit go on, level by level, only along edges that read the word's next code
points.  A state that reads the end mark has come to another word: the two are near.

An edit is taken only where the next ``AHEAD`` code points can be followed, too.  The trie
itself says so: a node ``AHEAD + 1`` levels down names the node above, the code point that
was put in, and those that follow it.  So the join for an edit has the key (node, next code
points), not the node alone, and the root's edges do not multiply every word.

Each pair is found once: by the smaller code point when one is replaced, by the shorter word
when one is inserted, before a different code point.  Every step is one join of the frontier
with the edge table by both sides' keys; keys repeat at most as often as words share
``AHEAD`` code points at a place, and adaptive execution splits the frequent ones.  Steps go
on until the frontier is empty, at most ``LONGEST / AHEAD`` times.

Words longer than ``LONGEST`` code points would need a level for each; their pairs are found
by the other way to be one edit apart: both give the same text when one code point is left
out.  The fingerprints of all these texts (of one word in linear time, by sums of powers) are
joined, and every pair found is compared itself.

Forms are chosen by one aggregate over the pairs; roots by following forms, two steps at a
time, until nothing changes (n grows tenfold with each step, so a chain is short).

Defined results for odd input: NULL and empty texts have no words; NULL ids write as an empty
text in the hash that picks deletions; repeated rows count again; ties for the best form go
to the smallest in code-point order; an empty table gives an empty vocabulary; texts and
words of any length count whole; other columns of the input are ignored and may have any
name.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import narrowed, small_batches
from soundrows.llm.textbytes import pieces as text_pieces
from soundrows.session import stored

LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES_MORE = 10
#: Words with so many code points at most are searched in the trie.
LONGEST = 32
AHEAD = 4
END = " "  # no letter of a word, and smaller than all of them
#: One of so many (document, word) pairs loses a code point.
DELETED_ONE_IN = 31
MOST_COUNTED = 1 << 17  # words that a task counts before it hands them on

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
FIRST_OF_ACCENTED = 0xC3  # the first byte of U+00C0 to U+00FF


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Runs of letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z; the first of each text."""
    inside = LETTERS[data]
    accented = data == FIRST_OF_ACCENTED
    inside |= accented
    inside[1:] |= accented[:-1]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[begins] = inside[begins]
    first_byte = np.flatnonzero(starts)
    before = np.cumsum(inside)
    places = np.append(before[first_byte] - 1, before[-1] if len(before) else 0).astype(np.int64)
    letters = np.ascontiguousarray(LOWER[data[inside]])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first_byte), [None, pa.py_buffer(places), pa.py_buffer(letters)]
    )
    return words, np.searchsorted(first_byte, offsets)


def varied(word: bytes, hashed: int) -> bytes:
    """The word without the code point that the hash names."""
    letters = word.decode()
    place = hashed % len(letters)
    return (letters[:place] + letters[place + 1 :]).encode()


def count_batches(batches, one_in: int, least_letters: int):
    """A task's words with their counts."""
    counts: Counter = Counter()
    for batch, data, offsets in text_pieces(batches):
        words, firsts = text_words(data, offsets)
        encoded = words.dictionary_encode()
        numbers, names = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        # Each (document, word) once, with its count there.
        texts = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        keys, times = np.unique(texts.astype(np.int64) * max(len(names), 1) + numbers, return_counts=True)
        owner, which = np.divmod(keys, max(len(names), 1))
        ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("id").to_pylist()]
        hashes = [zlib.crc32(names[w], ids[o]) for o, w in zip(owner.tolist(), which.tolist())]
        changes = np.array(hashes, np.int64) % one_in == 0
        sums = np.bincount(which[~changes], times[~changes], len(names)).astype(np.int64)
        for number in np.flatnonzero(sums).tolist():
            counts[names[number]] += int(sums[number])
        for place in np.flatnonzero(changes).tolist():
            counts[varied(names[which[place]], hashes[place])] += int(times[place])
        if len(counts) >= MOST_COUNTED:
            yield count_rows(counts, least_letters)
            counts.clear()
    yield count_rows(counts, least_letters)


def count_rows(counts: Counter, least_letters: int) -> pa.RecordBatch:
    words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
    batch = pa.record_batch([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])
    return batch.filter(pc.greater_equal(pc.utf8_length(words), least_letters))


def vocabulary(
    docs: DataFrame,
    one_in: int = DELETED_ONE_IN,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The words of the texts that are long and frequent enough: word, n."""
    small_batches(docs.sparkSession)
    counted = narrowed(docs, id=doc_id, text=text).mapInArrow(
        lambda batches: count_batches(batches, one_in, least_letters), "word string, n long"
    )
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def padded() -> Column:
    """The word with end marks, so that there are always ``AHEAD`` code points ahead."""
    return F.concat("word", F.lit(END * AHEAD))


def near_in_trie(words: DataFrame) -> DataFrame:
    """Pairs (word, other) one edit apart, each once, of words (word)."""
    trie = stored(words.select("word", padded().alias("path"), F.char_length("word").alias("letters")), "trie")
    depths = F.sequence(F.lit(AHEAD + 1), F.col("letters") + AHEAD)
    prefix = F.explode(F.transform(depths, lambda depth: F.substring("path", F.lit(1), depth)))
    nodes = stored(trie.filter("letters > 0").select(prefix.alias("child")).distinct(), "nodes")
    above = F.char_length("child") - (AHEAD + 1)
    edges = nodes.select(
        F.substring("child", F.lit(1), above).alias("node"),
        F.substring("child", above + 1, F.lit(1)).alias("read"),
        F.substring("child", above + 2, F.lit(AHEAD)).alias("next"),
        "child",
    ).filter(F.col("read") != END)
    # States without an edit: each word on all of its prefixes.
    level = F.col("level")
    stands = trie.select("word", "path", "letters", F.explode(F.sequence(F.lit(0), F.col("letters"))).alias("level"))
    asks = stands.select(
        "word", "level",
        F.substring("path", F.lit(1), level).alias("node"),
        F.substring("path", level + 1, F.lit(1)).alias("own"),
        F.inline(F.array(
            F.struct(F.lit(1).alias("skips"), F.substring("path", level + 2, F.lit(AHEAD)).alias("next")),
            F.struct(F.lit(0).alias("skips"), F.substring("path", level + 1, F.lit(AHEAD)).alias("next")),
        )),
    ).filter((F.col("skips") == 0) | (F.col("own") != END))
    replaced = (F.col("skips") == 1) & (F.col("read") > F.col("own"))
    inserted = (F.col("skips") == 0) & (F.col("read") != F.col("own"))
    states = asks.join(edges, ["node", "next"]).filter(replaced | inserted).select(
        "word", (F.col("level") + F.col("skips") + AHEAD).alias("position"), F.col("child").alias("node")
    )
    found = []
    while True:
        states = stored(states, "frontier")
        at_end = F.col("node").endswith(END)
        found.append(states.filter(at_end).select("word", F.rtrim("node").alias("other")))
        frontier = states.filter(~at_end)
        if not frontier.limit(1).count():
            break
        reads = F.substring(padded(), F.col("position") + 1, F.lit(AHEAD))
        moves = frontier.select("word", (F.col("position") + AHEAD).alias("position"), F.concat("node", reads).alias("child"))
        states = moves.join(nodes, "child").select("word", "position", F.col("child").alias("node"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def fingerprints(batches):
    """Of each numbered word its own fingerprint (place -1) and those without one code point."""
    power = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(power), -1, 1 << 64))
    for batch in batches:
        for word, number in zip(batch.column("word").to_pylist(), batch.column("number").to_pylist()):
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            letters = (letters + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            letters ^= letters >> np.uint64(32)
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.full(len(letters), power))
                terms = letters * powers
                sums = np.cumsum(terms)
                total = sums[-1]
                without = sums - terms + (total - sums) * back
            marks = np.concatenate([[total], without]).view(np.int64)
            for first in range(0, len(marks), 1 << 16):
                part = marks[first : first + (1 << 16)]
                yield pa.record_batch(
                    [pa.array([number] * len(part), pa.string()), pa.array(np.arange(len(part), dtype=np.int32) + (first - 1)), pa.array(part)],
                    names=["number", "place", "mark"],
                )


def near_long(words: DataFrame, longest: int) -> DataFrame:
    """Pairs (word, other) one edit apart of which one is longer than ``longest`` letters."""
    long = words.select("word").filter(F.char_length("word") >= longest)
    number = F.sha2(F.col("word").cast("binary"), 256)
    named = stored(long.withColumn("number", number), "long")
    if not named.limit(1).count():
        return words.select("word", F.col("word").alias("other")).limit(0)
    marks = stored(named.mapInArrow(fingerprints, "number string, place int, mark long"), "marks")
    a, b = marks.alias("a"), marks.alias("b")
    replaced = a.join(b, (F.col("a.mark") == F.col("b.mark")) & (F.col("a.place") == F.col("b.place"))).filter(
        "a.place >= 0 and a.number < b.number"
    )
    inserted = a.filter("place = -1").join(b.filter("place >= 0"), F.col("a.mark") == F.col("b.mark"))
    numbers = [F.col("a.number").alias("x"), F.col("b.number").alias("y")]
    pairs = replaced.select(*numbers).union(inserted.select(*numbers)).distinct()
    left, right = named.toDF("word", "x"), named.toDF("other", "y")
    both = pairs.join(left, "x").join(right, "y").select("word", "other")
    beyond = (F.char_length("word") > longest) | (F.char_length("other") > longest)
    return both.filter(beyond & (F.levenshtein("word", "other", 1) == 1))


def near(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """All pairs (word, other) one edit apart, both ways round."""
    in_trie = near_in_trie(words.filter(F.char_length("word") <= longest))
    pairs = in_trie.unionByName(near_long(words, longest))
    return stored(pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))), "near")


def forms(words: DataFrame, times_more: int = TIMES_MORE, longest: int = LONGEST) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n."""
    words = stored(words.select("word", "n"), "words")
    pairs = near(words, longest)
    others = words.toDF("other", "other_n")
    best = pairs.join(others, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"),
    )
    enough = -F.col("best.minus") >= times_more * F.col("n")
    chosen = stored(
        words.join(best, "word", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    steps = stored(chosen.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left")
        if not joined.filter("next is not null").limit(1).count():
            break
        steps = stored(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")
    return chosen.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
