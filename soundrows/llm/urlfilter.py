"""URL filters: longest-prefix rules, and exact membership by a cascade of Bloom filters.

The cascade answers "is this key on the list?" for every key of a known universe (the keys
of the corpus) without a join.  Level 1 encodes the listed keys; level 2 encodes those
unlisted keys that level 1 lets through; level 3 the listed keys that level 2 lets
through, and so on, until no wrong answer is left.  A key's answer is the parity of the
first level that does not have it.

Scale: keys of list and corpus meet in one distributed aggregate.  Bits are set by a
distributed aggregate over words of the filter; the driver holds bits of a bounded number,
never keys.  A cascade is broadcast up to ``filter_bytes``; for longer lists the keys are
dealt by a hash to groups, each with a cascade of its own, and pages are judged group by
group.  No page row is shuffled.

Defined results for odd input: a NULL url, or one without ``://``, has an empty host and
path, no rule and is not listed unless the empty key is; listed keys outside the universe
change nothing; repeated pages and keys are judged alike; an empty list blocks nothing; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import narrowed
from soundrows.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_LEVELS = 64  # far more than halving needs


def host_and_path(url: Column) -> Column:
    """Struct of the lower-cased host and the path up to ``?`` or ``#``."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    return F.struct(
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains when the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def decided(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, NULL where none fits."""
    struct = lambda r: F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
    choice = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = rule.fits(host, path)
        choice = F.when(fits, struct(rule)) if choice is None else choice.when(fits, struct(rule))
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


@dataclass(frozen=True)
class Level:
    """A Bloom filter: its number of bits, its hash functions and its bits in words."""

    bits: int
    hashes: int
    words: np.ndarray

    def passes(self, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys the filter lets through."""
        inside = np.ones(len(h1), bool)
        for i in range(self.hashes):
            place = probe(h1, h2, i, number, self.bits)
            bit = self.words[place >> 6] >> (place & 63).astype(np.uint64)
            inside &= bit & np.uint64(1) == 1
        return inside


def listed_by(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The cascade's answers: parity of the first level that does not have the key."""
    answer = np.full(len(h1), len(levels) % 2 == 1)
    still = np.arange(len(h1))
    for number, level in enumerate(levels):
        inside = level.passes(number, h1[still], h2[still])
        answer[still[~inside]] = number % 2 == 1
        still = still[inside]
    return answer


def probe(h1: np.ndarray, h2: np.ndarray, i: int, level: int, bits: int) -> np.ndarray:
    """Place of hash function ``i`` at a level: double hashing, salted by the level."""
    salt = np.int64(2 * level + 1)
    with np.errstate(over="ignore"):
        mixed = h1 * salt + np.int64(i) * (h2 * salt | np.int64(1)) + h2 * np.int64(level)
        mixed = (mixed ^ (mixed >> 31)) * np.int64(0x2545F4914F6CDD1D)
    return ((mixed >> 1) & np.int64(0x3FFFFFFFFFFFFFFF)) % bits


def hashes_of(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def masks_of(batches, bits: int, hashes: int, level: int):
    """(word, mask) of the bits that a batch of keys sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        places = np.unique(np.concatenate([probe(h1, h2, i, level, bits) for i in range(hashes)]))
        words = places >> 6
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        masks = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first)
        yield pa.record_batch(
            [pa.array(words[first]), pa.array(masks.view(np.int64))], names=["word", "mask"]
        )


def filter_of(keys: DataFrame, n: int, level: int, rate: float) -> Level:
    """The filter of ``n`` keys with about this rate of wrong answers."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    masks = keys.mapInArrow(lambda b: masks_of(b, bits, hashes, level), "word long, mask long")
    table = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def passing(batches, level: Level, number: int):
    for batch in batches:
        inside = level.passes(number, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
        yield batch.filter(pa.array(inside))


@dataclass(frozen=True)
class Sizes:
    """Rates of the first and the later levels, and the bound of a broadcast cascade."""

    first_rate: float = 2**-5
    later_rate: float = 0.5
    filter_bytes: int = 32 << 20

    def groups(self, listed: int) -> int:
        """Groups that keep a cascade below the bound (levels shrink by half or more)."""
        bits = listed * (round(-math.log2(self.first_rate)) / math.log(2) + 8)
        return max(1, math.ceil(bits / 8 / self.filter_bytes))


def known_keys(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct keys of the universe with their hashes and whether they are listed."""
    key = F.coalesce(F.col("key"), F.lit("")).alias("key")
    both = universe.select(key, F.lit(True).alias("known"), F.lit(False).alias("listed"))
    both = both.unionByName(listed.select(key, F.lit(False).alias("known"), F.lit(True).alias("listed")))
    found = both.groupBy("key").agg(F.max("known").alias("known"), F.max("listed").alias("listed"))
    return stored(found.filter("known").select("listed", *hashes_of(F.col("key"))), "url-keys")


def build(keys: DataFrame, sizes: Sizes) -> list[Level]:
    """The levels of a cascade that is exact on ``keys`` (columns listed, h1, h2)."""
    inside = keys.filter("listed").drop("listed")  # what the next level encodes
    outside = keys.filter("not listed").drop("listed")
    levels: list[Level] = []
    while n := inside.count():
        if len(levels) == MOST_LEVELS:
            raise ValueError(f"no exact cascade in {MOST_LEVELS} levels: keys share both hashes")
        number = len(levels)
        level = filter_of(inside, n, number, sizes.later_rate if number else sizes.first_rate)
        levels.append(level)
        shared = keys.sparkSession.sparkContext.broadcast(level)
        through = outside.mapInArrow(
            lambda b, shared=shared, number=number: passing(b, shared.value, number), outside.schema
        )
        inside, outside = stored(through, f"level-{number}"), inside
    return levels


def answers(batches, levels: list[Level]):
    for batch in batches:
        listed = listed_by(levels, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
        yield pa.record_batch(
            [*batch.columns[:-1], pa.array(listed)], names=batch.schema.names
        )


def with_membership(rows: DataFrame, key: str, listed: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The rows with a boolean column ``listed``: is their key on the list?

    The rows' own keys are the universe, so every answer is exact.
    """
    keys = known_keys(rows.select(F.col(key).alias("key")), listed.select("key"))
    groups = sizes.groups(keys.filter("listed").count())
    hashed = rows.select("*", *hashes_of(F.coalesce(F.col(key), F.lit(""))), F.lit(False).alias("listed"))
    parts = []
    for group in range(groups):
        own = F.pmod(F.col("h2"), F.lit(groups)) == group
        levels = build(keys.filter(own) if groups > 1 else keys, sizes)
        shared = rows.sparkSession.sparkContext.broadcast(levels)
        mine = hashed.filter(own) if groups > 1 else hashed
        parts.append(mine.mapInArrow(lambda b, shared=shared: answers(b, shared.value), hashed.schema))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.drop("h1", "h2")


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    listed: DataFrame,
    sizes: Sizes = Sizes(),
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Per page row: page_id, host, path, rule (or NULL) and verdict.

    ``listed`` has the blocked keys (host and path) in its column ``key``.  A rule decides
    before the list does.
    """
    located = narrowed(pages, page_id=page_id, url=url).withColumn("at", host_and_path(F.col("url")))
    rows = located.select("page_id", "at.host", "at.path", F.concat("at.host", "at.path").alias("key"))
    member = with_membership(rows, "key", listed, sizes)
    member = member.withColumn("by_rule", decided(rules, F.col("host"), F.col("path")))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return member.select(
        "page_id",
        "host",
        "path",
        "by_rule.rule",
        F.coalesce("by_rule.verdict", by_list).alias("verdict"),
    )


#: The query's rules and the domains whose pages are on its list.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
LISTED_HOSTS = r"(^|\.)(ads-track|free-bets|spam-farm|casino-win|cheap-pills|adult-x)\."


def keys_on_hosts(pages: DataFrame, pattern: str = LISTED_HOSTS, url: str = "url") -> DataFrame:
    """A list to test against: the keys of all pages on hosts that match the pattern."""
    at = narrowed(pages, url=url).select(host_and_path(F.col("url")).alias("at"))
    return at.filter(F.col("at.host").rlike(pattern)).select(F.concat("at.host", "at.path").alias("key"))
