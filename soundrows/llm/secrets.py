"""Secret scans: known formats, and windows of high entropy in unknown strings.

Known formats are found by patterns (kinds assign, access, hex).  Everything else goes by
entropy: a candidate is a run of at least ``least`` base64 characters; a window slides over
it while counts of its characters are updated by the one that enters and the one that
leaves, which gives the Shannon entropy at every place.  A window is dense at ``share`` of
the entropy that random characters of its class have in a window of its length: short
candidates and small alphabets are held against less.  Dense windows that consist mostly of
plain parts (words by their letter pairs, numbers, matches of the allow patterns) are passed
over; all others are united to spans, which reach on to the next plain part or separator.
An allow pattern thus hides only what it matches, not the key beside it.  An entropy span is
left out only where spans of known formats cover all of it; one that reaches beyond them is
reported whole, beside them.

Scale: one scan, no shuffle, memory follows the longest text.  A clean text costs a few
vector operations per byte; only candidates meet Python code.

Places are code points, ends exclusive.  Defined results for odd input: a NULL or empty
text has no spans; repeated documents are scanned one by one; an empty table gives an
empty result; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import Renamed, narrowed, small_batches
from soundrows.llm.textbytes import byte_set, pieces, runs

# The known formats, over bytes with A-Z in lower case for ``assign``.
ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX_BYTES = byte_set((0x30, 0x39), (0x61, 0x66))
HEX_LEAST = 16
KINDS = ("assign", "access", "hex", "entropy")

LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Letter pairs of words: a vowel beside a frequent consonant, and common clusters.
PAIRS = frozenset(
    [v + c for v in "aeiou" for c in "bcdfglmnprstv"]
    + [c + v for v in "aeiou" for c in "bcdfghlmnprstv"]
    + (
        "th he ch sh ck st nd nt ng rt rs rd ld lt ll ss tt ff pp mm nn rr ee oo ou ea ai ei ie"
        " io ia ue au eu sc sp tr pr br cr dr gr fr pl bl cl fl gl ct pt ns ts ls ks mp ph wh ft"
        " ly ty ry ny my ay ey by wa we wi wo ow aw ew ke ki ka ak ek ik ok ic je jo ju ja ze zu"
        " tz tw sw sk rn rm rk rl rg rb ht hl hr hn ms lm gs gh cc sl sm sn qu ex ax ve iv av nk kn wn oa ds"
    ).split()
)
PLAIN_PAIRS = 0.68  # of the pairs of a word
SEPARATORS = "+/_=-"
SEGMENT = re.compile(r"[A-Za-z0-9]+")
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
LEAST_HUMP = 4  # shorter parts of a segment say nothing
NUMBERED = re.compile(r"[A-Za-z]{1,3}[0-9]{0,3}|[0-9]{1,4}[a-z][0-9]{0,4}")  # v2, en, 1024x768


@lru_cache
def expected_entropy(window: int, alphabet: int) -> float:
    """Mean Shannon entropy of a window of random characters of the alphabet."""
    p = 1 / alphabet
    mean = sum(
        math.comb(window, c) * p**c * (1 - p) ** (window - c) * c * math.log2(c)
        for c in range(1, window + 1)
    )
    return math.log2(window) - alphabet * mean / window


@dataclass(frozen=True)
class CharacterClass:
    """Characters of a window, as a regular expression set, and the size of their alphabet."""

    name: str
    members: str
    alphabet: int

    def table(self) -> np.ndarray:
        pattern = re.compile(f"[{self.members}]")
        return np.array([b < 128 and bool(pattern.match(chr(b))) for b in range(256)])

    def threshold(self, window: int, share: float) -> float:
        return share * expected_entropy(window, self.alphabet)


@dataclass(frozen=True)
class Entropy:
    """Settings of the entropy search; a window is of the first class that has all of it."""

    window: int = 20
    least: int = 16  # a shorter run is no candidate; a run below the window is one window
    share: float = 0.88
    most_plain: float = 0.6  # of the letters and digits of a window
    classes: tuple[CharacterClass, ...] = (
        CharacterClass("hex", "0-9a-f", 16),
        CharacterClass("upper hex", "0-9A-F", 16),
        CharacterClass("lower letters", "a-z+/_=-", 26),
        CharacterClass("upper letters", "A-Z+/_=-", 26),
        CharacterClass("lower", "a-z0-9+/_=-", 36),
        CharacterClass("upper", "A-Z0-9+/_=-", 36),
        CharacterClass("letters", "A-Za-z+/_=-", 52),
        CharacterClass("base64", "A-Za-z0-9+/_=-", 64),
    )
    allow: tuple[str, ...] = (r"(?i:example|changeme|placeholder|x{6,}|0{6,})",)  # what they match


DEFAULT_ENTROPY = Entropy()


@lru_cache(4096)
def is_word(letters: str) -> bool:
    """Do the pairs of the letters look like those of words?"""
    low = letters.lower()
    pairs = [low[i : i + 2] in PAIRS for i in range(len(low) - 1)]
    return sum(pairs) >= PLAIN_PAIRS * len(pairs)


def plain_places(candidate: str, allowed: re.Pattern | None) -> bytearray:
    """Flags: 1 inside words, numbers and allowed parts, 0 elsewhere; separators are 2."""
    out = bytearray(2 if c in SEPARATORS else 0 for c in candidate)

    def mark(first: int, last: int) -> None:
        for i in range(first, last):
            out[i] = out[i] or 1

    for segment in SEGMENT.finditer(candidate):
        if segment[0].isdigit() or NUMBERED.fullmatch(segment[0]):
            mark(*segment.span())
        else:
            for hump in HUMP.finditer(candidate, *segment.span()):
                if hump.end() - hump.start() >= LEAST_HUMP and is_word(hump[0]):
                    last = hump.end()
                    while last < segment.end() and candidate[last].isdigit():
                        last += 1  # the number of a word: readme3, but no key of digits
                    mark(hump.start(), last if last - hump.end() <= 4 else hump.end())
    for part in allowed.finditer(candidate) if allowed else ():
        mark(*part.span())
    return out


def reaching(plain: bytearray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, each up to the next plain part or separator, united."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a > 0 and not plain[a - 1]:
            a -= 1
        while b < len(plain) and not plain[b]:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dense_windows(candidate: bytes, window: int, threshold) -> list[tuple[int, int]]:
    """United windows of the candidate whose entropy reaches the threshold.

    The threshold is a number, or a function of the start of a window.

    The entropy of a window of n characters is log2(n) - sum(c * log2(c)) / n over its
    character counts c; the sum changes by one count up and one count down per step.
    """
    n = window
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    at = threshold if callable(threshold) else lambda first: threshold
    counts = [0] * 256
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, entering in enumerate(candidate):
        c = counts[entering]
        total += term[c + 1] - term[c] if c < n else 0.0
        counts[entering] = c + 1
        if i >= n:
            c = counts[candidate[i - n]]
            total += term[c - 1] - term[c] if c <= n else 0.0
            counts[candidate[i - n]] = c - 1
        first = i - n + 1
        if first >= 0 and total <= (math.log2(n) - at(first)) * n + 1e-9:
            if spans and first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((first, i + 1))
    return spans


class Scanner:
    """Finds the spans of all texts of a piece."""

    def __init__(self, entropy: Entropy):
        self.entropy = entropy
        tables = [c.table() for c in entropy.classes]
        self.members = np.logical_or.reduce(tables)
        self.classes = [(c, bytes(np.flatnonzero(t).astype(np.uint8))) for c, t in zip(entropy.classes, tables)]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in entropy.allow)) if entropy.allow else None

    def known(self, text: bytes) -> list[tuple[int, int, int]]:
        """Spans (start, kind, end) in bytes of the kinds that need a pattern."""
        found = []
        lower = text.translate(LOWER_TABLE)
        if any(word in lower for word in ASSIGN_WORDS):
            for m in ASSIGN.finditer(lower):
                if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                    found.append((m.start(), 0, m.end()))
        if b"AKIA" in text:
            for m in ACCESS.finditer(text):
                if m.end() - m.start() >= ACCESS_LEAST:
                    found.append((m.start(), 1, m.end()))
        return found

    def secret_windows(self, candidate: bytes) -> list[tuple[int, int]]:
        """United dense windows of a candidate that are not plain."""
        plain = plain_places(candidate.decode("ascii"), self.allowed)
        if 0 not in plain:
            return []
        n = min(self.entropy.window, len(candidate))
        lowest = {
            members: c.threshold(n, self.entropy.share) for c, members in self.classes
        }

        def threshold(first: int) -> float:
            here = plain[first : first + n]
            if here.count(1) > self.entropy.most_plain * (n - here.count(2)):
                return math.inf
            window = candidate[first : first + n]
            return next((t for m, t in lowest.items() if not window.translate(None, m)), math.inf)

        return reaching(plain, dense_windows(candidate, n, threshold))

    def dense(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Entropy spans of a whole piece."""
        found = []
        for first, last in zip(*(x.tolist() for x in runs(data, offsets, self.members, self.entropy.least))):
            for a, b in self.secret_windows(data[first:last].tobytes()):
                found.append((first + a, 3, first + b))
        return found

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Per text the sorted spans (start, kind, end) in code points."""
        n = len(offsets) - 1
        per_text: list[list] = [self.known(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(n)]
        for first, last in zip(*(x.tolist() for x in runs(data, offsets, HEX_BYTES, HEX_LEAST))):
            i = int(np.searchsorted(offsets, first, "right")) - 1
            per_text[i].append((first - int(offsets[i]), 2, last - int(offsets[i])))
        base = [list(spans) for spans in per_text]
        for first, kind, last in self.dense(data, offsets):
            i = int(np.searchsorted(offsets, first, "right")) - 1
            a, b = first - int(offsets[i]), last - int(offsets[i])
            if not inside_spans(a, b, base[i]):
                per_text[i].append((a, kind, b))
        for i, found in enumerate(per_text):
            if found:
                points = np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)
                place = lambda b: int(points[b - 1]) if b else 0  # noqa: E731, B023
                per_text[i] = sorted((place(a), kind, place(b)) for a, kind, b in found)
        return per_text


def inside_spans(a: int, b: int, spans) -> bool:
    """Do the spans together cover every place from a to b?"""
    for start, _, end in sorted(spans, key=lambda span: span[0]):
        if start <= a < end:
            a = end
    return a >= b


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(batches, entropy: Entropy):
    scanner = Scanner(entropy)
    for batch, data, offsets in pieces(batches):
        spans = [
            [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in of_text]
            for of_text in scanner.spans(data, offsets)
        ]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"]
        )


def scan(
    docs: DataFrame,
    entropy: Entropy = DEFAULT_ENTROPY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document row its spans: array<struct<kind, start, end>> by start, then kind."""
    small_batches(docs.sparkSession)
    docs = narrowed(docs, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>"
    return docs.mapInArrow(lambda b: find(b, entropy), schema)


def masked(text: str, spans, mask: str) -> str:
    """The text with every united span replaced by the mask."""
    parts, done = [], 0
    united: list[list[int]] = []
    for a, _, b in spans:
        if united and a <= united[-1][1]:
            united[-1][1] = max(b, united[-1][1])
        else:
            united.append([a, b])
    for a, b in united:
        parts += [text[done:a], mask]
        done = b
    return "".join([*parts, text[done:]])


def mask_texts(batches, text: str, length: str | None, mask: str, entropy: Entropy):
    scanner = Scanner(entropy)
    for batch, data, offsets in pieces(batches, text):
        spans = scanner.spans(data, offsets)
        if any(spans):
            values = batch.column(text).to_pylist()
            for i, found in enumerate(spans):
                if found:
                    values[i] = masked(values[i], found, mask)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text] = pa.array(values, batch.schema.field(text).type)
            if length:
                old = batch.column(length).to_pylist()
                new = [len(v) if s else o for v, s, o in zip(values, spans, old)]
                columns[length] = pa.array(new, batch.schema.field(length).type)
            batch = pa.record_batch(list(columns.values()), names=list(columns))
        yield batch


def redact(
    docs: DataFrame,
    mask: str = "[secret]",
    entropy: Entropy = DEFAULT_ENTROPY,
    text: str = "text",
    length: str | None = None,
) -> DataFrame:
    """All documents with all columns, their secrets replaced by ``mask``.

    ``length`` names a column that holds the length of the text, to be kept right.
    """
    small_batches(docs.sparkSession)
    renamed = Renamed(docs)
    column, size = renamed.name(text), renamed.name(length) if length else None
    return renamed.back(
        renamed.frame.mapInArrow(
            lambda b: mask_texts(b, column, size, mask, entropy), renamed.frame.schema
        )
    )


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``."""
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"),
    )
