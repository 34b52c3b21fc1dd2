"""Quality rules, line first: bad lines go, then documents that lost too much.

Everything is DataFrame expressions; no Python runs on rows.

Line rules: a line fails when it has words and
* punctuation: no sentence mark anywhere in it, or symbols and doubled marks instead,
* shouting: capitals without a single small letter or letter of a script without case,
* navigation: entries between bars, arrows or bullets,
* boilerplate: a phrase of notices, menus and scripts, as whole words.
Symbols, navigation and boilerplate count by the length of the line, so a paragraph in one
line is not judged by three marks or one phrase somewhere in it.
Lines without words stay (they separate paragraphs).  A document is kept when it passes the
base rules and the cleaned text still holds ``least_kept`` of its word characters.

Scale: one scan, no shuffle.  Repeated windows are found per row by sorting window hashes
(64 bits, within one text), never by pairing windows.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results for odd input: a NULL or empty text has
no words, fails the base rules and is not kept; repeated documents are judged one by one;
an empty table gives an empty result; extra columns are kept whatever their names.  Texts
and lines of any length are judged whole, in time that grows with their length: every
pattern looks at a character a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import Renamed, narrowed

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

SENTENCE = r"[.!?…。！？．।॥؟۔։።]"
CAPITALS = r"\p{Lu}{2}"
#: Small letters and letters without case (Chinese, Arabic, ...), but for ordinal signs.
SMALL = r"[\p{Ll}\p{Lo}&&[^ªº]]"
EMPHASIS = r"(\*{2,3})(?=[^\s*])([^*]*[^\s*])\1"  # **bold** words of prose
SYMBOL_WORDS = r"[#*$%&]{2,}"
DOUBLED_MARKS = r"[!?]{2,}"
BARS = r"[|>•]"
ARROWS = r"(?<=\s)[»›](?=\s)"
GUILLEMETS = r"[«‹]"
NOTICES = (
    "licensed under",
    "released under",
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "cookie settings",
    "accept cookies",
    "accept all cookies",
    "enable javascript",
    "requires javascript",
    "lorem ipsum",
    "subscribe to our",
    "©",
    "&copy;",
)
MENUS = ("click here", "read more", "sign in", "log in to", "powered by")


@dataclass(frozen=True)
class Dense:
    """Marks that a line may not hold ``least`` times and once per ``chars`` characters.

    A mark in short lines is one entry of a menu; the same mark in a long paragraph is not.
    What ``ignored`` matches is taken out first; a line that ``unless`` matches is not judged.
    """

    mark: str
    least: int
    chars: int
    ignored: str = ""
    unless: str = ""


@dataclass(frozen=True)
class Unless:
    """A pattern that a line may not match unless it matches another one, too."""

    mark: str
    unless: str


@dataclass(frozen=True)
class Phrases:
    """Phrases in small letters that a line may not hold once per ``chars`` characters.

    They count as whole words, so "design in Milan" does not hold "sign in".
    """

    phrases: tuple[str, ...]
    chars: int


@dataclass(frozen=True)
class Rules:
    """Line rules, and the share of word characters that must remain in a document."""

    needed: tuple[str, ...] = (SENTENCE,)  # a line without a match fails
    failing: tuple[Unless, ...] = (Unless(CAPITALS, SMALL),)  # a line with one fails
    dense: tuple[Dense, ...] = (
        Dense(SYMBOL_WORDS, 3, 25, ignored=EMPHASIS),
        Dense(DOUBLED_MARKS, 3, 25),
        Dense(BARS, 3, 25),
        Dense(ARROWS, 3, 25, unless=GUILLEMETS),
    )
    phrases: tuple[Phrases, ...] = (Phrases(NOTICES, 200), Phrases(MENUS, 60))
    least_kept: float = 0.5


DEFAULT_RULES = Rules()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def covered_words(starts: Column, window: int) -> Column:
    """How many places the windows at the (sorted, distinct) starts cover together."""
    steps = F.zip_with(
        F.slice(starts, F.lit(1), F.size(starts) - 1),
        F.slice(starts, F.lit(2), F.size(starts) - 1),
        lambda a, b: F.least(b - a, F.lit(window)),
    )
    return F.aggregate(steps, F.lit(window).cast("long"), lambda total, step: total + step)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the text holds twice or more."""

    def repeats(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            placed,
            lambda s: F.flatten(
                F.zip_with(
                    F.slice(s, F.lit(1), F.size(s) - 1),
                    F.slice(s, F.lit(2), F.size(s) - 1),
                    lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
                        F.array().cast("array<int>")
                    ),
                )
            ),
        )
        return let(F.sort_array(F.array_distinct(starts)), lambda s: covered_words(s, window))

    def counted(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)),
            lambda i: F.xxhash64(F.slice(w, i, F.lit(window))),
        )
        by_hash = let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(
                F.lit(0).cast("long")
            ),
        )
        return F.when(F.size(w) >= window, by_hash).otherwise(F.lit(0).cast("long"))

    return counted(words)


def fails(line: Column, rules: Rules) -> Column:
    """Does a line with words break any rule?"""
    bad = F.lit(False)
    for pattern in rules.needed:
        bad = bad | ~line.rlike(pattern)
    for rule in rules.failing:
        bad = bad | (line.rlike(rule.mark) & ~line.rlike(rule.unless))
    for rule in rules.dense:
        bad = bad | too_dense(line, rule)
    return bad | let(F.lower(line), lambda lower: says_too_much(lower, rules.phrases))


def once_per(marks: Column, line: Column, least: int, chars: int) -> Column:
    return let(marks, lambda n: (n >= least) & (n * chars >= F.length(line)))


def too_dense(line: Column, rule: Dense) -> Column:
    """Only lines with enough marks in any spacing are counted."""
    some = line.rlike(rf"(?s)(?:{rule.mark}.*?){{{rule.least}}}")
    if rule.unless:
        some = some & ~line.rlike(rule.unless)
    left = F.regexp_replace(line, rule.ignored, "$2") if rule.ignored else line
    return some & once_per(F.regexp_count(left, F.lit(rule.mark)), line, rule.least, rule.chars)


def says_too_much(lower: Column, groups: tuple[Phrases, ...]) -> Column:
    """Only lines with a phrase as a substring meet the pattern of whole words."""
    out = F.lit(False)
    for group in groups:
        some = F.lit(False)
        for phrase in group.phrases:
            some = some | lower.contains(phrase)
        whole = "|".join(
            rf"(?<![\p{{L}}\p{{N}}_]){p}(?![\p{{L}}\p{{N}}_])" if p[0].isalpha() else p
            for p in group.phrases
        )
        out = out | (some & once_per(F.regexp_count(lower, F.lit(whole)), lower, 1, group.chars))
    return out


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def marked_lines(text: Column, rules: Rules) -> Column:
    """All lines, each with whether it has words and whether it goes; judged once."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            x.alias("line"), has_word(x).alias("full"), (has_word(x) & fails(x, rules)).alias("bad")
        ),
    )


def joined(lines: Column, keep: Callable[[Column], Column], separator: str) -> Column:
    return F.array_join(F.transform(F.filter(lines, keep), lambda x: x["line"]), separator)


def measures(text: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """All measures of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_words(w).alias("n_repeat"),
        ),
    )

    def by_line(lines: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["line"])
        lost = F.length(without(joined(lines, lambda x: x["bad"], " "), SPACES))
        return F.struct(
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup"),
            F.size(F.filter(lines, lambda x: x["bad"])).cast("long").alias("n_bad"),
            lost.cast("long").alias("lost"),
            lines.alias("marked"),
        )

    return F.struct(
        words.alias("words"),
        let(marked_lines(text, rules), by_line).alias("lines"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def cleaned_text(lines: Column) -> Column:
    return joined(lines, lambda x: ~x["bad"], "\n")


def verdicts(frame: DataFrame, text: Column, rules: Rules) -> DataFrame:
    """The frame with a struct column ``_m`` of measures and the two verdicts."""
    m = frame.withColumn("_m", measures(text, rules))
    n_words, repeated = F.col("_m.words.n_words"), F.col("_m.words.n_repeat")
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    chars = F.col("_m.words.chars")
    enough = chars - F.col("_m.lines.lost") >= F.lit(rules.least_kept) * chars
    return m.withColumn("_failed", failed).withColumn("_kept", ~failed & enough)


def judged(
    docs: DataFrame, rules: Rules = DEFAULT_RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document row its measures, the cleaned text and the verdicts."""
    docs = narrowed(docs, doc_id=doc_id, text=text)
    return verdicts(docs, F.col("text"), rules).select(
        "doc_id",
        "_m.words.n_words",
        F.col("_m.words.chars").alias("word_chars"),
        "_m.n_symbols",
        F.col("_m.lines.n_dup").alias("n_dup_lines"),
        F.col("_m.words.n_repeat").alias("n_repeat_words"),
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_m.lines.n_bad").alias("n_bad_lines"),
        cleaned_text(F.col("_m.lines.marked")).alias("cleaned"),
    )


def cleaned(
    docs: DataFrame,
    rules: Rules = DEFAULT_RULES,
    text: str = "text",
    length: str | None = None,
) -> DataFrame:
    """The kept documents with all columns and without their failing lines.

    ``length`` names a column that holds the length of the text, to be kept right.
    """
    renamed = Renamed(docs)
    judged = verdicts(renamed.frame, renamed.column(text), rules).filter("_kept")
    judged = judged.withColumn(renamed.name(text), cleaned_text(F.col("_m.lines.marked")))
    if length:
        kind = docs.schema[length].dataType
        judged = judged.withColumn(renamed.name(length), F.length(renamed.name(text)).cast(kind))
    return renamed.back(judged)


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns of ``judged``."""
    return judged.drop("n_bad_lines", "cleaned")
