"""Token counts: an exact histogram of encoded lengths and what follows from it.

Every document is encoded with a public byte-level BPE vocabulary.  Tasks count documents
by (source, length) while they encode, so only histogram rows are shuffled.  Suffix sums
over the histogram answer, for every length as a context limit, how many documents fit,
how many tokens they have and how many tokens remain when longer ones are truncated.

Scale: one scan; texts never leave the task that reads them.  The histogram has one row
per source and distinct length.  Suffix sums work in blocks of lengths: block totals are
summed per source, then lengths inside each block, so no task holds a source's histogram.
The vocabulary (checked against a bound) is the only thing broadcast.

Defined results for odd input: a NULL or empty text has 0 tokens and counts as a document;
documents without a source are a group of their own; repeated documents count each time;
an empty table gives an empty histogram; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundrows.llm.frames import narrowed, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64 << 20
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space beyond this length are cut by hand: the encoder's own pattern
#: matcher would exhaust its stack on them.
LONG_RUN = re.compile("[ \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
MOST_GROUPS = 1 << 20
BLOCK = 1024  # lengths per block of the suffix sums


def read_vocabulary(path: str) -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return raw


class Lengths:
    """Counts tokens with one vocabulary; made once per task."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        make = lambda name, pat: tiktoken.Encoding(
            name, pat_str=pat, mergeable_ranks=ranks, special_tokens={}
        )
        self.encoding = make("vocabulary", pattern)
        self.one_piece = make("one piece", r"[\s\S]+")

    def of(self, text: str) -> int:
        if not text:
            return 0
        total, done = 0, 0
        for run in LONG_RUN.finditer(text) if len(text) >= 1000 else ():
            # The pattern leaves the run's last character to what follows.
            last = run.end() - (run.end() < len(text))
            total += self.plain(text[done : run.start()])
            total += len(self.one_piece.encode_ordinary(text[run.start() : last]))
            done = last
        return total + self.plain(text[done:])

    def plain(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def histogram_rows(groups: Counter, kind: pa.DataType) -> pa.RecordBatch:
    sources, lengths = zip(*groups) if groups else ((), ())
    return pa.record_batch(
        [
            pa.array(sources, kind),
            pa.array(lengths, pa.int64()),
            pa.array(list(groups.values()), pa.int64()),
        ],
        names=["source", "n_tokens", "n_docs"],
    )


def count_lengths(batches, vocabulary: bytes, pattern: str):
    """A task's documents by source and length."""
    lengths = Lengths(vocabulary, pattern)
    groups: Counter = Counter()
    for batch in batches:
        texts = batch.column("text")
        for source, text in zip(batch.column("source").to_pylist(), texts):
            groups[source, lengths.of(text.as_py())] += 1
        if len(groups) >= MOST_GROUPS:
            yield histogram_rows(groups, pa.string())
            groups.clear()
    yield histogram_rows(groups, pa.string())


def histogram(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Documents by source and encoded length: source, n_tokens, n_docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    docs = narrowed(docs, source=source, text=text).withColumn("source", F.col("source").cast("string"))
    partial = docs.mapInArrow(
        lambda b: count_lengths(b, shared.value, pattern), "source string, n_tokens long, n_docs long"
    )
    return partial.groupBy("source", "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_total(lengths: DataFrame) -> DataFrame:
    """The histogram and, marked by ``all_sources``, the histogram of all documents."""
    total = lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return lengths.withColumn("all_sources", F.lit(False)).unionByName(
        total.select(F.lit(None).cast("string").alias("source"), "n_tokens", "n_docs", F.lit(True).alias("all_sources"))
    )


def context_limits(lengths: DataFrame) -> DataFrame:
    """For each group and each of its lengths as a limit: what fits and what remains.

    ``docs_over`` and ``tokens_over`` are suffix sums: documents longer than the limit and
    their tokens.  All else follows: ``docs_within``, ``tokens_within``, the tokens left
    after truncation and the share of documents within the limit (its quantile).
    """
    group = ["all_sources", "source"]
    block = F.floor(F.col("n_tokens") / BLOCK).alias("block")
    rows = with_total(lengths).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    rows = rows.select(*group, block, "n_tokens", "n_docs", "tokens")
    blocks = rows.groupBy(*group, "block").agg(
        F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens")
    )
    later = Window.partitionBy(*group).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    zero = F.lit(0).cast("long")
    sums = blocks.select(
        F.struct(*group, "block").alias("key"),
        F.coalesce(F.sum("block_docs").over(later), zero).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(later), zero).alias("tokens_after"),
        F.sum("block_docs").over(whole).alias("docs_total"),
        F.sum("block_tokens").over(whole).alias("tokens_total"),
    )
    inside = (
        Window.partitionBy(*group, "block").orderBy(F.desc("n_tokens"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.select(
        F.struct(*group, "block").alias("key"),
        "n_tokens",
        "n_docs",
        F.coalesce(F.sum("n_docs").over(inside), zero).alias("docs_longer"),
        F.coalesce(F.sum("tokens").over(inside), zero).alias("tokens_longer"),
    )
    joined = placed.alias("p").join(sums.alias("s"), F.col("p.key").eqNullSafe(F.col("s.key")))
    over = F.col("docs_after") + F.col("docs_longer")
    tokens_over = F.col("tokens_after") + F.col("tokens_longer")
    within = F.col("docs_total") - over
    return joined.select(
        "p.key.all_sources",
        "p.key.source",
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        within.alias("docs_within"),
        over.alias("docs_over"),
        (F.col("tokens_total") - tokens_over).alias("tokens_within"),
        (F.col("tokens_total") - tokens_over + over * F.col("n_tokens")).alias("tokens_truncated"),
        "docs_total",
        "tokens_total",
        (within / F.col("docs_total")).alias("quantile"),
    )


def quantile_lengths(lengths: DataFrame, shares: list[float]) -> DataFrame:
    """Per group and share the smallest length that this share of its documents keeps to."""
    limits = context_limits(lengths)
    return limits.groupBy("all_sources", "source").agg(
        *[
            F.min(F.when(F.col("docs_within") >= F.lit(q) * F.col("docs_total"), F.col("context_limit"))).alias(f"q{q}")
            for q in shares
        ]
    )
