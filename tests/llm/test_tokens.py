"""Token histograms against counting by hand."""

import bisect

import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import tokens

TEXTS = [None, "", "one two three", "a" * 20_000, " " * 50_000, "x" + " \n" * 2_000 + "y", "one two three", "été"]


@pytest.fixture(scope="module")
def lengths():
    return tokens.Lengths(tokens.read_vocabulary(tokens.VOCABULARY), tokens.PATTERN)


def test_cut_runs_equal_the_plain_encoder(lengths):
    for text in ("a" + " " * 1500 + "b", "a" + "\n" * 1500, " " * 1200 + "\n  b", " " * 2000 + "1", "x\t" * 3 + " " * 999 + "y"):
        assert lengths.of(text) == lengths.plain(text)


def test_very_long_runs(lengths):
    assert lengths.of(" " * 1_000_000) > 0
    assert lengths.of(" \n" * 300_000 + "x") > 0


def test_limits_equal_counting(spark, lengths):
    docs = documents(spark, TEXTS).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("s")))
    docs = docs.withColumn("n_tokens", F.lit("clash")).withColumn("block", F.lit(1))
    rows = tokens.context_limits(tokens.histogram(docs)).collect()
    groups = {(False, None): [0, 3, 6], (False, "s"): [1, 2, 4, 5, 7], (True, None): range(8)}
    assert {(r.all_sources, r.source) for r in rows} == set(groups)
    for key, members in groups.items():
        counts = sorted(lengths.of(TEXTS[i] or "") for i in members)
        mine = {r.context_limit: r for r in rows if (r.all_sources, r.source) == key}
        assert sorted(mine) == sorted(set(counts))
        for limit, row in mine.items():
            within = bisect.bisect_right(counts, limit)
            assert row.n_docs == counts.count(limit)
            assert (row.docs_within, row.docs_over) == (within, len(counts) - within)
            assert row.tokens_within == sum(counts[:within])
            assert row.tokens_truncated == sum(min(c, limit) for c in counts)
            assert (row.docs_total, row.tokens_total) == (len(counts), sum(counts))


def test_quantiles_and_empty_table(spark, lengths):
    docs = documents(spark, ["word " * n for n in range(1, 101)]).withColumn("source", F.lit("s"))
    rows = tokens.quantile_lengths(tokens.histogram(docs), [0.5, 1.0]).collect()
    counts = sorted(lengths.of("word " * n) for n in range(1, 101))
    assert all(r["q0.5"] == counts[49] and r["q1.0"] == counts[99] for r in rows)
    assert tokens.context_limits(tokens.histogram(docs.limit(0))).count() == 0
