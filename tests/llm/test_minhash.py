"""Near-duplicates against comparing all pairs."""

import random
import re
from collections import Counter

import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import minhash
from soundrows.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [m for m in members[find(i)] if m is not None]
        component = min(ids) if ids else None
        out[doc, len(sets[i]), component, doc == component] += 1
    return out


def corpus(seed=7):
    """Families with edits around the threshold, copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    texts = [None, "", "  \n", "one", "One", "two words", "Two WORDS", "a b c d", "a b c d e", "É b c d", "é b c d"]
    common = [word() for _ in range(40)]
    for family in range(12):
        base = [word() for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base + common))
    texts += [" ".join(common + [word() for _ in range(30)]) for _ in range(20)]
    texts += [texts[20]] * 9
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block_rows", [512, 3])
def test_equals_all_pairs(spark, block_rows):
    texts = corpus()
    docs = documents(spark, texts).withColumn("n_shingles", F.lit("clash")).withColumn("cls", F.lit(1))
    got = minhash.judged(docs, minhash.Settings(block_rows=block_rows))
    assert Counter(map(tuple, got.collect())) == plain(list(enumerate(texts)))


def test_remaining_pass_finds_links_that_the_star_misses(spark, monkeypatch):
    monkeypatch.setattr(minhash, "star_pairs", lambda lists, *a: lists.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
    texts = corpus(8)
    got = minhash.judged(documents(spark, texts), minhash.Settings(block_rows=4))
    assert Counter(map(tuple, got.collect())) == plain(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    text = "the same ten words are in this text right here"
    rows = [(None, text), (5, text), (5, text), (3, text + " x"), (None, "alone in the world it is"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash.judged(docs).collect())) == plain(rows)


def test_deduplicated(spark):
    texts = corpus(9)
    rows = list(enumerate(texts)) + [(0, texts[0]), (1, texts[1]), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _key string")
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    keep = Counter()
    for (doc, n, component, own), (i, t) in zip([next(iter(x)) for x in one_by_one(rows)], rows):
        if n == 0:
            keep[i, t] += 1
        elif own:
            keep[i, t] = 1
    assert got == keep
    assert minhash.judged(docs.limit(0)).count() == minhash.deduplicated(docs.limit(0)).count() == 0


def one_by_one(rows):
    """The plain result of each row, in order."""
    whole = plain(rows)
    by_id = {}
    for key in whole:
        by_id.setdefault((key[0], key[1]), []).append(key)
    for i, t in rows:
        yield by_id[i, len(shingles(t))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 170)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(frame).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {150: 150, 170: 150, 200: 150}
    assert got == want
    assert components(frame.limit(0)).count() == 0
