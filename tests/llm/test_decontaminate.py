"""Decontamination against a plain search of all windows."""

import random
import re
from collections import Counter

import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import decontaminate


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def windows(item):
    w = words(item)
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def plain(docs, items):
    known = [(item_id, windows(text)) for item_id, text in items]
    out = Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, grams in known:
            for g in grams:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        found.add(item_id)
        out[doc, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))] += 1
    return out


def cases(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "c3", "Dd", "zz", "q"]) + rng.choice(["", "x", "Y"])
    prose = lambda n: " ".join(word() + rng.choice(["", ",", "!", "\n"]) for _ in range(n))
    items = [(i, prose(rng.randint(3, 30))) for i in range(12)]
    items += [(90, None), (91, ""), (92, " !! "), (None, items[3][1]), (93, items[3][1]), (94, items[4][1] + " end")]
    texts = [None, "", "...", "a", items[0][1], items[1][1].upper(), items[2][1] + items[2][1]]
    for _ in range(40):
        parts = [prose(rng.randint(0, 20)), rng.choice(items)[1] or "", prose(rng.randint(0, 20))]
        if rng.random() < 0.5:
            parts[1] = " ".join(parts[1].split()[2:-2])
        texts.append(" ".join(parts))
    texts += [texts[9]] * 3 + ["a " * 50_000 + items[5][1]]
    return texts, items


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_equals_plain_search(spark, block_bytes):
    texts, items = cases()
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("hits", F.lit(1))
    out = decontaminate.contamination(docs, frame(spark, items), block_bytes=block_bytes)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect())
    assert got == plain(list(enumerate(texts)), items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_clean_documents_stay_with_their_columns(spark, block_bytes):
    texts, items = cases()
    docs = documents(spark, texts).withColumn("n_hit", F.lit("own"))
    kept = decontaminate.decontaminate(docs, frame(spark, items), block_bytes=block_bytes)
    assert kept.columns == docs.columns
    want = {doc for doc, _, n_hit, _ in plain(list(enumerate(texts)), items) if not n_hit}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want and {r.n_hit for r in rows} == {"own"}
    assert all(r.text == texts[r.doc_id] for r in rows)


def longest_common_runs(doc, item, least):
    """Maximal equal runs (doc place, item place, words) by dynamic programming."""
    out, before = set(), {}
    for i, a in enumerate(doc):
        now = {}
        for j, b in enumerate(item):
            if a == b:
                now[j] = before.get(j - 1, 0) + 1
                ends = i + 1 == len(doc) or j + 1 == len(item) or doc[i + 1] != item[j + 1]
                if ends and now[j] >= least:
                    out.add((i + 1 - now[j], j + 1 - now[j], now[j]))
        before = now
    return out


def test_longest_matches_and_places(spark):
    texts, items = cases(4)
    texts, items = texts[:-1], [(i, t) for i, t in items if words(t) and i is not None]
    got = Counter(
        (r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words)
        for r in decontaminate.verbatim_matches(documents(spark, texts), frame(spark, items)).collect()
    )
    want = Counter()
    for doc, text in enumerate(texts):
        for item_id, item in items:
            least = min(10, len(words(item)))
            for i, j, n in longest_common_runs(words(text), words(item), least):
                want[doc, str(item_id), i, j, n] += 1
    assert got == want
    longest = {r.doc_id: r.longest for r in decontaminate.contamination(documents(spark, texts), frame(spark, items)).collect()}
    for doc in range(len(texts)):
        assert longest[doc] == max([n for (d, _, _, _, n) in want if d == doc], default=0)


def test_empty_tables(spark):
    texts, items = cases()
    docs, benchmark = documents(spark, texts), frame(spark, items)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    rows = decontaminate.digest(decontaminate.contamination(docs, benchmark.limit(0))).collect()
    assert len(rows) == len(texts) and not any(r.contaminated or r.n_items for r in rows)
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(texts)
