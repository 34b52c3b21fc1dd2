"""Spelling variants against a search over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_frames import documents
from pyspark.sql import functions as F

from soundrows.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, one_in=31, least_letters=7, least_count=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % one_in == 0:
                place = h % len(word)
                word = word[:place] + word[place + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def plain_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best is not None and words[best] >= 10 * words[word] else None
    rows = []
    for word in words:
        root = word
        while form[root] is not None:
            root = form[root]
        rows.append((word, form[word], root, words[word], len(near[word]), words.get(form[word])))
    return sorted(rows)


def result(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def test_vocabulary(spark):
    texts = [
        None, "", "Encyclopaedia encyclopaedia ENCYCLOPAEDIA", "naïveté×naïveté÷NAÏVETÉ Àlphabet àlphabet",
        "abcdefg1abcdefg_abcdefg Ωabcdefg–abcdefgč", "short word", "À" * 300_000 + " " + "À" * 300_000,
    ] + [f"wonderful beautiful mountain{chr(97 + i % 26)} mountains" for i in range(200)]
    docs = documents(spark, texts).withColumn("word", F.lit("clash")).withColumn("n", F.lit(5))
    docs = docs.unionByName(docs.filter("doc_id > 190")).withColumn("doc_id", F.when(F.col("doc_id") != 20, F.col("doc_id")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert found == counted(rows)


@pytest.mark.parametrize("longest", [9, 32])
def test_forms_equal_all_pairs(spark, longest):
    """Small alphabets make many neighbours; low limits send words both ways."""
    draw = np.random.default_rng(longest)
    words = {}
    for _ in range(800):
        letters = ["abé", "ab", "xyzÿ"][draw.integers(3)]
        word = "".join(draw.choice(list(letters), draw.integers(7, 14)))
        words[word] = int(10 ** draw.uniform(0.4, 4))
    words |= {"a" * n: 10 ** (n - 6) for n in range(7, 14)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert result(spelling.forms(frame, longest=longest)) == plain_forms(words)


def test_very_long_words(spark):
    base = "ab" * 50_000
    words = {base: 5000, base[:-1]: 400, base[1:]: 3, base[:700] + "c" + base[701:]: 30, "c" + base: 2, base + "aa": 2,
             "a" * 8 + "b": 9, "a" * 9 + "b": 100, "a" * 10: 8, "a" * 9: 2, "a" * 7: 2}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.forms(frame, longest=9)) == plain_forms(words)


def test_empty(spark):
    docs = documents(spark, ["word"]).limit(0)
    assert spelling.forms(spelling.vocabulary(docs)).count() == 0
    one = spark.createDataFrame([("abcdefg", 2)], "word string, n long")
    assert result(spelling.forms(one)) == [("abcdefg", None, "abcdefg", 2, 0, None)]


def test_chains_of_forms(spark):
    words = {"abcdefg" + "h" * i: 10 ** (i + 1) for i in range(7)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.forms(frame)) == plain_forms(words)
