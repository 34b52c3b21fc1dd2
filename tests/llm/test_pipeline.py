"""The pipeline: every stage against a plain version, each on its own input."""

import os

import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_contamination
from test_minhash import plain as plain_groups
from test_mixing import plain_poisson, uniform
from test_quality import plain_cleaned
from test_secrets import base as plain_secrets

import corpus_pipeline
from soundrows.session import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of each stage and the last one's output, as lists of rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [(docs, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out.append((docs, docs.collect()))
    return out


def pairs(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_columns_and_order_of_the_stages(inputs):
    assert len(corpus_pipeline.STAGES) == 5
    for frame, _ in inputs[:-1]:
        assert frame.columns == inputs[0][0].columns
    for _, rows in inputs[1:-1]:
        assert rows and all(r.n_chars == len(r.text) for r in rows)


def test_quality_rules(inputs):
    before, after = inputs[0][1], inputs[1][1]
    judged = [(r.doc_id, *plain_cleaned(r.text)) for r in before]
    assert pairs(after) == sorted((doc, text) for doc, kept, text in judged if kept)


def test_near_duplicates(inputs):
    before, after = inputs[1][1], inputs[2][1]
    judged = plain_groups([(r.doc_id, r.text) for r in before])
    heads = {doc for doc, n, _, own in judged if own}
    assert pairs(after) == pairs(r for r in before if r.doc_id in heads)


def test_decontamination(inputs, spark):
    before, after = inputs[2][1], inputs[3][1]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    judged = plain_contamination([(r.doc_id, r.text) for r in before], items)
    clean = {doc for doc, _, n_hit, _ in judged if not n_hit}
    assert pairs(after) == pairs(r for r in before if r.doc_id in clean)


def test_secrets(inputs):
    before, after = inputs[3][1], {r.doc_id: r for r in inputs[4][1]}
    assert len(before) == len(after)
    for r in before:
        spans = plain_secrets(r.text)
        if not spans and "[secret]" not in after[r.doc_id].text:
            assert after[r.doc_id].text == r.text
        for span in spans:
            _, a, b = span.split(":")
            assert r.text[int(a) : int(b)] not in after[r.doc_id].text


def test_mix(inputs):
    before, after = inputs[4][1], inputs[5][1]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    weight = sum(n**0.5 for n in sizes.values())
    copies = {}
    for r in after:
        copies.setdefault(r.doc_id, []).append((r.copy, r.text))
    for r in before:
        n = sizes[r.source]
        want = plain_poisson(len(before) * n**0.5 / weight / n, uniform(20, 1, r.doc_id))
        assert sorted(copies.get(r.doc_id, [])) == [(i + 1, r.text) for i in range(want)]


def test_run_equals_the_stages(inputs, spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert sorted(rows.collect()) == sorted(inputs[5][1])
    assert rows.select(F.count_distinct("place")).first()[0] == len(inputs[5][1])
