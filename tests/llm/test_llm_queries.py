"""Every registered query of the subpackage against its SQL, over the smallest tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__
from soundrows.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(spark, connect(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_on_all_rows(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name in ("op4_pii_surrogates", "op7_secret_scan", "op13_token_alignment"):
        assert rows.count() == rows.select("doc_id").distinct().count() == documents
    elif name == "op2_token_counts":
        assert {r.docs_total for r in rows.filter("all_sources").collect()} == {documents}
    elif name == "op11_best_fit_packing":
        assert rows.select("doc_id").distinct().count() == documents
    else:
        assert rows.count() >= documents // 2


def test_all_operators_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
