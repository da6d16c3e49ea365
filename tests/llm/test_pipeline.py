"""The corpus pipeline, stage by stage, and the text queries against their SQL."""

import os

import pytest

import corpus_pipeline
from checks import compare
from estilens.llm import decontaminate, secrets
from estilens.llm.common import read_table, staged
from estilens.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    status, rows = compare.compare_rows(QUERIES[name](spark, SF_DIR), compare.database(SF_DIR), name)
    assert status == "ok" and rows


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) < set(QUERIES)


def test_stages(spark):
    docs = read_table(spark, SF_DIR, "documents")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = staged(stage(spark, docs, SF_DIR), name)
        rows = docs.collect()
        ids = {r["doc_id"] for r in rows}
        assert ids <= before and len(ids) == len(rows) and docs.columns[:len(columns)] == columns
        assert docs.columns == columns or name == "source_mixing"
    assert ids and all(r["rate"] > 0 for r in docs.collect())
    # Nothing is left for an earlier stage to find.
    texts = docs.select(*columns)
    assert not secrets.report(texts).filter("n_assign + n_access + n_hex > 0").count()
    assert not decontaminate.contamination(texts, read_table(spark, SF_DIR, "benchmark")).filter("contaminated").count()


def test_stages_of_an_empty_table(spark):
    docs = read_table(spark, SF_DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0
