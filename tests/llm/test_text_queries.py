"""The registered queries: their SQL on the test tables, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from keelson.llm.common import stored
from keelson.llm.queries import ORACLES, QUERIES
from oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    wrong = difference(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name])
    assert wrong is None, wrong


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(driver.queries())


def test_pipeline(spark, docs):
    """On rows with every odd case: no stage crashes, and each keeps the columns."""
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stored(stage(spark, now, SF_DIR))
        counts.append(now.count())
        if name != "mixing":
            assert now.columns == before.columns
    assert counts[0] == counts[1] > counts[2] > 0 and counts[3] == counts[4]
    kept = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 0 < corpus_pipeline.run(spark, SF_DIR).count() < kept.count()
