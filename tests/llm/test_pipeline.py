import os

import pytest

import corpus_pipeline
from vecloom.llm import decontaminate, toxicity
from vecloom.llm.line_dedup import ORACLE, op4_line_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, docs = docs, out
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > seen[0] // 2
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    first = corpus_pipeline.toxicity(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert toxicity.score_toxicity(first, model).where("predicted = 1").count() == 0
    assert decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0


def test_line_dedup_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(ORACLE).fetchall())
    got = op4_line_dedup(spark, SF).select("doc_id", "n_lines", "kept_chars", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == want
