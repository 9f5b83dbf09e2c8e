import os

import pytest

import corpus_pipeline
from siftlake.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark, tmp_path):
    docs, left = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        counts.append(docs.count())
        if k == 1:
            left = exact_dedup.exact_groups(docs).filter("NOT kept").count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and left == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    total = pieces.agg({"length": "sum"}).first()[0]
    assert total == pieces.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)
