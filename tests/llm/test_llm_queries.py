"""Registered queries against their SQL, and the pipeline against its parts."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from bindwell.llm import queries
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(con.execute(queries.ORACLES[name]).df())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns, name
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids <= {r[0] for r in left.select("doc_id").collect()}
        left = docs.where(docs["doc_id"].isin(sorted(ids)))
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
