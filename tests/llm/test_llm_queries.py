"""The registered queries of the llm folder on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparklogs.llm import queries

DATA = "/root/testdata/sf0.001"


OWN_TABLES = {"op12_negatives", "op13_conversations"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OWN_TABLES))
def test_query_gives_a_row_for_each_document(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, DATA).select(columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())


def test_pipeline_is_registered(spark):
    assert "pipeline" in entry.queries() and entry.queries()["pipeline"](spark, DATA).count() > 0
