"""Queries of training-data operators that SQL can express."""

import duckdb
import pytest

from modweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r) for r in c.sql(ORACLES[name]).project(", ".join(columns)).fetchall()), key=repr)
