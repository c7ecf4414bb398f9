import duckdb
import pytest

import __spark_entry__ as entry
from modweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part lineitem documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r) for r in duck.sql(ORACLES[name]).project(", ".join(columns)).fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["scc_id", "node", "size"]
    assert set(ORACLES) <= set(entry.oracle_sql())
