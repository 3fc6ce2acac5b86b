"""The columns that SQL can tell, against DuckDB on the same tables."""

import duckdb
import pytest

from tidewell.llm import queries as Q

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["secret_base_counts", "mixing_targets", "pii_base_counts", "token_bytes"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = c.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = Q.queries()[name](spark, DIR)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
