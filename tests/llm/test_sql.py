"""Each query that has SQL against it on DuckDB."""

import duckdb
import pytest

from fieldglass.llm import registry
from tests.test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall()) and sorted(names) == sorted(df.columns)
