"""Every query against its SQL on DuckDB, as sorted rows; queries without SQL must at least run."""

import datetime
import math
import os

import duckdb
import pytest

from fieldglass import oracles, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = df.collect()
    if name not in oracles.SQL:
        assert found
        return
    want = duck.execute(oracles.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    expected = rows(names, want.fetchall())
    assert expected
    assert rows(df.columns, found) == expected
