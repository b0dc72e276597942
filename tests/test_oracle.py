"""Every query that has SQL gives the same rows as DuckDB over the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from ledgerlark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, (str, bytes)) and getattr(value, "ndim", 0):
        return str([plain(x) for x in value])
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        number = value.item() if hasattr(value, "item") else value
        if isinstance(number, bool):
            return str(number)
        return str(int(number)) if number == int(number) else f"{number:.8g}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, DATA).count() == 1
