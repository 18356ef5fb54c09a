"""Every registered query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from hirelake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return str(pd.Timestamp(x)) if type(x).__name__ in ("Timestamp", "datetime", "date") else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
