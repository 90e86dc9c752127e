"""Every query with an oracle gives what DuckDB gives on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.date | pd.Timestamp):
        return str(pd.Timestamp(v))
    if hasattr(v, "item"):
        return plain(v.item())
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: [(x is not None, str(type(x)), x if not isinstance(x, float) else round(x, 3)) for x in r])


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)


def compared(spark, duck, query, sql):
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not wrong, wrong[:3]


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    compared(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
