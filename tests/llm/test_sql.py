"""The dealt queries against their SQL."""

import duckdb
import pandas as pd
import pytest

from quarry.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or pd.isna(v):
        return None
    return v if isinstance(v, (bool, str)) else round(float(v), 6)


def rows(df):
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
