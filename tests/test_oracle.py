"""Every registered query of the engine against its SQL in DuckDB; those without SQL run and give rows."""

import math

import duckdb
import pandas as pd
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(pdf):
    return sorted(tuple(map(norm, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, small, name):
    df = catalog.queries()[name](spark, small)
    # toPandas() makes floats of whole numbers where a column has nulls
    got = df.toPandas().astype({c: "Int64" for c, kind in df.dtypes if kind in ("bigint", "int")})
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
