"""Every registered query of the library on the smallest tables, against its SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from folio.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canon(df):
    def value(x):
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        if isinstance(x, list):
            return tuple(x)
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        return round(x, 9) if isinstance(x, float) else x

    return sorted(repr(tuple(value(x) for x in row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF).toPandas()
    sql = registry.ORACLES.get(name)
    if sql:
        wanted = duck.execute(sql).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert canon(found) == canon(wanted)
    else:
        assert len(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
