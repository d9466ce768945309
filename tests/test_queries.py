"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as contract

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return str(v) if isinstance(v, str) else round(float(v), 6) + 0.0

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert contract.entry(spark).count() == 5942
