"""Every query of the library against its SQL twin on the smallest data."""

import datetime
import decimal

import duckdb
import pytest

from pricewright import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=str)
    assert df.schema.fieldNames()
    if name not in plans.oracle_sql():
        assert rows
        return
    sql = plans.oracle_sql()[name]
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    expected = sorted((plain(tuple(r[i] for i in order)) for r in relation.fetchall()), key=str)
    assert rows == expected
