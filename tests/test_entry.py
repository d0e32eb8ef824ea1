"""Every registered core query against its SQL on the smallest tables."""

import datetime
import os
from collections import Counter

import pytest

from stepmill.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        name, path = f.removesuffix(".parquet"), f"{DATA}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None) if v.tzinfo is None else v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    from pyspark.sql import functions as F

    df = QUERIES[name](spark, DATA)
    # session time zones of driver processes differ, so times are compared as text
    cols = sorted(df.columns)
    times = {c for c, t in df.dtypes if t == "timestamp"}
    rows = df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in times else c for c in cols)).collect()
    if name not in SQL:
        assert rows
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = rel.fetchall()
    text = lambda c, v: plain(v).strftime("%Y-%m-%d %H:%M:%S.%f") if c in times and v is not None else plain(v)
    assert Counter(tuple(map(plain, r)) for r in rows) == Counter(tuple(text(c, r[names.index(c)]) for c in cols) for r in want)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
