"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import math

import duckdb
import pytest

from marlspike.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(names, rows, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert rows_of(df.columns, got, order) == rows_of(names, want, order)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 320
    assert set(entry.oracle_sql()) <= set(entry.queries())
