import math

import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

FOLDER = "/root/testdata/sf0.001"


def rows_of(table):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    names = sorted(table[0])
    return sorted([tuple(plain(v) for _, v in sorted(zip(table[0], row, strict=True))) for row in table[1]], key=repr), names


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    found = duck.execute(registry.oracle_sql()[name])
    want = ([c[0] for c in found.description], found.fetchall())
    assert rows_of((got.columns, [tuple(r) for r in got.collect()])) == rows_of(want)


def test_every_query_has_sql():
    assert len(registry.queries()) > 90 and set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
