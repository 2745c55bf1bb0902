"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from changelake.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"create view {Path(path).stem} as select * from read_parquet('{path}')")
    return connection


def plain(rows):
    def value(x):
        if hasattr(x, "isoformat"):
            return x.replace(tzinfo=None).isoformat()
        return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x

    return sorted([tuple(map(value, r)) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
