"""Every query with SQL gives DuckDB's rows at the smallest scale; the contract's functions hold together."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue
from tests.conftest import SF

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(rows, columns):
    def one(v):
        return v if isinstance(v, (bool, type(None), str)) else round(float(v), 6)

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_like_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(columns, r, strict=True)) for r in found.fetchall()], columns)


def test_contract(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and catalogue.FLAGSHIP in names
    assert entry.entry(spark).columns
