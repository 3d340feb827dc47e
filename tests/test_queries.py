"""Every query that has SQL against DuckDB, on the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__

ROOT = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    made = duckdb.connect()
    for name in os.listdir(ROOT):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{name}'")
    return made


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def test_names():
    assert set(SQL) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):  # noqa: ANN001
    found = __spark_entry__.queries()[name](spark, ROOT)
    columns = sorted(found.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


def test_entry(spark):  # noqa: ANN001
    assert __spark_entry__.entry(spark).count() > 0
