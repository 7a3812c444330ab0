"""Every registered query against its check SQL, over whole tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_points
from corpusbrief.plans import catalog, oracles

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def engine(data_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(repr(round(r[i], 12)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shown)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query(spark, data_dir, engine, name):
    df = entry_points.queries()[name](spark, data_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = engine.execute(entry_points.oracle_sql()[name])
    assert got == _rows([c[0] for c in found.description], found.fetchall())


def test_entry(spark, data_dir):
    assert entry_points.entry(spark).count() > 0
