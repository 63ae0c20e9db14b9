"""Every registered query against its DuckDB text."""

import pytest

from conftest import SMALL
from __spark_entry__ import entry
from gatewright.catalog import registered
from gatewright.catalog.registry import callable_for
from parity import compare, duck

QUERIES = {name: callable_for(fn) for name, (fn, _) in registered().items()}
SQL = {name: sql for name, (_, sql) in registered().items() if sql}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_every_survey_id_is_registered():
    wanted = {f"{letter}{i}" for letter, n in dict(a=19, b=20, c=18, d=20, e=7, f=6, g=3, h=31, i=13, j=25, k=8, l=4).items()
              for i in range(1, n + 1)}
    assert wanted == {n.split("_")[0] for n in QUERIES}


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
