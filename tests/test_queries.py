"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver

from .oracle_check import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert driver.entry(spark).columns == ["ate", "band", "n_strata"]


def test_acceptance_figure(spark):
    """The adjusted effect on the medium tables, worked out in advance."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    row = QUERIES["backdoor_ate"](spark, folder).first()
    assert (row["ate"], row["band"]) == (-0.011954, 0.010857)
    row = QUERIES["before_after_ate"](spark, folder).first()
    assert row["ate"] == -0.002793 and row["variance"] == pytest.approx(1.7803e-05, abs=1e-8)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


# Those of the optional subpackage have tests of their own.
WITHOUT_SQL = sorted(n for n in QUERIES.keys() - SQL.keys() if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
