"""Every registered query against its oracle statement, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle.parameters import REPORT_PARAMETERS
from entitylake.plans.registry import QUERIES
from entitylake.plans.reports import REPORTS
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Queries whose question has no answer in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_everything_is_registered_and_has_an_oracle():
    assert len(REPORTS) == 47
    assert set(REPORTS) == set(REPORT_PARAMETERS)
    layers = set(QUERIES) | {f"report_{name}" for name in REPORTS}
    assert layers <= set(entry.queries())
    assert layers <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, connection, name):
    problem = compare(spark, connection, FOLDER, name, entry.oracle_sql()[name])
    assert problem == ("no rows" if name in EMPTY else None)
