"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from docmark.plans.oracle import ORACLE
from docmark.plans.queries import QUERIES
from tests.support import differences


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, name, sf_dir) == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "mime", "error", "markdown"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
