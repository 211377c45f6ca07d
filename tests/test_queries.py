"""Every registered query equals its SQL on the smallest tables."""

import pytest

from checks import all_queries
from checks.compare import compare, connect

QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, tiny, name):
    verdict, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], tiny)
    assert verdict.startswith("ok"), verdict
    assert "TYPES" not in verdict, verdict


def test_entry(spark):
    from __spark_entry__ import entry
    assert entry(spark).count() > 0
