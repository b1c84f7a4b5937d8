"""Each registered query against its SQL."""

from __future__ import annotations

import pytest

from strataframe.plans import registry

from .oracle import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, con, name):
    check(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
