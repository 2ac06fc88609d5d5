"""Every core query that has SQL agrees with it on the smallest tables; the others run."""

from __future__ import annotations

import oracle
import pytest

from scholion.plans import catalog


@pytest.fixture(scope="session")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.sql().get(name)
    if sql:
        assert oracle.compare(con, df, sql) is None
    else:
        assert df.columns and df.count() >= 0
