"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from catalogkit.plans import registry

from . import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare.check(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns
