"""Operators against their SQL on the smallest tables."""

import os

import pytest

from tarnfold.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_equals_sql(spark, same_as_sql, name):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name])
