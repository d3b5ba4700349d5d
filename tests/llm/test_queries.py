"""The queries on training text against their SQL, over whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA, same_rows  # noqa: E402

from parleyspark.llm import catalogue  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(name, spark, oracle):
    same_rows(catalogue.QUERIES[name](spark, DATA), oracle, catalogue.SQL[name])
