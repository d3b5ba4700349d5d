"""Every core query over whole tables: against its SQL, or run to its last row."""

import pytest
from conftest import DATA, same_rows

from parleyspark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(name, spark, oracle):
    same_rows(catalogue.QUERIES[name](spark, DATA), oracle, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(name, spark, oracle):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert df.columns and len(set(rows)) == len(rows) > 0
