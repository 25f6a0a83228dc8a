"""Every query of the engine that SQL can express equals that SQL."""

import pytest
from conftest import same_rows

from substrata.plans import roundtrips as catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    same_rows(catalogue.QUERIES[name](spark, data), duck.sql(catalogue.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"approx_count_block_docs", "estimator_boosted"}))
def test_query_without_sql_has_rows(spark, data, name):
    out = catalogue.QUERIES[name](spark, data)
    assert len(set(out.columns)) == len(out.columns)
    assert out.limit(1).count() == 1
