"""Every query with SQL gives the SQL's rows; every other one runs and gives rows."""

import pytest

from silvae.plans.queries import ORACLE, QUERIES
from tests.helpers import SF, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
