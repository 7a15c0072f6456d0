"""Each query with SQL of its own gives that SQL's rows; the others give rows that make sense."""

import pytest
from compare import assert_same

from matchloom.plans import catalog

ORACLES = catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    assert_same(catalog.QUERIES[name](spark, small), ORACLES[name], small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.QUERIES)


def test_fitted_models(spark, small):
    folds = catalog.walk_forward_lr(spark, small).collect()
    assert folds and all(r["n_train"] >= 100 and 0 < r["ll_oos"] < 2 for r in folds)
    priced = catalog.predicted_markets(spark, small).collect()
    assert priced and all(0 <= r["p"] <= 1 for r in priced)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
