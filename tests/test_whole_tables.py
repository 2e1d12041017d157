"""Registered queries over whole tables."""

import pytest

from lodegraph import queries

from .conftest import SF


@pytest.mark.parametrize("name", ["x_optional_all", "x_varlen_all"])
def test_every_customer_is_there(spark, name):
    found = queries.QUERIES[name](spark, SF).select("c").distinct().count()
    assert found == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert name == "x_varlen_all" or queries.QUERIES[name](spark, SF).filter("o is null").count() > 0
