import pytest

from lodegraph import queries

from .conftest import SF
from .oracle import connect, same


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])
