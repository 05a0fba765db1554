"""The registered corpus queries against their SQL on the smallest tables."""

import pytest
from conftest import SMALL, rows_of

from arborea.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SMALL).toArrow()) == rows_of(duck.sql(queries.ORACLE_SQL[name]).to_arrow_table())
