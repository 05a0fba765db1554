"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL, rows_of

from arborea.plans import registry

NO_ROWS_HERE = {"seed_columns"}  # the smallest tables have one supplier a nation


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toArrow()
    if name in registry.ORACLE_SQL:
        assert rows_of(got) == rows_of(duck.sql(registry.ORACLE_SQL[name]).to_arrow_table())
    assert got.num_rows or name in NO_ROWS_HERE
