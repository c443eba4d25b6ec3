"""Every registered query of the library proper against its SQL, on the smallest tables."""

import pytest

from cairn import catalog_queries as Q
from tests.compare import same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(name, spark, sf, duck):
    same(Q.QUERIES[name](spark, sf), duck, Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows(name, spark, sf):
    assert Q.QUERIES[name](spark, sf).count() > 0
