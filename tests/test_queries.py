"""Every registered query of the library against its SQL twin on the smallest tables."""

import pytest
from compare import rows

from fieldloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, folder, name):
    got = catalog.QUERIES[name](spark, folder).toPandas()
    if name in catalog.ORACLES:
        columns, want = rows(duck.sql(catalog.ORACLES[name]).df())
        assert rows(got) == (columns, want)
    else:
        assert len(got)


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
