"""Every query with SQL gives what DuckDB gives."""

import pytest

from photowarden import catalog_exports as catalog
from tests.conftest import duck, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck(sf).sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
