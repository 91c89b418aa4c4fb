"""Every query of the core with SQL against that SQL, on the smallest tables."""

from pathlib import Path

import pytest
from compare import same

from kithgraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name], FOLDER)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.SQL
