"""Every query that has SQL gives the SQL's rows; every other one runs and has rows."""

import os

import pytest

from tests.oracle import duck_rows, spark_rows
from weftline.queries import crawl, extra, links, misc, urls
from weftline.queries.base import typed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {n: f for m in (urls, links, crawl, misc, extra) for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in (urls, links, crawl, misc, extra) for n, s in m.ORACLE.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(typed(name, ORACLE[name]), SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
