"""Every registered query of the graph engine against DuckDB on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from lattica.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """The queries' results, made several at a time: on small tables most of a query is waiting."""
    with ThreadPoolExecutor(6) as pool:
        yield {k: pool.submit(lambda f=f: f(spark, SF).toPandas()) for k, f in QUERIES.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(results, name):
    got = results[name].result()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck(ORACLE_SQL[name], SF))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
