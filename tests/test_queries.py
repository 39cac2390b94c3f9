"""Every query of the engine's own operators against its SQL on the smallest tables."""

import pytest

from tests.compare import connect, spark_rows, sql_rows
from veldspar.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert len(set(names)) == len(names)
    if name in ORACLE_SQL:
        assert (names, rows) == sql_rows(con, ORACLE_SQL[name])


def test_plans_keep_to_the_scan(spark, sf_dir):
    plan = QUERIES["v1_topk_cosine"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "Python" not in plan and "Arrow" not in plan
    plan = QUERIES["v7_all_roots_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
