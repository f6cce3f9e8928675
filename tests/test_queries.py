"""Every named query against its SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry_module
from tools.check_queries import rows_of

NAMES = sorted(entry_module.queries())
PYTHON_QUERIES = {"decode_guess", "polish_hook", "prompt_rewrite"}


def check_plan(name, df):
    """No cross joins, no row-at-a-time Python, Arrow Python only where a user function runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name in PYTHON_QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = entry_module.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    check_plan(name, df)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_is_lazy_and_filled(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["Address", "Count", "Roles", "Domains", "Names"]
    assert df.count() > 0
