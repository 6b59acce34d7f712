"""Plan checks: no single-partition step on data-sized input, pushdown reaches the scan."""
from sluice.plans import registry as R
from tests.conftest import SF01


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_and_fill_down_do_not_funnel(spark):
    df = R.fill_down(spark, SF01)
    text = plan_text(df)
    assert "SinglePartition" not in text
    assert "Window" in text


def test_dedupe_aggregates_partially(spark):
    text = plan_text(R.keep_first_q(spark, SF01))
    assert "SinglePartition" not in text
    assert "partial_min_by" in text or "partial" in text


def test_where_project_pushes_down(spark):
    df = R.where_project(spark, SF01)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThan(l_quantity,30.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(E.queries()) >= set(E.oracle_sql())
