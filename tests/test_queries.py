import pytest

import __spark_entry__ as entry
from tidefold.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "v", "seq"]
    assert set(registry.QUERIES) <= set(entry.queries())


def test_only_needed_columns_are_read(spark, sf):
    plan = registry.QUERIES["latest_snapshot"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("FileScan parquet [") :].partition("]")[0]
    assert "props#" in read and "value#" not in read and "ts#" not in read


def test_a_range_reaches_the_scan_of_runs(spark, tmp_path):
    from tidefold.operators import fold
    from tidefold.sources.runs import RunStore

    store = RunStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([("a", 1, "x", 0)], "k string, op int, v string, seq long"))
    plan = fold.point_get(store.read(), "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan
