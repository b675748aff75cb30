"""Joins whose tables grow with the input are planned alike at every size."""

from gneiss.plans.joins import HOT, spread_join


def test_cold_keys_are_shuffled_however_few(spark):
    rows = spark.range(5000).selectExpr("if(id < 3000, 0, id) as k", "id")
    lookup = rows.groupBy("k").count()
    for largest in (3000, HOT):
        out = spread_join(rows, lookup, ["k"], "count", 5000, largest)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and (largest > HOT or "BroadcastHashJoin" not in plan)
        assert out.count() == 5000
