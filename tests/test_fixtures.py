"""The relations made of the test tables."""

from gneiss.sources import fixtures as fx


def test_tasks_of_touches_do_not_grow_with_the_input(spark, sf, monkeypatch):
    whole = sorted(map(tuple, fx.touches(spark, sf).collect()))
    monkeypatch.setattr(fx, "TASK_ROWS", 400)
    rows = fx.touches(spark, sf)
    lines = fx.table(spark, sf, "lineitem").count()
    assert rows.rdd.getNumPartitions() >= lines / 400 > 8
    assert sorted(map(tuple, rows.collect())) == whole
    assert fx.spread(spark.range(1000), "id").rdd.getNumPartitions() == spark.range(1000).rdd.getNumPartitions()


def test_related_makes_the_pairs_of_commits_once(spark, sf, monkeypatch):
    from gneiss.queries import history

    made, pairs = [], history.coupling.pairs
    monkeypatch.setattr(history.coupling, "pairs", lambda *a: made.append(1) or pairs(*a))
    assert history.related(spark, sf).columns == ["a", "b", "kind", "score"] and len(made) == 1
