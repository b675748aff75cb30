"""Lookups see every temporal edge, whatever its support."""

from pyspark.sql import functions as F

from gneiss.queries import history


def test_lookups_take_all_temporal_edges(spark, sf, monkeypatch):
    some = history.fx.touches(spark, sf).filter(F.pmod(F.xxhash64("commit_id"), F.lit(12)) == 0).checkpoint()
    monkeypatch.setattr(history.fx, "touches", lambda *_: some)
    want = {(r["a"], r["b"]): r["support"] for r in history.temporal_coupling(spark, sf).collect()}
    assert want and min(want.values()) < 14
    assert {(r["a"], r["b"]) for r in history.related(spark, sf).collect()} == set(want)
