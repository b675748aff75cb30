"""Ranges of a key over partitions, hot keys and nulls included."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.plans.ordering import place_by_bounds


@pytest.mark.parametrize("kind", ["unique", "hot", "null", "all-null", "one", "empty"])
def test_ranges_are_in_order_and_hot_keys_are_spread(spark, kind):
    r = random.Random(4)
    hot = {"unique": 0.0, "hot": 0.5, "null": 0.5, "all-null": 1.0, "one": 1.0, "empty": 0.0}[kind]
    value = None if "null" in kind else 77
    rows = [] if kind == "empty" else [(value if r.random() < hot else r.randint(-500, 500), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, i long").withColumn("tie", F.xxhash64("i"))
    placed = place_by_bounds(df, "k", 16, tie=F.col("tie")).withColumn("slot", F.spark_partition_id()).collect()
    assert sorted((x["k"], x["i"]) for x in placed if x["k"] is not None) == sorted(x for x in rows if x[0] is not None) and len(placed) == len(rows)
    order = lambda x: (x["k"] is not None, x["k"] or 0, x["tie"])
    ends = {}
    for x in placed:
        low, high = ends.get(x["slot"], (order(x), order(x)))
        ends[x["slot"]] = min(low, order(x)), max(high, order(x))
    spans = [ends[s] for s in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    if kind in ("hot", "null"):
        sizes = [sum(x["slot"] == s for x in placed) for s in ends]
        assert max(sizes) < 800
