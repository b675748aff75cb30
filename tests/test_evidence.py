"""Lineage of renames, masks and mismatches."""

from gneiss.functions.udfs import mask_quotes_of
from gneiss.operators import evidence


def test_lineage_follows_chains_strictly_backwards(spark):
    renames = spark.createDataFrame([(2, "b", "c"), (5, "a", "b"), (1, "x", "b")], "seq long, old string, new string")
    aliases = evidence.lineage(renames, spark.createDataFrame([("c",)], "path string"))
    assert sorted(map(tuple, aliases.collect())) == [("a", "c", 5), ("b", "c", 2), ("c", "c", -1)]
    touches = spark.createDataFrame([("k0", 0, "c"), ("k1", 1, "b"), ("k3", 3, "b"), ("k6", 6, "a"), ("k5", 5, "a")], "commit_id string, seq long, path string")
    got = sorted(map(tuple, evidence.follow(touches, aliases).collect()))
    assert got == [("k0", 0, "c"), ("k3", 3, "c"), ("k6", 6, "c")]


def test_quotes_and_mismatches():
    assert mask_quotes_of("a 'b\\'c' don't \"open") == "a  str  don't  str "
    assert evidence.mismatches({"v": 1, "c": 2}, {"v": 2, "c": 3}, ("v", "c"), ("c",)) == [("v", True), ("c", False)]
