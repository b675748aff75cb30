"""The cache: writers at once, eviction, touches, and counts by what they depend on."""

import threading

from pyspark.sql import functions as F

from gneiss.sources import cache as module
from gneiss.sources.cache import Cache, cached_counts


def rows(spark, first, n, value=1):
    return spark.range(first, first + n).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(value).cast("long").alias("value"), F.lit(10).cast("long").alias("bytes"))


def test_two_writers_never_double_a_key(spark, tmp_path):
    root, failed = f"file://{tmp_path}/c", []

    def write(first):
        try:
            Cache(spark, root).add(rows(spark, first, 60, first), first)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i * 20,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    cache = Cache(spark, root)
    got = cache.entries()
    assert not failed and got.count() == got.select("key").distinct().count() == 120
    assert cache.versions() == list(range(1, len(cache.versions()) + 1)) and len(cache.versions()) >= 2
    assert not [p for p in (tmp_path / "c" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_lost_claim_is_tried_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    first, second = Cache(spark, root), Cache(spark, root)
    claim, raced = first.claim, []

    def slow(version, manifest):
        if not raced:  # another commits the same keys in between
            raced.append(second.add(rows(spark, 5, 10, 2), 1))
        return claim(version, manifest)

    monkeypatch.setattr(first, "claim", slow)
    assert first.add(rows(spark, 0, 10, 1), 1) == 5 and raced == [10]
    assert {r["key"]: r["value"] for r in first.entries().collect()} == {f"k{i}": 1 if i < 5 else 2 for i in range(15)}


def test_least_recently_used_goes_first(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/c")
    assert cache.prune(5, 5)["entries"] == 0
    for t in range(5):
        cache.add(rows(spark, t * 10, 10), t)
    cache.touch(rows(spark, 0, 3), 9)
    left = lambda: {r["key"] for r in cache.entries().collect()}
    want = {"k0", "k1", "k2", *(f"k{i}" for i in range(40, 50))}
    assert cache.prune(13, 1 << 40, dry_run=True) == {"entries_before": 50, "bytes_before": 500, "entries": 13, "bytes": 130} and len(left()) == 50
    assert cache.prune(100, 139)["entries"] == 13 and left() == want
    assert cache.prune(2, 1000)["entries"] == 2 and left() == {"k1", "k2"}
    assert cache.prune(2, 1000)["entries"] == 2 and len(cache.versions()) == module.KEPT
    assert cache.prune(0, 0)["entries"] == 0 and left() == set()


def test_many_parts_are_written_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "PARTS", 3)
    cache = Cache(spark, f"file://{tmp_path}/c")
    for t in range(5):
        assert cache.add(rows(spark, t * 2, 3), t) == (3 if t == 0 else 2)
    assert len(cache.newest()[1]["parts"]) <= 3 and cache.entries().count() == 11


def test_counts_depend_on_all_they_are_made_with(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    texts = spark.createDataFrame([("a", "one"), ("b", "three"), ("a", "one"), ("c", None)], "content string, text string")
    size = lambda t: F.coalesce(F.length(t), F.lit(0))
    want = {("a", 3), ("b", 5), ("c", 0)}
    for about in (("t1", 100, "whole"), ("t1", 100, "whole"), ("t1", 50, "whole"), ("t1", 100, "cut")):
        assert {tuple(r) for r in cached_counts(texts, root, size, 1, *about).collect()} == want
    assert Cache(spark, root).entries().count() == 9
