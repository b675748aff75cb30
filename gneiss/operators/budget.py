"""The longest prefix of all paths whose analysis fits in a memory budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.session import shuffle_partitions
from gneiss.staging import stage

#: Bytes that an analysis takes besides its inputs; for a pair, a path and a commit.
FLOOR, PAIR, PATH, COMMIT = 64 << 20, 256, 1024 + 4096, 384


def memory_of(n_paths: Column, n_bytes: Column, n_commits: int, max_pairs: int) -> Column:
    """Estimated peak memory of the analysis of so many paths and bytes."""
    size = n_bytes.cast("decimal(38,0)")
    return (3 * size + F.floor(size / 2) + n_paths * (max_pairs * PAIR + PATH) + n_commits * COMMIT + FLOOR).cast("decimal(38,0)")


def fitting_prefix(files: DataFrame, budget: int, n_commits: int, max_pairs: int = 20) -> tuple[DataFrame, dict]:
    """(path, bytes) of the longest prefix in path order that fits, and n_paths, n_bytes and memory of it.

    Paths are staged in ranges. The totals of the ranges, a row each, tell which
    range holds the cut; only that range is opened and walked over, those before
    it are taken whole. Nothing fits a budget below the floor. Null sizes are 0.
    """
    rows = files.select("path", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    parts = shuffle_partitions(files.sparkSession)
    placed = stage(rows.repartitionByRange(parts, "path").withColumn("slot", F.spark_partition_id()), "budget-ranges")
    totals = placed.groupBy("slot").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select("slot", "n", "b", F.sum("n").over(upto).alias("n_upto"), F.sum("b").over(upto).alias("b_upto"))
    fits = memory_of(F.col("n_upto"), F.col("b_upto"), n_commits, max_pairs) <= budget
    found = totals.agg(F.max(F.when(fits, F.struct("slot", "n_upto", "b_upto"))).alias("whole"), F.min(F.when(~fits, F.col("slot"))).alias("cut")).first()
    n, size = (found["whole"]["n_upto"], found["whole"]["b_upto"]) if found["whole"] else (0, 0)
    taken = placed.filter(F.col("slot") < (found["cut"] if found["cut"] is not None else 1 << 30))
    if found["cut"] is not None:
        along = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = placed.filter(F.col("slot") == found["cut"]).withColumns({"k": F.row_number().over(Window.orderBy("path")), "s": F.sum("bytes").over(along)})
        inside = inside.filter(memory_of(F.col("k") + n, F.col("s") + size, n_commits, max_pairs) <= budget)
        more = inside.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
        taken = taken.unionByName(inside.select(*placed.columns))
        n, size = n + more["n"], size + more["b"]
    memory = 3 * size + size // 2 + n * (max_pairs * PAIR + PATH) + n_commits * COMMIT + FLOOR
    return taken.select("path", "bytes"), {"n_paths": n, "n_bytes": size, "memory": memory}
