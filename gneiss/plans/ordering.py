"""Placing rows in a global order and numbering them without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from gneiss.session import shuffle_partitions
from gneiss.staging import stage


def rank_among(cuts: list, key: Column) -> tuple[Column, Column]:
    """How many ascending cut points are below key, and how many are not above it; two searches of about sqrt(cuts) steps."""
    step = max(1, math.isqrt(len(cuts)))
    heads, every = F.array(*map(F.lit, cuts[::step])), F.array(*map(F.lit, cuts))

    def count(below) -> Column:
        group = F.greatest(F.size(F.filter(heads, below)) - 1, F.lit(0)) * step
        return group + F.size(F.filter(F.slice(every, group + 1, F.lit(step)), below))

    return count(lambda c: c < key), count(lambda c: c <= key)


def place_by_bounds(df: DataFrame, key: str, parts: int | None = None, source: DataFrame | None = None, tie: Column | None = None) -> DataFrame:
    """df with partition i holding the i-th range of (key, tie), nulls first; source is a narrower table to take the cuts from.

    key is numeric; tie is a hash that orders rows of equal key. A key that
    holds several shares of all rows, null included, is spread over as many
    partitions by its tie.
    """
    parts = parts or shuffle_partitions(df.sparkSession)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = (df if source is None else source).agg(F.percentile_approx(F.col(key), shares, 20 * parts).alias("q"), F.count("*").alias("n"), F.count(key).alias("known")).first()
    cuts = sorted(row["q"] or []) if parts > 1 else []
    nulls = -(-(row["n"] - row["known"]) * parts // max(row["n"], 1))
    if not row["n"]:
        return df.repartitionById(1, F.lit(0))
    at = F.lit(0.0) if tie is None else (tie / 2.0**64 + 0.5) * 0.999999
    low, high = rank_among(cuts, F.col(key)) if cuts else (F.lit(0), F.lit(0))
    wide = high - low
    slot = F.when(wide <= 1, high).otherwise(low + 1 + F.floor(at * wide).cast("int")) + nulls
    slot = F.when(F.col(key).isNull(), F.floor(at * nulls).cast("int")).otherwise(slot)
    return df.repartitionById(len(cuts) + 1 + nulls, slot)


def running_total(df: DataFrame, slot: str, order: list[Column], value: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Adds out: the sum of value over all rows before this one in the order of (slot, order).

    slot numbers the range partitions of df; only their totals, one row a
    partition, meet in one place. source is a cheaper table of the same slots
    and values to take the totals from.
    """
    totals = (df if source is None else source).groupBy(slot).agg(F.sum(value).alias("__total"))
    before = totals.select(
        F.col(slot).alias("__slot"),
        F.coalesce(F.sum("__total").over(Window.orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(before), F.col(slot) == F.col("__slot"))
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__slot", "__before", "__inside")
    )


def global_rank(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Adds out: 1 for the first row in a total order, and so on; ranges are ranked apart and offset by their sizes.

    The ranges are staged, so both passes see the same cuts.
    """
    placed = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
    placed = stage(placed.withColumns({"__range": F.spark_partition_id(), "__one": F.lit(1)}), "ranked")
    return running_total(placed, "__range", order, "__one", out).withColumn(out, (F.col(out) + 1).cast("int")).drop("__range", "__one")


def top_counted(rows: DataFrame, order: list[Column], limit: int, every: Observation) -> DataFrame:
    """The first rows in an order, all rows being counted (as n) while they are read once.

    A limit that is known to be no less than the rows there are would be
    dropped, and the sort left would read them twice to find its ranges; a
    generator hides how many there can be.
    """
    counted = rows.observe(every, F.count(F.lit(1)).alias("n"))
    return counted.select("*", F.explode(F.array(F.lit(1))).alias("__once")).drop("__once").orderBy(*order).limit(limit)
