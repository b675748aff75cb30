"""Rollup of file facts over every ancestor folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import half_even
from gneiss.functions.paths import ancestors, parent
from gneiss.operators.inventory import context_band, context_pressure


def folder_band(tokens: Column, files: Column, cfg: Config) -> Column:
    low, mid, high = cfg.folder_tokens
    some, many = cfg.folder_files
    return F.when((tokens > high) | (files > many), "budget_exceeded").when((tokens > mid) | (files > some), "warning").when(tokens > low, "healthy").otherwise("compact")


def rollup(files: DataFrame, cfg: Config) -> DataFrame:
    """One row a folder, . and all ancestors: counts, sums, the top file's score, class, band and shares.

    Every aggregate has a bounded state, so . is reduced by partial sums before
    it is shuffled.
    """
    rows = files.select("*", F.explode(ancestors(F.col("path"))).alias("folder"))
    direct = parent(F.col("path")) == F.col("folder")
    # the smallest path among equals: bytes inverted have the opposite order
    top = F.min_by(F.struct("path", "score", "score_band"), F.struct(-F.col("score"), -F.col("tokens"), F.col("path")))
    out = rows.groupBy("folder").agg(
        F.count("*").alias("n_files"),
        F.count_if(direct).alias("n_direct"),
        F.sum("tokens").alias("tokens"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(direct, F.col("tokens")).otherwise(0)).alias("direct_tokens"),
        F.max("tokens").alias("largest"),
        F.sum("revisions").alias("revisions"),
        half_even(F.avg("churn_pressure")).alias("volatility"),
        F.min("classification").alias("low"),
        F.max("classification").alias("high"),
        top.alias("top"),
    )
    return out.select(
        "folder", "n_files", "n_direct", "tokens", "bytes", "direct_tokens", "revisions", "volatility",
        F.col("top.path").alias("top_file"), F.col("top.score").alias("score"), F.col("top.score_band").alias("score_band"),
        F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed").alias("classification"),
        context_band(F.col("tokens"), cfg.bands).alias("context_band"),
        half_even(context_pressure(F.col("tokens"), cfg.bands)).alias("context_pressure"),
        half_even(F.col("largest") / F.greatest("tokens", F.lit(1))).alias("top_share"),
        folder_band(F.col("direct_tokens"), F.col("n_direct"), cfg).alias("health_band"),
    )


def reasons_in_rank_order(files: DataFrame) -> DataFrame:
    """Each folder's reasons in the order of the first file, by score, tokens and path, that has them.

    A reason's first file is a minimum, so at most six rows a folder are collected.
    """
    rows = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "score", "tokens", "path", F.posexplode("reasons").alias("place", "reason"))
    first = rows.groupBy("folder", "reason").agg(F.min(F.struct(-F.col("score"), -F.col("tokens"), F.col("path"), F.col("place"))).alias("at"))
    return first.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("at", "reason"))).alias("r")).select("folder", F.array_join(F.transform("r", lambda x: x["reason"]), ",").alias("reasons"))


def three_largest(files: DataFrame) -> DataFrame:
    """Share of a folder's tokens in its three largest files; ranked by top_3 state, not by collecting the folder."""
    from pyspark.sql import Window

    rows = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "tokens", "path")
    totals = rows.groupBy("folder").agg(F.sum("tokens").alias("all"))
    by_size = Window.partitionBy("folder").orderBy(F.desc("tokens"), "path")
    top = rows.withColumn("n", F.row_number().over(by_size)).filter("n <= 3").groupBy("folder").agg(F.sum("tokens").alias("top"))
    return totals.join(top, "folder").select("folder", half_even(F.col("top") / F.greatest("all", F.lit(1))).alias("top_3_share"))
