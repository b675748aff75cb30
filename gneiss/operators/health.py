"""Health rollups: distributions, profiles, findings and watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import half_away

#: What each reason code says in a finding.
SAYINGS = {
    "critical_token_cost": "exceeds the configured context budget",
    "high_token_cost": "is near the configured context budget",
    "high_revision_frequency": "changes frequently",
    "high_relative_churn": "has high churn relative to its size",
    "old_file": "has not been substantially refreshed recently",
    "old_and_volatile": "is older and still changes substantially",
}


def distribution(files: DataFrame) -> DataFrame:
    """Count, total, interpolated percentiles, maximum and the shares of the largest 1, 5 and 10; one row."""
    q = F.percentile("tokens", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    one = files.agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"), q.alias("q"), F.max("tokens").alias("largest"))
    top = files.select("tokens").orderBy(F.desc("tokens")).limit(10).agg(F.sort_array(F.collect_list("tokens"), asc=False).alias("top"))
    share = lambda k: half_away(F.aggregate(F.slice("top", 1, k), F.lit(0).cast("long"), lambda a, x: a + x) / F.greatest("tokens", F.lit(1))).alias(f"top_{k}_share")
    return one.crossJoin(F.broadcast(top)).select("n_files", "tokens", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))], "largest", share(1), share(5), share(10))


def by_profile(files: DataFrame) -> DataFrame:
    return files.groupBy("profile").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


def by_language(files: DataFrame) -> DataFrame:
    """Totals of profile and language with the share of the profile's tokens."""
    rows = files.groupBy("profile", "language").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("share", half_away(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("profile"))))


def on_watch(cfg: Config) -> Column:
    return (F.col("context_band") == "healthy") & (F.col("tokens") >= cfg.bands.healthy * 3 // 4)


def watchlist(files: DataFrame, cfg: Config) -> DataFrame:
    """Files in the last quarter of the healthy band, largest first."""
    return files.filter(on_watch(cfg)).select("path", "tokens", "classification", (F.lit(cfg.bands.healthy) - F.col("tokens")).alias("headroom"))


def findings(files: DataFrame, cfg: Config, classes: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row for each file to tell about: severity, title and message."""
    context, score = F.col("context_band"), F.col("score_band")
    rows = files.filter(F.col("classification").isin(*classes) & (context.isin("warning", "critical") | score.isin("high", "critical") | on_watch(cfg)))
    severity = F.when((context == "critical") | (score == "critical"), "error").when((context == "warning") | (score == "high"), "warning").otherwise("notice")
    title = F.when(context == "critical", "Context budget exceeded").when(context == "warning", "Context budget warning").when(score.isin("high", "critical"), "High maintenance pressure").otherwise("Context headroom is narrowing")
    said = F.create_map(*[F.lit(x) for pair in SAYINGS.items() for x in pair])
    plain = F.when(context == "critical", "tokens exceed the configured fail threshold").when(context == "warning", "tokens are in the configured warning band").otherwise("tokens leave limited context headroom")
    told = F.when(F.size("reasons") > 0, F.array_join(F.transform("reasons", lambda r: F.coalesce(F.try_element_at(said, r), F.replace(r, F.lit("_"), F.lit(" ")))), "; ")).otherwise(F.format_string("%d %s", "tokens", plain))
    return rows.select("path", severity.alias("severity"), title.alias("title"), "tokens", "score", F.format_string("%s has %d tokens and a pressure score of %.1f: %s.", "path", "tokens", "score", told).alias("message"))
