"""Per-file facts, bands and preflight estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.config import Bands, Config
from gneiss.functions import paths, text as texts
from gneiss.functions.numeric import clip

BAND_NAMES = ("healthy", "watch", "warning", "critical")


def context_band(tokens: Column, bands: Bands) -> Column:
    return F.when(tokens <= bands.healthy, "healthy").when(tokens <= bands.watch, "watch").when(tokens <= bands.warning, "warning").otherwise("critical")


def context_pressure(tokens: Column, bands: Bands) -> Column:
    return clip(tokens / F.lit(float(bands.warning)))


def inventory(files: DataFrame, cfg: Config, marked: bool = False) -> DataFrame:
    """files (path, bytes, tokens, ...) with everything that a path and a size say.

    With marked, a file whose text says that it is generated is of that class.
    """
    path = F.col("path")
    own = paths.classification(path)
    return files.select(
        "*",
        paths.language(path).alias("language"),
        (F.when(F.coalesce(texts.generated_marker(F.col("text")), F.lit(False)), "generated").otherwise(own) if marked else own).alias("classification"),
        paths.profile(path, F.col("bytes"), cfg.data_min_bytes).alias("profile"),
        paths.structural_mode(path).alias("mode"),
        context_band(F.col("tokens"), cfg.bands).alias("context_band"),
        context_pressure(F.col("tokens"), cfg.bands).alias("context_pressure"),
    )


def band_counts(files: DataFrame) -> DataFrame:
    """Files and tokens of every band, zero where a band is empty."""
    spark = files.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(BAND_NAMES)], "band_rank int, context_band string")
    counts = files.groupBy("context_band").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))
    return names.join(counts, "context_band", "left").select("context_band", "band_rank", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def share_by_root(files: DataFrame) -> DataFrame:
    """Tokens of each root, its share of all, and the share of its largest file; sums before windows."""
    roots = files.groupBy(paths.root(F.col("path")).alias("root")).agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    whole = roots.agg(F.sum("tokens").alias("whole"))
    return roots.crossJoin(F.broadcast(whole)).select("root", "tokens", (F.col("tokens") / F.col("whole")).alias("share"), (F.col("largest") / F.col("tokens")).alias("largest_share"))


def rank_in_folder(files: DataFrame, top: int = 3) -> DataFrame:
    """Each folder's largest files with their share of its direct tokens."""
    folder = paths.parent(F.col("path"))
    rows = files.withColumn("folder", folder)
    by_size = Window.partitionBy("folder").orderBy(F.desc("tokens"), "path")
    first = rows.withColumn("position", F.row_number().over(by_size)).filter(F.col("position") <= top)
    totals = rows.groupBy("folder").agg(F.sum("tokens").alias("folder_tokens"))
    return first.join(totals, "folder").select("folder", "path", "position", "tokens", F.try_divide("tokens", "folder_tokens").alias("share"))


def text_facts(files: DataFrame) -> DataFrame:
    """Line counts, fenced lines, inline tests and generated markers of every file."""
    language = paths.language(F.col("path"))
    body = F.col("text")
    counted = files.withColumn("c", texts.text_lines(body, language))
    return counted.select("path", "c.*", texts.inline_tests(body, language).alias("inline_tests"), texts.generated_marker(body).alias("generated"))


def apply_overrides(files: DataFrame, overrides: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """The last matching (glob, classification, profile) wins as a whole; nulls in it keep the file's own values."""
    path, last = F.col("path"), F.lit(None).cast("struct<classification:string,profile:string>")
    for glob, classification, profile in overrides:
        hit = F.struct(F.lit(classification).cast("string").alias("classification"), F.lit(profile).cast("string").alias("profile"))
        last = F.when(path.rlike(paths.glob_regex(glob)), hit).otherwise(last)
    rows = files.withColumn("override", last)
    return rows.withColumn("classification", F.coalesce("override.classification", "classification")).withColumn("profile", F.coalesce("override.profile", "profile")).drop("override")


def estimate(files: DataFrame, n_commits: int, max_pairs: int = 20) -> DataFrame:
    """One row: time, memory and breadth to expect from the inventory's size."""
    mib, kib4, thousand2 = 1 << 20, 4 << 20, 2000
    one = files.agg(F.count("*").alias("n_paths"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"))
    warm = F.greatest(F.lit(6), F.ceil(F.col("n_bytes") / kib4) + F.ceil(F.col("n_paths") / thousand2) + F.lit(-(-n_commits // 5000)))
    memory = F.floor(F.col("n_bytes") * 3.5) + F.col("n_paths") * (max_pairs * 256 + 1024 + 4096) + n_commits * 384 + 64 * mib
    return one.select("n_paths", "n_bytes", warm.cast("long").alias("warm_s"), F.greatest(F.lit(10), 2 * warm).cast("long").alias("cold_s"), memory.cast("long").alias("memory"), F.floor(memory * 0.75).cast("long").alias("memory_low"), F.floor(memory * 1.75).cast("long").alias("memory_high"))
