"""Rollups and retention of evidence: folder overlays, pruned reports, merged clusters, lineage of renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import half_away
from gneiss.functions.paths import ancestors, is_verification
from gneiss.operators.overlays import containing, name_stem
from gneiss.staging import drop, stage


def folder_overlays(files: DataFrame, means: list[str], flags: list[str], maxima: list[str]) -> DataFrame:
    """Over every ancestor folder: means, whether any file has a flag, maxima, and the file with the largest first maximum."""
    rows = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "path", *means, *flags, *maxima)
    return rows.groupBy("folder").agg(
        *[half_away(F.avg(c)).alias(f"mean_{c}") for c in means],
        *[F.bool_or(c).alias(f"any_{c}") for c in flags],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
        F.min_by("path", F.struct(-F.coalesce(maxima[0], F.lit(0.0)), F.col("path"))).alias("top_path"),
    )


def folder_terms(terms: DataFrame, limit: int = 20) -> DataFrame:
    """The first terms by name of all files below each folder, at most limit; ranked before they are collected."""
    from pyspark.sql import Window

    rows = terms.select(F.explode(ancestors(F.col("path"))).alias("folder"), "term").distinct()
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("term"))).filter(F.col("k") <= limit)
    return first.groupBy("folder").agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("terms"))


def eligible(rows: DataFrame) -> DataFrame:
    """Files that structural ranking takes: large, revised often or revised and related, and source or tool."""
    revised = (F.col("revisions") >= 10) | ((F.col("revisions") >= 5) & (F.col("n_edges") >= 1))
    return rows.filter((F.col("tokens") >= 512) & revised & F.col("classification").isin("source", "tool"))


def pruned(edges: DataFrame, kept: DataFrame, low: str = "low_support") -> DataFrame:
    """Edges with both ends among the kept paths, without those of low support."""
    rows = edges.filter(F.col("class") != low)
    for end in ("a", "b"):
        rows = rows.join(kept.select(F.col("path").alias(end)), end, "left_semi")
    return rows.select(*edges.columns)


def merged_clusters(rows: DataFrame) -> DataFrame:
    """One row an id: each field from the first row that has it, rows that are no candidates first, then by kind."""
    rank = F.struct(F.col("kind").startswith("candidate"), F.col("kind"))
    fields = [c for c in rows.columns if c not in ("id", "kind")]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    return rows.groupBy("id").agg(F.min_by("kind", rank).alias("kind"), *[first(c) for c in fields])


def verification_near(files: DataFrame, limit: int = 5) -> DataFrame:
    """(path, check_path, position): verification paths that hold a file's name, the first by path."""
    from pyspark.sql import Window

    checks = files.filter(is_verification(F.col("path"))).select(F.col("path").alias("test"), F.lower("path").alias("low"))
    rows = files.select("path", F.lower(name_stem(F.col("path"))).alias("needle")).filter("needle <> ''")
    found = containing(rows.select("needle").distinct(), checks, limit)
    found = found.withColumn("position", F.row_number().over(Window.partitionBy("needle").orderBy("test"))).filter(F.col("position") <= limit)
    return rows.join(found.hint("merge"), "needle").select("path", F.col("test").alias("check_path"), "position")


def folder_trigger(tokens: Column, files: Column, cfg: Config) -> Column:
    """Which ceiling a folder crossed."""
    by_tokens, by_files = tokens > cfg.folder_tokens[1], files > cfg.folder_files[0]
    return F.when(by_tokens & by_files, "files and tokens").when(by_tokens, "tokens").when(by_files, "files")


def path_tokens(path: Column) -> Column:
    """Lower-cased parts of a path of more than one character."""
    return F.filter(F.split(F.lower(F.translate(path, "/._-", "    ")), " +"), lambda t: F.length(t) > 1)


def mismatches(base: dict, head: dict, fields: tuple[str, ...], harmless: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """(field, blocking) of the facts in which two runs differ."""
    return [(f, f not in harmless) for f in fields if base.get(f) != head.get(f)]


def lineage(renames: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, current, after): what a path was called before, for touches further back in the log than after.

    renames: seq (0 the newest), old, new. A chain of renames is followed from
    the present names backwards, each step strictly further back; every round
    is staged, and there are as many as the longest chain.
    """
    front = stage(paths.select(F.col("path").alias("name"), F.col("path").alias("current"), F.lit(-1).cast("long").alias("after")), "aliases")
    found = [front]
    while True:
        step = front.join(renames, F.col("new") == F.col("name")).filter(F.col("seq") > F.col("after")).select(F.col("old").alias("name"), "current", F.col("seq").alias("after")).distinct()
        front = stage(step, "aliases")
        if front.isEmpty():
            drop(front)
            break
        found.append(front)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def follow(touches: DataFrame, aliases: DataFrame) -> DataFrame:
    """Touches under their present paths: of the aliases that hold at a touch's place in the log, the furthest back."""
    rows = touches.withColumnRenamed("path", "name").join(aliases, "name").filter(F.col("seq") > F.col("after"))
    best = rows.groupBy("commit_id", "seq", "name").agg(F.max_by("current", F.struct("after", "current")).alias("path"))
    return touches.withColumnRenamed("path", "name").join(best, ["commit_id", "seq", "name"]).drop("name").select(*touches.columns)


def follow_renames(touches: DataFrame, paths: DataFrame) -> DataFrame:
    """touches (with old_path where status is R) under the present names of paths."""
    renames = touches.filter("status = 'R'").select("seq", F.col("old_path").alias("old"), F.col("path").alias("new"))
    return follow(touches, lineage(renames, paths.select("path")))
