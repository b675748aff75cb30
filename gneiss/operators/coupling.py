"""Co-change coupling: pairs of paths that are committed together, their neighbours and their rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import clip, half_away, wilson_lower
from gneiss.functions.paths import root
from gneiss.staging import drop, stage


def observed(commits: DataFrame, cfg: Config) -> DataFrame:
    """Commits that coupling counts: no merges or imports, at most so many files."""
    return commits.filter(~F.col("kind").isin("merge", "import") & (F.col("n_files") <= cfg.max_commit_files))


def coordination(touches: DataFrame, commits: DataFrame, cfg: Config) -> DataFrame:
    """Per path: commits by kind, files, roots and hunks of them, and mean diffusion shrunk by support."""
    used = observed(commits, cfg).select("commit_id", "kind", "n_files", "n_roots", "diffusion", "weight")
    rows = touches.groupBy("commit_id", "path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn")).join(used, "commit_id")
    out = rows.groupBy("path").agg(
        F.count("*").alias("n_commits"),
        F.count_if(F.col("kind") == "creation").alias("n_creation"),
        F.count_if(F.col("kind").isin("maintenance", "release")).alias("n_maintenance"),
        F.sum("n_files").alias("files"),
        F.sum("n_roots").alias("roots"),
        F.sum(F.ceil(F.greatest("churn", F.lit(1)) / 20)).alias("hunks"),
        F.sum(F.col("diffusion") * F.greatest(F.least("weight", F.lit(1.0)), F.lit(0.0))).alias("d"),
    )
    n = F.col("n_commits")
    return out.withColumn("change_diffusion", half_away(F.col("d") / n * (n / (n + 5)))).drop("d")


def pairs(touches: DataFrame, commits: DataFrame, cfg: Config) -> DataFrame:
    """(a, b), a < b: support, weighted support, support by kind. A commit has a bounded number of files.

    Touches that come spread by commit are not shuffled again before their pairs are.
    """
    used = observed(commits, cfg).select("commit_id", "kind", "weight")
    rows = touches.select("commit_id", "path").distinct()
    both = rows.join(used, "commit_id").withColumnRenamed("path", "a").join(rows.withColumnRenamed("path", "b"), "commit_id").filter("a < b")
    return both.groupBy("a", "b").agg(
        F.count("*").alias("support"), half_away(F.sum("weight")).alias("weighted"), F.count_if(F.col("kind") == "creation").alias("creation"), F.count_if(F.col("kind") != "creation").alias("maintenance")
    )


def neighbours(edges: DataFrame, cfg: Config) -> DataFrame:
    """Directed (src, dst): the best max_pairs of each source by support, then path; not symmetric."""
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = edges.select("support", "weighted", F.inline(F.array(way("a", "b"), way("b", "a")))).select("src", "dst", "support", "weighted")
    best = Window.partitionBy("src").orderBy(F.desc("support"), "dst")
    return both.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= cfg.max_pairs)


def temporal_edges(kept: DataFrame, facts: DataFrame, n_commits: int, cfg: Config) -> DataFrame:
    """Coupling statistics of each pair that some source kept, from the first of its sources in path order.

    n_commits counts all commits of the window, skipped ones too.
    """
    low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    once = kept.groupBy(low, high).agg(F.min_by(F.struct("support", "weighted"), "src").alias("e")).select("a", "b", "e.support", "e.weighted")
    count = facts.select("path", "n_commits")
    rows = once.filter(F.col("support") >= cfg.min_support)
    rows = rows.join(count.select(F.col("path").alias("a"), F.col("n_commits").alias("ca")), "a").join(count.select(F.col("path").alias("b"), F.col("n_commits").alias("cb")), "b")
    s, n = F.col("support"), F.lit(float(n_commits))
    either = F.greatest(F.col("ca") + F.col("cb") - s, F.lit(1))
    shrink = n / (n + 20)
    rows = rows.withColumns({"either": either, "calibrated": clip(F.col("weighted") / either), "lift": s * n / (F.col("ca") * F.col("cb"))}).filter(F.col("lift") >= cfg.min_lift)
    rows = rows.withColumns({"evidence": F.col("calibrated") * shrink, "lower": F.least(wilson_lower(s.cast("double"), F.col("either").cast("double")), F.col("calibrated")) * shrink})
    strong = (s >= 5) & (F.col("lower") >= 0.10) & (F.col("evidence") >= 0.10)
    some = (s >= 2) & (F.col("lower") >= 0.01) & (F.col("evidence") >= 0.02)
    return rows.select(
        "a", "b", "support", half_away(s / F.col("either")).alias("jaccard"), half_away(F.col("calibrated")).alias("calibrated"), half_away(F.col("lift")).alias("lift"),
        half_away(s / F.col("ca")).alias("confidence_ab"), half_away(s / F.col("cb")).alias("confidence_ba"), half_away(F.col("evidence")).alias("evidence"), half_away(F.col("lower")).alias("lower"),
        F.when(strong, "supported").when(some, "limited").otherwise("low_support").alias("class"), (root(F.col("a")) != root(F.col("b"))).alias("crosses"),
    )


def spread(kept: DataFrame, facts: DataFrame, n_files: int) -> DataFrame:
    """Degree, centrality, share of neighbours in other roots and the pressure they add up to, per path."""
    degree = kept.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("degree"), F.count_if(root(F.col("src")) != root(F.col("dst"))).alias("outside"))
    rows = facts.join(degree, "path", "left").fillna({"degree": 0, "outside": 0})
    n = F.col("n_commits")
    centrality = F.col("degree") / F.lit(max(n_files - 1, 1))
    cross = F.coalesce(F.try_divide("outside", "degree"), F.lit(0.0)) * (n / (n + 5))
    rows = rows.withColumns({"centrality": centrality, "cross": cross})
    pressure = clip(0.5 * F.col("change_diffusion") + 0.3 * F.col("centrality") + 0.2 * F.col("cross"))
    blast = clip(0.45 * F.col("centrality") + 0.35 * F.col("cross") + 0.20 * F.col("change_diffusion"))
    return rows.select("path", "degree", half_away(F.col("centrality")).alias("centrality"), half_away(F.col("cross")).alias("cross"), half_away(pressure).alias("coordination"), half_away(blast).alias("blast_radius"))


def pagerank(kept: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Rank of every source after a fixed number of rounds; weight to paths that are no source is lost.

    Sources are numbered, and each has the numbers and weights of its targets in
    one row, at most max_pairs of them. A round joins these rows with what
    their sources were given and shuffles what they give; it is staged every five
    rounds, so no plan holds more than five joins.
    """
    kept = stage(kept, "kept")
    names = stage(kept.select(F.col("src").alias("path")).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = max(names.count(), 1)
    numbered = kept.join(names.withColumnRenamed("path", "src"), "src").select("node", "dst", "support").join(names.select(F.col("path").alias("dst"), F.col("node").alias("to")), "dst", "left")
    # A target that is no source counts in the total and is given nothing.
    rows = numbered.groupBy("node").agg(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("to", "support"))).alias("targets"), F.sum("support").alias("total"))
    links = stage(rows.select("node", F.transform("targets", lambda x: F.struct(x["to"].alias("to"), (x["support"] / F.col("total")).alias("w"))).alias("targets")), "links")
    rank, given, before = F.lit(1.0 / n), None, None
    for i in range(rounds):
        held = (links if given is None else links.join(given, "node", "left")).select(rank.alias("rank"), F.inline("targets"))
        given = held.groupBy(F.col("to").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        rank = F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))
        if i % 5 == 4:
            given = stage(given, "ranks")
            drop(before)
            before = given
    return (names if given is None else names.join(given, "node", "left")).select("path", half_away(rank).alias("rank"))
