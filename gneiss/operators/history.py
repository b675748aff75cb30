"""Change history of paths and commits.

Input is one row a commit and path: commit_id, seq (place in the log, 0 the
newest), ts (epoch seconds, 0 unknown), author, bot, subject, parents, path,
status, added, deleted; and the tracked paths with lines and tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import clip, half_away, half_even, log_share, nearest_rank
from gneiss.functions.paths import root
from gneiss.staging import stage

DAY = 86_400


def age_days(ts: Column, now: int) -> Column:
    return F.when(ts == 0, 0.0).otherwise(F.greatest(F.lit(now) - ts, F.lit(0)) / float(DAY))


def commit_path_churn(touches: DataFrame, tracked: DataFrame) -> DataFrame:
    """Churn in lines and tokens of each commit and path; tokens are rounded entry by entry, then added."""
    density = F.greatest(F.col("tokens") / F.greatest("lines", F.lit(1)), F.lit(1.0))
    rows = touches.join(tracked.select("path", "lines", "tokens"), "path")
    churn = F.col("added") + F.col("deleted")
    return rows.groupBy("commit_id", "path").agg(
        F.max("ts").alias("ts"), F.max("author").alias("author"), F.max("bot").alias("bot"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum(churn).alias("churn"), F.sum(F.rint(churn * density).cast("long")).alias("token_churn")
    )


def author_stats(churn: DataFrame, since: int) -> DataFrame:
    """Authors, their entropy in bits and the top author's share, from counts by path and author."""
    counts = churn.filter(F.col("ts") >= since).groupBy("path", "author").count()
    totals = counts.groupBy("path").agg(F.sum("count").alias("n"))
    share = F.col("count") / F.col("n")
    return counts.join(totals, "path").groupBy("path").agg(
        F.count("*").alias("n_authors"), half_even(-F.sum(share * F.log2(share))).alias("author_entropy"), half_even(F.max(share)).alias("top_author_share")
    )


def history_metrics(touches: DataFrame, tracked: DataFrame, now: int, cfg: Config) -> DataFrame:
    """The window's metrics of every tracked path; paths without touches have zeros."""
    since = now - cfg.window_days * DAY
    churn = stage(commit_path_churn(touches.filter(F.col("ts") >= since), tracked), "churn")
    late = (F.col("ts") != 0) & (F.col("ts") >= now - cfg.late_days * DAY)
    metrics = churn.groupBy("path").agg(
        F.count("*").alias("revisions"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.sum("churn").alias("churn"),
        F.sum("token_churn").alias("token_churn"),
        half_even(F.sum(1 / (1 + age_days(F.col("ts"), now) / cfg.recency_days))).alias("recency"),
        half_even(F.coalesce(F.sum(F.when(late, F.col("token_churn"))), F.lit(0)) / F.greatest(F.sum("token_churn"), F.lit(1))).alias("late_spike"),
        F.count_distinct(F.when(F.col("ts") >= now - cfg.maintainer_days * DAY, F.col("author"))).alias("maintainers"),
        F.floor((F.lit(now) - F.max(F.when(~F.col("bot") & (F.col("ts") > 0), F.col("ts")))) / DAY).alias("days_since_human"),
    )
    joined = tracked.select("path", "lines", "tokens").join(metrics, "path", "left").join(author_stats(churn, since), "path", "left")
    zeros = {c: 0 for c in ("revisions", "added", "deleted", "churn", "token_churn", "recency", "late_spike", "maintainers", "n_authors", "author_entropy", "top_author_share")}
    return joined.fillna(zeros).withColumn("relative_churn", half_even(F.col("churn") / F.greatest("lines", F.lit(1))))


def first_seen(touches: DataFrame, now: int) -> DataFrame:
    """The oldest addition in the order of the log, else the oldest touch; and the age in whole days."""
    rows = touches.groupBy("path").agg(F.max_by(F.when(F.col("status") == "A", F.col("ts")), F.when(F.col("status") == "A", F.col("seq"))).alias("added_ts"), F.max_by("ts", "seq").alias("touched_ts"))
    seen = F.coalesce("added_ts", "touched_ts")
    return rows.select("path", seen.alias("first_seen"), F.floor(F.greatest(F.lit(now) - seen, F.lit(0)) / DAY).alias("age_days"))


def commits(touches: DataFrame) -> DataFrame:
    """Each commit's files, roots, additions, hunks, entropy of line churn, kind and calibrated weight."""
    churn = F.col("added") + F.col("deleted")
    mechanical = F.lower("path").rlike(r"\.lock$|-lock\.json$|generated|snapshot|vendor/")
    by_path = touches.groupBy("commit_id", "path").agg(*[F.max(c).alias(c) for c in ("ts", "subject", "parents", "status")], F.sum(churn).alias("churn"))
    some, everything = F.col("churn") > 0, F.sum("churn")
    entropy = F.when(everything > 0, F.log2(everything) - F.sum(F.when(some, F.col("churn") * F.log2("churn"))) / everything)
    rows = by_path.groupBy("commit_id").agg(
        F.max("ts").alias("ts"),
        F.max("subject").alias("subject"),
        F.max("parents").alias("parents"),
        F.count("*").alias("n_files"),
        F.count_distinct(root(F.col("path"))).alias("n_roots"),
        F.count_if(F.col("status") == "A").alias("n_added"),
        F.count_if(mechanical).alias("n_mechanical"),
        F.sum(F.ceil(F.greatest("churn", F.lit(1)) / 20)).alias("hunks"),
        half_away(F.greatest(F.coalesce(entropy, F.lit(0.0)), F.lit(0.0))).alias("entropy"),
    )
    subject, n, added = F.lower("subject"), F.col("n_files"), F.col("n_added")
    release = subject.rlike("release|^bump version|^chore: version")
    bulk = ((n >= 20) & (4 * added >= 3 * n)) | ((n >= 10) & (F.col("n_mechanical") >= 0.8 * n)) | subject.rlike("import|vendor|generated snapshot")
    kind = F.when(F.col("parents") > 1, "merge").when(release, "release").when(bulk, "import").when((n > 0) & (added >= n), "creation").otherwise("maintenance")
    base = 1 / F.sqrt(F.greatest(n - 1, F.lit(1)))
    weight = F.when(kind.isin("merge", "import"), 0.0).when(kind == "release", base * 0.1).otherwise(base)
    return rows.withColumn("kind", kind).withColumn("weight", half_even(weight)).withColumn("diffusion", diffusion())


def diffusion() -> Column:
    """How widely a commit spreads: files, hunks and roots on log scales, entropy on a linear one."""
    return (
        0.35 * log_share(F.greatest("n_files", F.lit(1)), 25)
        + 0.25 * log_share(F.col("hunks"), 50)
        + 0.20 * log_share(F.greatest("n_roots", F.lit(1)), 10)
        + 0.20 * clip(F.col("entropy") / 3)
    )


def commit_baselines(rows: DataFrame) -> DataFrame:
    """Nearest-rank percentiles over commits, one row."""
    return rows.agg(
        nearest_rank("n_files", 0.95).cast("double").alias("files_p95"),
        nearest_rank("n_files", 0.99).cast("double").alias("files_p99"),
        nearest_rank("n_roots", 0.95).cast("double").alias("roots_p95"),
        nearest_rank("hunks", 0.95).cast("double").alias("hunks_p95"),
        nearest_rank("entropy", 0.95).alias("entropy_p95"),
    )
