"""Pressure scores, reasons and ranked queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import clip, half_even, nearest_rank
from gneiss.functions.paths import DERIVED
from gneiss.operators.inventory import context_band, context_pressure
from gneiss.plans.ordering import global_rank

CONTEXT_REASONS = ("critical_token_cost", "high_token_cost")


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 50, "moderate").otherwise("low")


def scored(files: DataFrame, cfg: Config, reliable: bool = True) -> DataFrame:
    """files (path, tokens, age_days, revisions, relative_churn, ...) with norms, pressures, score, band and reasons.

    Two percentiles over all files are one broadcast row.
    """
    norms = files.agg(
        F.greatest(F.coalesce(nearest_rank("revisions", 0.95).cast("double"), F.lit(1.0)), F.lit(1.0)).alias("revisions_p95"),
        F.coalesce(nearest_rank("relative_churn", 0.95), F.lit(1.0)).alias("churn_p95"),
    )
    support = clip(F.col("revisions") / 5) if reliable else F.lit(0.0)
    rows = files.crossJoin(F.broadcast(norms)).withColumn("support", support)
    half = float(cfg.half_life_days)
    aged = F.lit(1.0) if half <= 0 else 1 - F.pow(F.lit(2.0), -F.greatest("age_days", F.lit(0)) / half)
    rows = rows.withColumns({
        "context": context_pressure(F.col("tokens"), cfg.bands),
        "age": aged * F.col("support"),
        "revision": clip(F.col("revisions") / F.col("revisions_p95")) * F.col("support"),
        "relative": clip(F.col("relative_churn") / F.when(F.col("churn_p95") > 0, F.col("churn_p95")).otherwise(1.0)) * F.col("support"),
    }).withColumn("churning", 0.6 * F.col("revision") + 0.4 * F.col("relative"))
    a, b, c = cfg.weights
    rows = rows.withColumn("score", half_even(100 * (a * F.col("context") + b * F.col("age") + c * F.col("churning")), 1))
    rows = rows.withColumns({"age_pressure": half_even(F.col("age")), "revision_norm": half_even(F.col("revision")), "churn_norm": half_even(F.col("relative")), "churn_pressure": half_even(F.col("churning")), "context_band": context_band(F.col("tokens"), cfg.bands)})
    rows = rows.withColumn("score_band", score_band(F.col("score"))).withColumn("reasons", reasons(cfg))
    return rows.drop("context", "age", "revision", "relative", "churning", "revisions_p95", "churn_p95")


def reasons(cfg: Config) -> Column:
    """Reason codes in their fixed order; those from history need full support."""
    full, old = F.col("support") >= 1, F.col("age_days") >= cfg.half_life_days
    coded = (
        (F.col("context_band") == "critical", "critical_token_cost"),
        (F.col("context_band") == "warning", "high_token_cost"),
        (full & old, "old_file"),
        (full & (F.col("revision_norm") >= 0.8), "high_revision_frequency"),
        (full & (F.col("churn_norm") >= 0.8), "high_relative_churn"),
        (full & old & (F.col("churn_pressure") >= 0.6), "old_and_volatile"),
    )
    return F.array_compact(F.array(*[F.when(hit, code) for hit, code in coded]))


def severity() -> Column:
    error = (F.col("context_band") == "critical") | (F.col("score_band") == "critical")
    return F.when(error, "error").when((F.col("context_band") == "warning") | (F.col("score_band") == "high"), "warning").otherwise("notice")


def action_queue(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Files that need attention, ranked by score, tokens and path; a limit makes it a bounded top list."""
    admitted = (F.size("reasons") > 0) | F.col("context_band").isin("warning", "critical") | F.col("score_band").isin("high", "critical")
    pure = (F.size("reasons") > 0) & F.forall("reasons", lambda r: r.isin(*CONTEXT_REASONS))
    order = [F.desc("score"), F.desc("tokens"), F.asc("path")]
    queue = rows.filter(admitted).withColumns({"severity": severity(), "pure_context": pure, "evidence": F.when(F.col("revisions") >= 5, "supported").otherwise("low_support")})
    if limit is None:
        return global_rank(queue, order)
    return queue.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def observations(queue: DataFrame) -> DataFrame:
    """The queue with intervention: source files with support or pure context, and a warning or an error."""
    act = (F.col("classification") == "source") & ((F.col("evidence") == "supported") | F.col("pure_context")) & F.col("severity").isin("warning", "error")
    return queue.withColumn("intervention", act)


def failing(rows: DataFrame, context: str = "critical", score: str = "critical") -> DataFrame:
    """Rows at or over either threshold; derived files never fail."""
    contexts, scores = {"healthy": 0, "watch": 1, "warning": 2, "critical": 3}, {"low": 0, "moderate": 1, "high": 2, "critical": 3}
    over = F.col("context_band").isin(*[b for b, i in contexts.items() if i >= contexts[context]]) | F.col("score_band").isin(*[b for b, i in scores.items() if i >= scores[score]])
    return rows.filter(~F.col("classification").isin(*DERIVED) & over)
