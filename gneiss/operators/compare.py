"""Two snapshots of the same files: deltas, renames, regressions and movement in the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import half_away
from gneiss.plans.ordering import top_counted
from gneiss.staging import stage

BANDS = ("healthy", "watch", "warning", "critical")
SCORES = ("low", "moderate", "high", "critical")


def band_rank(band: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), band), F.lit(0))


def renames(base: DataFrame, head: DataFrame) -> DataFrame:
    """(old, new): files gone and files new with the same content, where that content is the only one on both sides."""
    gone = base.join(head.select("path"), "path", "left_anti").groupBy("content").agg(F.count("*").alias("n"), F.min("path").alias("old")).filter("n = 1")
    came = head.join(base.select("path"), "path", "left_anti").groupBy("content").agg(F.count("*").alias("m"), F.min("path").alias("new")).filter("m = 1")
    return gone.join(came, "content").select("old", "new")


def deltas(base: DataFrame, head: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """Full outer join on path, renames followed: status, changes of tokens, score and bands.

    Both sides: path, content, tokens, score, context_band, score_band.
    """
    renamed = renames(base, head) if renamed is None else renamed
    names = ("content", "tokens", "score", "context_band", "score_band")
    old = base.join(renamed.select(F.col("old").alias("path"), "new"), "path", "left")
    old = old.select(F.coalesce("new", "path").alias("path"), F.when(F.col("new").isNotNull(), F.col("path")).alias("renamed_from"), *[F.col(c).alias(f"base_{c}") for c in names])
    new = head.select("path", *[F.col(c).alias(f"head_{c}") for c in names])
    rows = old.join(new, "path", "full_outer")
    changed = ~F.col("base_content").eqNullSafe(F.col("head_content"))
    drift = (F.col("base_tokens") != F.col("head_tokens")) | (F.col("base_score") != F.col("head_score")) | (F.col("base_context_band") != F.col("head_context_band")) | (F.col("base_score_band") != F.col("head_score_band"))
    status = F.when(F.col("base_content").isNull(), "added").when(F.col("head_content").isNull(), "removed").when(changed | F.col("renamed_from").isNotNull(), "source_changed").when(drift, "evidence_drift").otherwise("unchanged")
    return rows.select(
        "path", "renamed_from", status.alias("status"), changed.alias("content_changed"), "base_tokens", "head_tokens",
        (F.coalesce("head_tokens", F.lit(0)) - F.coalesce("base_tokens", F.lit(0))).alias("tokens_delta"),
        half_away(F.coalesce("head_score", F.lit(0.0)) - F.coalesce("base_score", F.lit(0.0))).alias("score_delta"),
        (band_rank(F.col("head_context_band"), BANDS) - band_rank(F.col("base_context_band"), BANDS)).alias("context_delta"),
        (band_rank(F.col("head_score_band"), SCORES) - band_rank(F.col("base_score_band"), SCORES)).alias("score_band_delta"),
        "head_context_band", "head_score_band",
    )


def regressions(rows: DataFrame, cfg: Config) -> DataFrame:
    """Deltas that count as worse: a new file in a bad band, a worse band, or a material rise; drift alone does not."""
    bad = F.col("head_context_band").isin("warning", "critical") | F.col("head_score_band").isin("high", "critical")
    worse = (F.col("context_delta") > 0) | (F.col("score_band_delta") > 0)
    touched = (F.col("status") == "source_changed") & F.col("content_changed")
    reason = F.when((F.col("status") == "added") & bad, "new_finding").when(touched & worse, "worse_band").when(touched & (F.col("score_delta") >= cfg.regression_delta), "material_score_increase")
    severity = F.when((F.col("head_context_band") == "critical") | (F.col("head_score_band") == "critical"), "error").when((F.col("head_context_band") == "warning") | (F.col("head_score_band") == "high"), "warning").otherwise("notice")
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("path", "reason", severity.alias("severity"), "score_delta", "head_context_band", "head_score_band")


def delta_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("tokens_delta").alias("tokens_delta"), F.count_if(F.col("score_delta") > 0).alias("worsened"), F.count_if(F.col("score_delta") < 0).alias("improved"))


def overlay_deltas(base: DataFrame, head: DataFrame, overlays: list[str]) -> DataFrame:
    """(path, label, delta): changes of stacked measures that are not zero, a missing side counting as zero."""
    stack = lambda df: df.select("path", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("v")) for c in overlays])).alias("x")).select("path", "x.label", "x.v")
    b, h = stack(base).withColumnRenamed("v", "b"), stack(head).withColumnRenamed("v", "h")
    rows = b.join(h, ["path", "label"], "full_outer").withColumn("delta", half_away(F.coalesce("h", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))
    return rows.filter("delta <> 0").select("path", "label", "delta")


def queue_movement(base: DataFrame, head: DataFrame) -> DataFrame:
    """Positions of each path in two ranked queues and how it moved."""
    rows = base.select("path", F.col("position").alias("base_position")).join(head.select("path", F.col("position").alias("head_position")), "path", "full_outer")
    moved = F.col("head_position") - F.col("base_position")
    status = F.when(F.col("base_position").isNull(), "entered").when(F.col("head_position").isNull(), "left").when(moved < 0, "up").when(moved > 0, "down").otherwise("same")
    return rows.select("path", "base_position", "head_position", moved.alias("moved"), status.alias("movement"))


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page of an ordered result; the sort keeps no more than offset + limit rows a task."""
    top = rows.orderBy(*order).limit(offset + limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).filter(F.col("position") > offset)


def page_with_totals(rows: DataFrame, offset: int, limit: int, *order: Column) -> tuple[DataFrame, dict]:
    """A page as a staged table, and total, returned, limit, offset, truncated and has_more; one pass over rows.

    The rows are counted as the sort reads them, those of the page as they are
    written.
    """
    every, kept = Observation(), Observation()
    top = top_counted(rows, list(order), offset + limit, every)
    found = top.withColumn("position", F.row_number().over(Window.orderBy(*order))).filter(F.col("position") > offset)
    out = stage(found.observe(kept, F.count(F.lit(1)).alias("n")), "page")
    total, returned = every.get.get("n", 0), kept.get.get("n", 0)
    return out, {"total": total, "returned": returned, "limit": limit, "offset": offset, "truncated": returned < total, "has_more": offset + returned < total}
