"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

A source's weight is a function of training time t in [0, 1]; its integral is
the source's share of the budget. The demand for a source's words up to time t
is its target times the integrated schedule, so inverting that function at a
document's cumulative words gives the time at which the document is trained on.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.llm.arrow import numbered
from gneiss.plans.ordering import running_total
from gneiss.session import shuffle_partitions
from gneiss.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times a document is taken at most.
MOST = 3
#: Relative weight over time of each weight class as (time, height) knots: the first fades, the second holds, the third grows.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Sources up to which their table is broadcast.
FEW_SOURCES = 50_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches a share of its total."""
    areas = [(a + b) / 2 * (u - t) for (t, a), (u, b) in pairwise(knots)]
    total = sum(areas)
    out, low = None, 0.0
    for (t, a), (u, b), area in zip(knots, knots[1:], areas, strict=False):
        slope = (b - a) / (u - t)
        rest = F.greatest(share * total - low, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + rest * (2 * slope), F.lit(0.0)))
        here = F.least(F.lit(t) + F.when(root + a > 0, rest * 2 / (root + a)).otherwise(0.0), F.lit(u))
        low += area
        out = F.when(share * total < low, here) if out is None else out.when(share * total < low, here)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(sources: DataFrame, most: int = MOST) -> float:
    """The words a unit of weight stands for, once no source is above most times its size.

    sources has weight and source_size; two sums reach the driver each round.
    """
    level, capped = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) > F.col("source_size") * most
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            return level
        capped = row["n"]
        level = (row["all"] - row["full"]) / row["weight"]


def mixing_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shapes=SHAPES, keyed: bool = False) -> DataFrame:
    """How often and when every row of docs is taken.

    doc_id, source, size, source_size, target, taken (words, repeats counted),
    passes (whole copies), extra (words of a last, cut copy), before (words of
    its source ahead of it), class (of its weight), h (its place in the order),
    position (time of its first copy) and, if keyed, key (the text's hash). Sources are
    ranked by code point, null last. Every document is taken in the same number
    of passes; the rest of the target is filled in the order of the hash of
    doc_id, so reruns agree and a source's words meet its target to within one.
    Null and empty texts have size 0 and are taken with 0 words; repeated rows
    are documents of their own; an empty table gives an empty result. A source
    with any share of all rows is spread over range partitions.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), *[F.xxhash64(text).alias("key")] * keyed)
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("source").asc_nulls_last(), F.col("h"), F.col("size")]
    rows = stage(rows, "sizes")
    placed = stage(rows.repartitionByRange(parts, *order).withColumn("slot", F.spark_partition_id()), "by-source")
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = stage(sums.repartitionByRange(min(parts, 32), F.col("source").asc_nulls_last()).withColumn("slot", F.spark_partition_id()).withColumn("one", F.lit(1)), "sources")
    by_rank = [F.col("source").asc_nulls_last()]
    ranked = running_total(running_total(ranked, "slot", by_rank, "one", "rank"), "slot", by_rank, "source_size", "source_start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", "source_start", (F.col("rank") % len(weights)).alias("class"), weight.alias("weight")), "weights")
    level = targets(ranked, most)
    ranked = ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * most).cast("double")))
    ranked = ranked.withColumnRenamed("source", "of")
    if ranked.count() <= FEW_SOURCES:
        ranked = F.broadcast(ranked)
    rows = running_total(placed, "slot", order, "size", "all_before").join(ranked, F.col("source").eqNullSafe(F.col("of")))
    quota = F.round("target").cast("long")
    rows = rows.withColumn("before", F.col("all_before") - F.col("source_start")).withColumn("quota", quota)
    rows = rows.withColumn("passes", F.coalesce(F.expr("try_divide(quota - quota % nullif(source_size, 0), source_size)"), F.lit(0)).cast("long"))
    rows = rows.withColumn("extra", F.greatest(F.least(F.expr("quota - passes * source_size - before"), F.col("size")), F.lit(0)).cast("long"))
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    return rows.withColumn("position", position(F.col("before"), shapes)).select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "extra", "before", "class", "h", "position", *["key"] * keyed)


def position(words: Column, shapes=SHAPES) -> Column:
    """The time at which a source's demand reaches a number of words; needs target and class."""
    share = F.coalesce(F.try_divide(words.cast("double"), F.col("target")), F.lit(0.0))
    out = None
    for k, knots in enumerate(shapes):
        here = F.col("class") % len(shapes) == k
        out = F.when(here, time_of(share, knots)) if out is None else out.when(here, time_of(share, knots))
    return out


def in_training_order(plan: DataFrame, copies: bool = True, shapes=SHAPES) -> DataFrame:
    """The plan's documents, or each of their copies with its words, range-sorted by position."""
    parts = shuffle_partitions(plan.sparkSession)
    rows = plan
    if copies:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        rows = rows.withColumn("words", F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("extra")))
        rows = rows.withColumn("position", position(F.col("copy") * F.col("source_size") + F.col("before"), shapes))
    rows = stage(rows, "positions")
    return rows.repartitionByRange(parts, "position", "h").sortWithinPartitions("position", "h")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by position; columns stay as they are, whatever their names.

    Documents stay whole: of the last, cut copy a document is given when the
    mix takes at least half of it. Rows that agree in doc_id and text share
    their copies in any order.
    """
    parts = shuffle_partitions(docs.sparkSession)
    plan = mixing_plan(docs, doc_id, text, source, keyed=True)
    copies = F.col("passes") + F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    at = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: c * F.col("source_size") + F.col("before"))
    plan = plan.withColumn("copies", copies.cast("int")).filter("copies > 0").withColumn("words", at)
    none = F.lit(-(1 << 63) + 1)
    same = Window.partitionBy("__id", "__key").orderBy("__key")
    plan = plan.select(F.coalesce("doc_id", none).alias("__id"), F.col("key").alias("__key"), "words", "target", "class", F.col("h").alias("__h"))
    plan = plan.withColumn("__n", F.row_number().over(same)).select("__id", "__key", "__n", "__h", F.explode("words").alias("w"), "target", "class")
    plan = plan.select("__id", "__key", "__n", "__h", position(F.col("w")).alias("__position"))
    rows = numbered(docs)
    own, body = (rows.columns[docs.columns.index(c)] for c in (doc_id, text))
    names = rows.columns
    rows = rows.withColumns({"__id": F.coalesce(own, none), "__key": F.xxhash64(body)})
    rows = rows.withColumn("__n", F.row_number().over(same)).join(plan, ["__id", "__key", "__n"])
    return rows.repartitionByRange(parts, "__position", "__h").sortWithinPartitions("__position", "__h").select(*names).toDF(*docs.columns)
