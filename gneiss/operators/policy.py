"""Verdicts, conflicts, citations, retention and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

VERDICTS = ("approve", "abstain", "revise", "reject")


def aggregate_verdicts(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """The strictest verdict of each case; a case without verdicts abstains."""
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(VERDICTS) for x in (v, i)])
    worst = rows.groupBy(key).agg(F.max(F.try_element_at(ranks, F.col("verdict"))).alias("r"), F.count("verdict").alias("n"))
    return worst.select(key, "n", F.when(F.col("r").isNull(), "abstain").otherwise(F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("r") + 1)).alias("verdict"))


def conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of known rules of which one names the other as a conflict, once each."""
    named = rules.select("rule_id", F.explode("conflicts_with").alias("other"))
    known = named.join(rules.select(F.col("rule_id").alias("other")), "other", "left_semi").filter("rule_id <> other")
    return known.select(F.least("rule_id", "other").alias("a"), F.greatest("rule_id", "other").alias("b")).distinct()


def invalid_citations(citations: DataFrame, index: DataFrame) -> DataFrame:
    return citations.join(index, "citation", "left_anti")


def retention(runs: DataFrame, max_runs: int, max_bytes: int) -> DataFrame:
    """Newest first: runs are kept up to the first that breaks a limit; the newest always is."""
    newest = Window.orderBy(F.desc("created"), F.desc("run_id"))
    upto = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = runs.withColumns({"position": F.row_number().over(newest), "running": F.sum("bytes").over(upto)})
    breaks = (F.col("position") > 1) & ((F.col("position") > max_runs) | (F.col("running") > max_bytes))
    return rows.withColumn("kept", F.max(breaks.cast("int")).over(upto) == 0)


def balanced_sample(files: DataFrame, group: Column, limit: int) -> DataFrame:
    """Round-robin over groups: the first of each group, then the second, up to the operator's limit."""
    turn = F.row_number().over(Window.partitionBy("g").orderBy("path"))
    rows = files.select("path", group.alias("g")).withColumn("turn", turn).filter(F.col("turn") <= limit)
    return rows.orderBy("turn", "g").limit(limit).select("path", F.col("g").alias("root"), "turn")


def prioritized(lists: list[DataFrame], limit: int) -> DataFrame:
    """First occurrences over ranked lists (path, position), in the order of the lists, up to the operator's limit."""
    rows = None
    for i, one in enumerate(lists):
        one = one.select("path", F.struct(F.lit(i).alias("list_no"), F.col("position").alias("position")).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("path").agg(F.min("at").alias("at"))
    return first.orderBy("at", "path").limit(limit).select("path", "at.list_no", "at.position")


def readiness(files: DataFrame) -> DataFrame:
    """Counts behind each blocker, one row."""
    return files.agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("tokens").isNull()).alias("without_tokens"),
        F.count_if(F.col("tokens") == 0).alias("empty"),
        F.count_if(F.col("classification") == "other").alias("unclassified"),
        (F.count("path") - F.count_distinct("path")).alias("repeated_paths"),
    )
