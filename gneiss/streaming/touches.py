"""Keeping additive history metrics up to date from a stream of touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.staging import staged_path


def windowed_activity(touches: DataFrame, late: str = "30 days", width: str = "1 day") -> DataFrame:
    """Touches, lines and distinct authors (approximate) of each path and day; rows later than late are dropped."""
    return touches.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.count("*").alias("n"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.approx_count_distinct("author").alias("authors"))


def maintain(stream: DataFrame, table: str, checkpoint: str | None = None):
    """Starts a query that appends each batch's partial sums, keyed by its number so that a replay replaces it."""
    spark: SparkSession = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("path").agg(F.count("*").alias("revisions"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint or staged_path(spark, "stream")).start()


def totals(spark: SparkSession, table: str) -> DataFrame:
    """The metrics so far: partial sums of all batches added up."""
    return spark.read.parquet(table).groupBy("path").agg(*[F.sum(c).alias(c) for c in ("revisions", "added", "deleted")])
