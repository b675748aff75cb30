"""Tables written to the folder that driver and executors share.

Iterative plans cut their lineage here: a staged table outlives the executors
that wrote it, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is configured, a new temporary one in local mode, an error on a cluster."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="gneiss-"))
    return f"{context.getCheckpointDir()}/staged"


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table that was written."""
    spark = df.sparkSession
    path = path or staged_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame | None) -> None:
    """Deletes the files of a staged table that no later plan reads."""
    if table is None:
        return
    spark = table.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    home = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    jvm = spark._jvm
    for root in roots:
        if home not in root:
            raise ValueError(f"not a staged table: {root}")
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
