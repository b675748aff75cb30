"""Runs as Parquet tables: publish, find, keep and prune; and exports of bounded results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from gneiss.functions.udfs import stable_id_of
from gneiss.operators.policy import retention
from gneiss.plans.ordering import top_counted


def sarif_level(score_band: str, context_band: str) -> str:
    """The level of a file by its two bands: error for critical, warning for what is over the first thresholds, else note."""
    if "critical" in (score_band, context_band):
        return "error"
    return "warning" if score_band in ("high", "moderate") or context_band == "warning" else "note"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_bounded(df: DataFrame, path: str, order: list[Column] | None = None, limit: int | None = None) -> tuple[int, int]:
    """Writes df, or its first rows in an order, and returns (rows there were, rows written), counted as they pass by."""
    every, kept = Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    rows = df.observe(every, one) if limit is None else top_counted(df, order, limit, every)
    rows.observe(kept, one).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return every.get.get("n", 0), kept.get.get("n", 0)


COLLECTIONS = "collection string, total long, returned long, limit long, truncated boolean"


def publish(tables: dict[str, DataFrame], root: str, run_id: str, limits: dict[str, tuple[list[Column], int]] | None = None) -> None:
    """Writes a run's tables beside the others, then renames the run into place; a broken run stays hidden.

    limits has the order and the number of rows to keep of tables that are
    bounded. The table collections tells how many rows each table has and had;
    both are counted while the rows are written, without a second pass.
    """
    spark = next(iter(tables.values())).sparkSession
    told = []
    for name, df in tables.items():
        order, limit = (limits or {}).get(name, (None, None))
        total, returned = write_bounded(df, f"{root}/.run-{run_id}/{name}", order, limit)
        told.append((name, total, returned, limit, returned < total))
    spark.createDataFrame(told, COLLECTIONS).coalesce(1).write.mode("overwrite").parquet(f"{root}/.run-{run_id}/collections")
    fs, hidden = _fs(spark, f"{root}/.run-{run_id}")
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run={run_id}")
    if fs.exists(final):
        fs.delete(final, True)
    if not fs.rename(hidden, final):
        raise OSError(f"could not publish {run_id}")


def list_runs(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """(run_id, created, bytes) of published runs, the last name first, whatever was touched since."""
    fs, where = _fs(spark, root)
    if not fs.exists(where):
        return []
    found = [(s.getPath(), s) for s in fs.listStatus(where) if s.getPath().getName().startswith("run=")]
    rows = [(p.getName()[4:], s.getModificationTime(), fs.getContentSummary(p).getLength()) for p, s in found]
    return sorted(rows, key=lambda r: r[0], reverse=True)


def load(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """A table of a run, of the newest one by default."""
    runs = list_runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"no runs in {root}")
    return spark.read.parquet(f"{root}/run={run_id or runs[0][0]}/{table}")


def prune(spark: SparkSession, root: str, max_runs: int, max_bytes: int) -> list[str]:
    """Deletes the runs that retention does not keep."""
    runs = list_runs(spark, root)
    if not runs:
        return []
    rows = spark.createDataFrame([(name, len(runs) - i, size) for i, (name, _, size) in enumerate(runs)], "run_id string, created long, bytes long")
    gone = [r["run_id"] for r in retention(rows, max_runs, max_bytes).filter(~F.col("kept")).collect()]
    for run in gone:
        fs, where = _fs(spark, f"{root}/run={run}")
        fs.delete(where, True)
    return gone


def sarif(queue: DataFrame, limit: int = 5000, tool: str = "gneiss") -> str:
    """A SARIF 2.1.0 document of a ranked queue, bounded by limit."""
    rows = queue.orderBy("position").limit(limit).select("path", "score", "score_band", "context_band", "reasons").collect()
    results = [
        {
            "ruleId": (r["reasons"] or ["pressure"])[0],
            "level": sarif_level(r["score_band"], r["context_band"]),
            "message": {"text": f"{r['path']} has a pressure score of {r['score']:.1f}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}}}],
            "partialFingerprints": {"path": stable_id_of("finding", [r["path"]])},
        }
        for r in rows
    ]
    rules = [{"id": i} for i in sorted({x["ruleId"] for x in results})]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=1)


def escape_property(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(":", "%3A").replace(",", "%2C")


def escape_message(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def annotations(findings: DataFrame, limit: int = 50) -> list[str]:
    """Workflow commands for the most severe findings; the last line tells how many are left out."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    total = findings.count()
    rows = findings.orderBy(rank, F.desc("score"), "path").limit(limit).collect()
    out = [f"::{r['severity']} file={escape_property(r['path'])},title={escape_property(r['title'])}::{escape_message(r['message'])}" for r in rows]
    if total > len(rows) and out:
        out[-1] += f" ({total - len(rows)} more not shown)"
    return out


def ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(rows: DataFrame, columns: list[str], limit: int = 25) -> str:
    """A table of the first rows of an ordered result."""
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).limit(limit).collect()])
