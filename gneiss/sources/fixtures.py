"""The base relations projected from the test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.session import shuffle_partitions

FILES = """
select doc_id,
       source || '/' || lang || '/' || case when doc_id % 8 = 0 then 'test_' else 'doc_' end || cast(doc_id as {S}) ||
       case doc_id % 5 when 0 then '.md' when 1 then '.rs' when 2 then '.py' when 3 then '.json' else '.txt' end as path,
       source as root, cast({OCT}(text) as bigint) as bytes, cast(ceil({OCT}(text) / 4.0) as bigint) as tokens, text
from {documents}
"""
SUPPLIER_PATH = """'src/' || n.n_name || '/s' || cast(s.s_suppkey as {S}) ||
       case s.s_suppkey % 4 when 0 then '.rs' when 1 then '.py' when 2 then '.md' else '_test.go' end"""
#: Every path under version control, with the size of its present text.
TRACKED = (
    "select "
    + SUPPLIER_PATH
    + """ as path, 40 + s.s_suppkey % 200 as lines,
       (40 + s.s_suppkey % 200) * (5 + s.s_suppkey % 7) as tokens, (40 + s.s_suppkey % 200) * (5 + s.s_suppkey % 7) * 4 as bytes
from {supplier} s join {nation} n on n.n_nationkey = s.s_nationkey
"""
)
#: One row for each commit and path it touches; seq is the place in the log, 0 the newest.
TOUCHES = (
    """
select l.l_orderkey as commit_id, cast(1000000000 - l.l_orderkey as bigint) as seq,
       max({EPOCH}(o.o_orderdate)) as ts, max(o.o_custkey) as author, max(o.o_custkey) % 10 = 0 as bot,
       case max(o.o_orderpriority) when '1-URGENT' then 'Release 1.0' when '5-LOW' then 'Import files' else 'Fix things' end as subject,
       1 + cast(l.l_orderkey % 50 = 0 as int) as parents,
       """
    + SUPPLIER_PATH.replace("s.s_suppkey", "l.l_suppkey").replace("n.n_name", "max(n.n_name)")
    + """ as path, case when sum(l.l_linenumber) % 5 = 0 then 'A' else 'M' end as status,
       cast(sum(l.l_quantity) as bigint) as added, cast(sum(l.l_linenumber) as bigint) as deleted
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey
join {supplier} s on s.s_suppkey = l.l_suppkey join {nation} n on n.n_nationkey = s.s_nationkey
group by l.l_orderkey, l.l_suppkey
"""
)
#: 2001-08-02 00:00:00 UTC, the clock of every analysis of these tables.
NOW = 996_710_400
DUCK = {"S": "varchar", "OCT": "strlen", "EPOCH": "epoch_us"}
SPARK = {"S": "string", "OCT": "octet_length", "EPOCH": "unix_micros"}
#: Lines that one task sorts at a time, about.
TASK_ROWS = 250_000
TABLES = ("documents", "supplier", "nation", "lineitem", "orders")


def duck(sql: str) -> str:
    """A relation's SQL for DuckDB; times are whole seconds."""
    out = sql.format(**DUCK, **{t: t for t in TABLES})
    return out.replace("max(epoch_us(o.o_orderdate))", "max(epoch_us(o.o_orderdate)) // 1000000")


def spark_sql(sql: str) -> str:
    """A relation's SQL for Spark, its tables still to be named."""
    return sql.format(**SPARK, **{t: "{" + t + "}" for t in TABLES}).replace("max(unix_micros(o.o_orderdate))", "max(unix_micros(o.o_orderdate)) div 1000000")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(spark_sql(sql), **{t: table(spark, sf_dir, t) for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, kind in rows.dtypes:
        if kind == "timestamp_ntz":
            rows = rows.withColumn(column, rows[column].cast("timestamp"))
    return rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, FILES)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, TRACKED)


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All touches, spread by commit over as many partitions as keep each at about TASK_ROWS lines, so a task's sorts do not grow with the input.

    Orders grow too, so they are never broadcast: each task would hold all of them.
    """
    text = spark_sql(TOUCHES)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    used["lineitem"], used["orders"] = spread(used["lineitem"], "l_orderkey"), used["orders"].hint("merge")
    return spark.sql(text, **used)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in partitions of about TASK_ROWS, in a number that adaptive plans keep; few rows are left to those."""
    context = rows.sparkSession.sparkContext
    n = -(-rows.count() // TASK_ROWS)
    return rows if n <= context.defaultParallelism else rows.repartition(max(n, shuffle_partitions(rows.sparkSession)), key)
