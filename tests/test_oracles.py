"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from gneiss.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(found):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in found), key=str)


#: Constants of this query's SQL hold for tables with 100 suppliers.
LARGER = {"blast_radius"}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - LARGER))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want)


def test_entry_and_registration(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", ["history_metrics", "folder_rollup", "temporal_coupling"])
def test_partition_count_does_not_matter(spark, sf, name):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(map(tuple, QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
