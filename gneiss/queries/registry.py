"""Where the queries of this folder register themselves with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.config import Bands, Config
from gneiss.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Thresholds that spread the small test documents over all bands.
CFG = Config(bands=Bands(256, 640, 800), structural_tokens=(100, 50_000))
NOW = fx.NOW

#: Common table expressions of the base relations, for DuckDB.
BASE = f"with files as ({fx.duck(fx.FILES)}), tracked as ({fx.duck(fx.TRACKED)}), touches as ({fx.duck(fx.TOUCHES)})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add
