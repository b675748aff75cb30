"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a key from which it counts as hot at least, and the most keys that can be hot at any size.
HOT, MOST = 1024, 10_000


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int, largest: int) -> DataFrame:
    """rows with the one row that lookup has for their keys; rows without one are left out.

    n names lookup's column with the number of rows of each key; total is their
    sum and largest their maximum. Keys with over a ten-thousandth of all rows,
    so at most MOST of them, are broadcast and their rows stay where they are;
    the others are shuffled, and none of them holds more than that share.
    """
    over = max(HOT, total // MOST)
    if largest <= over:
        return rows.join(lookup.hint("merge"), keys)
    hot = F.broadcast(lookup.filter(F.col(n) > over))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(lookup.filter(F.col(n) <= over).hint("merge"), keys)
    return rows.join(hot, keys).unionByName(cold)
