"""Joins of many rows to one row a key, where a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined to the row of table with their key; weight is how many of rows have it.

    Keys with more than a fourth of an even partition's rows are met by a broadcast, which has at most four rows for each
    shuffle partition whatever the data; all others are shuffled, so no task is dealt a frequent key. Rows with a null
    key or with one that is not in table are left out. Both tables are read twice: write them first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = (table.agg(F.sum(weight)).first()[0] or 0) // (4 * n)
    frequent = F.broadcast(table.where(F.col(weight) > limit).drop(weight))
    others = table.where(F.col(weight) <= limit).drop(weight)
    rare = rows.join(frequent.select(key), key, "left_anti").join(others.hint("merge"), key)
    return rows.join(frequent, key).unionByName(rare)
