"""Queries of packers over long groups: all line items of a tenth of the suppliers are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import long_groups as L
from tallyforge.sources.bindings import table

WIDTH, BYTES, BUDGET = 6, 150, 20_000


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("lot", (F.col("l_suppkey") % 10).cast("long")).withColumn("n", F.col("l_quantity").cast("long"))


def _order() -> Column:
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "n")


def long_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 6 items and 150 units."""
    b = L.next_fit(_items(spark, sf_dir), "lot", _order(), "n", WIDTH, BYTES)
    return b.groupBy("lot", "batch").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("units"))


def long_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits a budget, item by item."""
    g = L.greedy_budget(_items(spark, sf_dir), "lot", _order(), "n", BUDGET)
    return g.groupBy("lot").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("over"), F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).alias("units"))


QUERIES = {"long_batches": long_batches, "long_budgets": long_budgets}

_ITEMS = "items AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS lot, CAST(l_quantity AS BIGINT) AS n, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem)"

ORACLE_SQL = {
    # from the item that begins a batch to the one that begins the next
    "long_batches": f"""
        WITH RECURSIVE {_ITEMS}, total AS (SELECT *, sum(n) OVER (PARTITION BY lot ORDER BY i) AS s FROM items),
        ends AS (SELECT a.lot, a.i, greatest(a.i + 1, a.i + count(*) FILTER (b.s - a.s + a.n <= {BYTES})) AS next, count(*) AS around FROM total a JOIN total b ON b.lot = a.lot AND b.i >= a.i AND b.i < a.i + {WIDTH} GROUP BY a.lot, a.i),
        walk AS (SELECT lot, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS first FROM items WHERE i = 1 UNION ALL SELECT w.lot, w.batch + 1, e.next FROM walk w JOIN ends e ON e.lot = w.lot AND e.i = w.first JOIN items x ON x.lot = w.lot AND x.i = e.next)
        SELECT w.lot, w.batch, count(*) AS items, CAST(sum(t.n) AS BIGINT) AS units FROM walk w JOIN ends e ON e.lot = w.lot AND e.i = w.first JOIN items t ON t.lot = w.lot AND t.i >= w.first AND t.i < e.next GROUP BY w.lot, w.batch""",
    "long_budgets": f"""
        WITH {_ITEMS}, l AS (SELECT lot, count(*) AS c, list_reduce(list_concat([[CAST(0 AS BIGINT), 0]], list([n, CAST(0 AS BIGINT)] ORDER BY i)), lambda a, x: CASE WHEN a[1] + x[1] <= {BUDGET} THEN [a[1] + x[1], a[2] + 1] ELSE a END) AS r FROM items GROUP BY lot)
        SELECT lot, r[2] AS taken, c - r[2] AS over, r[1] AS units FROM l""",
}
