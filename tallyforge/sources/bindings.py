"""The driver's tables as auction tables: lots, line items, photographs, readings, scan events, listing pages.

Sums of money are taken over decimals and given back as doubles, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lot_id, seq, lot_number, title, bid, active, pre_resale and pre_retail (null: not priced), pre_confidence."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("lot_id"),
        F.col("o_orderkey").cast("long").alias("seq"),
        F.concat(F.lit("Lot "), F.col("o_orderkey").cast("string")).alias("lot_number"),
        F.concat(F.lit("Pallet "), F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice") * 0.3).alias("bid"),
        (F.col("o_orderstatus") != "F").alias("active"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") * 0.5).alias("pre_resale"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") * 0.8).alias("pre_retail"),
        F.when(F.col("o_orderstatus") == "O", "Med").otherwise("Low").alias("pre_confidence"),
    )


LOTS_SQL = """
    SELECT CAST(o_orderkey AS BIGINT) AS lot_id, CAST(o_orderkey AS BIGINT) AS seq, 'Lot ' || o_orderkey AS lot_number, 'Pallet ' || o_orderpriority AS title,
           CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice * 0.3::DOUBLE END AS bid, o_orderstatus <> 'F' AS active,
           CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 0.5::DOUBLE END AS pre_resale,
           CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 0.8::DOUBLE END AS pre_retail,
           CASE WHEN o_orderstatus = 'O' THEN 'Med' ELSE 'Low' END AS pre_confidence
    FROM orders
"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lot_id, item_seq, part_id, quantity, confidence, retail and resale as decimals."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").cast("long").alias("lot_id"),
        F.col("l_linenumber").cast("int").alias("item_seq"),
        F.col("l_partkey").cast("long").alias("part_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.col("l_returnflag") == "A", "High").when(F.col("l_returnflag") == "R", "Low").otherwise("Med").alias("confidence"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("retail"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)").alias("resale"),
    )


ITEMS_SQL = """
    SELECT CAST(l_orderkey AS BIGINT) AS lot_id, CAST(l_linenumber AS INTEGER) AS item_seq, CAST(l_partkey AS BIGINT) AS part_id, CAST(l_quantity AS INTEGER) AS quantity,
           CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'R' THEN 'Low' ELSE 'Med' END AS confidence,
           CAST(l_extendedprice AS DECIMAL(18,4)) AS retail, CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4)) AS resale
    FROM lineitem
"""


def money_sum(column: str, alias: str):
    return F.sum(column).cast("double").alias(alias)
