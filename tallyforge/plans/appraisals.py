"""Queries of appraisals: outcomes applied to the board, counters, lots that wait for an estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import appraisals as A
from tallyforge.scratch import saved, scratch_path
from tallyforge.sources.bindings import ITEMS_SQL, LOTS_SQL, line_items, lots


def _ledger(spark: SparkSession, sf_dir: str) -> A.OutcomeLedger:
    """Orders' attempts in three batches, each of which comes twice: a start, what the line items give, a later failure, skip or stop of some."""
    i = saved(line_items(spark, sf_dir).groupBy("lot_id").agg(F.collect_list(F.struct("retail", F.col("resale").alias("resale"))).alias("items")), "items")
    lot = F.col("lot_id")

    def outcome(attempt: int, kind: str, where, items=None) -> DataFrame:
        none = F.lit(None)
        return i.where(where).select(lot, F.lit(attempt).alias("attempt"), F.lit(kind).alias("kind"), F.concat(F.lit("why "), lot % 3).alias("message"), (F.col("items") if items else none.cast("array<struct<retail:decimal(18,4),resale:decimal(18,4)>>")).alias("items"), F.when(F.lit(bool(items)), F.size("items")).alias("images"), F.lit(1 if items else None).cast("int").alias("passes"))

    ledger = A.OutcomeLedger(spark, scratch_path(spark, "outcomes"))
    batches = {
        "a": outcome(1, "started", lot % 11 != 0).unionByName(outcome(2, "valued", lot % 3 != 0, True)).unionByName(outcome(2, "failed", lot % 3 == 0)),
        "b": outcome(3, "stopped", lot % 7 == 0).unionByName(outcome(3, "skipped", lot % 7 == 1)),
        "c": outcome(4, "failed", lot % 5 == 0).unionByName(outcome(5, "valued", lot % 35 == 0, True)).unionByName(outcome(6, "started", lot % 13 == 0)),
    }
    for name in ("a", "b", "a", "c", "b", "c"):
        ledger.commit(name, batches[name])
    return ledger


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _ledger(spark, sf_dir).outcomes()
    return A.applied(lots(spark, sf_dir).select("lot_id", "pre_resale", "pre_retail"), outcomes.unionByName(outcomes.where("lot_id % 2 = 0")))


def applied_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after all outcomes, of which many come more than once."""
    return _applied(spark, sf_dir)


def appraisal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lots are where, and how many may be asked for an estimate."""
    rows = _applied(spark, sf_dir).withColumn("pre_pricing", F.col("lot_id") % 4 == 0)
    return rows.agg(*A.counts(), F.count_if(A.waits()).alias("waiting"))


QUERIES = {"applied_outcomes": applied_outcomes, "appraisal_counts": appraisal_counts}

_BOARD = f"""WITH i AS (SELECT lot_id, CAST(sum(retail) AS DOUBLE) AS retail, CAST(sum(resale) AS DOUBLE) AS resale, CAST(count(*) AS INTEGER) AS n FROM ({ITEMS_SQL}) GROUP BY lot_id),
    v AS (SELECT *, CASE WHEN lot_id % 35 = 0 THEN 5 WHEN lot_id % 3 <> 0 AND lot_id % 7 <> 0 THEN 2 END AS by_attempt,
          CASE WHEN lot_id % 13 = 0 THEN 'analyzing' WHEN lot_id % 35 = 0 THEN 'completed' WHEN lot_id % 5 = 0 THEN 'failed' WHEN lot_id % 7 = 0 THEN 'pending' WHEN lot_id % 7 = 1 THEN 'skipped' WHEN lot_id % 3 <> 0 THEN 'completed' ELSE 'failed' END AS state,
          lot_id % 3 <> 0 OR lot_id % 7 = 0 AS retired FROM i),
    board AS (SELECT l.lot_id, CASE WHEN retired THEN NULL ELSE pre_resale END AS pre_resale, CASE WHEN retired THEN NULL ELSE pre_retail END AS pre_retail, coalesce(state, 'pending') AS state,
          CASE WHEN state IN ('failed', 'skipped') THEN 'why ' || l.lot_id % 3 ELSE '' END AS detail, CASE WHEN by_attempt > 0 THEN retail ELSE 0 END AS retail, CASE WHEN by_attempt > 0 THEN resale ELSE 0 END AS resale,
          CASE WHEN by_attempt > 0 THEN n ELSE 0 END AS item_count, CASE WHEN by_attempt > 0 THEN n ELSE 0 END AS images, CASE WHEN by_attempt > 0 THEN 1 ELSE 0 END AS passes, by_attempt AS valued_by FROM ({LOTS_SQL}) l LEFT JOIN v ON v.lot_id = l.lot_id)"""

ORACLE_SQL = {
    "applied_outcomes": f"{_BOARD} SELECT * FROM board",
    "appraisal_counts": f"""{_BOARD} SELECT count(*) AS lots, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'analyzing') AS analyzing, count(*) FILTER (state = 'completed') AS valued, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped,
        count(*) FILTER (state IN ('completed', 'failed', 'skipped')) AS terminal, count(*) FILTER (state IN ('completed', 'failed', 'skipped') OR item_count > 0) AS answered, count(*) FILTER (item_count = 0 AND coalesce(pre_resale, 0) <= 0 AND lot_id % 4 <> 0) AS waiting FROM board""",
}
