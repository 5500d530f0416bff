"""Outcomes of appraisals: a ledger that takes each batch once, the newest outcome of every lot, and the board with outcomes applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An outcome of an attempt on a lot: started, valued, failed, skipped or stopped; items and images are those of a valuation.
OUTCOME = "lot_id long, attempt int, kind string, message string, items array<struct<retail:decimal(18,4),resale:decimal(18,4)>>, images int, passes int"
_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]


class OutcomeLedger:
    """Outcomes below one folder, by the batch that brought them. A batch that comes again changes nothing; one that broke off is written anew."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def commit(self, batch: str, outcomes: DataFrame) -> bool:
        """Enters the OUTCOMEs of a batch; False where it has been entered before."""
        if self._fs.exists(self._path(f"{self.folder}/batch={batch}/_SUCCESS")):
            return False
        outcomes.select(*_NAMES).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def outcomes(self) -> DataFrame:
        """All that has been entered whole."""
        folder = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        whole = [f"{self.folder}/{n}" for n in names if self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        return self.spark.read.schema(OUTCOME).parquet(*whole) if whole else self.spark.createDataFrame([], OUTCOME)


def waits() -> Column:
    """Whether a lot's text (item_count, pre_resale, pre_pricing) may be asked for an estimate: neither valued nor estimated, and not asked already."""
    return (F.coalesce("item_count", F.lit(0)) == 0) & (F.coalesce("pre_resale", F.lit(0.0)) <= 0) & ~F.coalesce("pre_pricing", F.lit(False))


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("decimal(28,4)"), lambda a, i: (a + F.coalesce(i[field], F.lit(0))).cast("decimal(28,4)")).cast("double")


def newest(outcomes: DataFrame) -> DataFrame:
    """(lot_id, state, detail, retail, resale, item_count, images, passes, valued_by) after all OUTCOMEs of each lot.

    The newest attempt decides the state; figures are those of the newest valuation after the newest stop, which a later
    start, failure or skip leaves as they are. An outcome that is repeated is one; of two of an attempt the later kind in
    the order started, stopped, skipped, failed, valued counts. Kinds combine before the shuffle, so attempts may be many.
    """
    rank = F.array_position(F.array(*map(F.lit, ("started", "stopped", "skipped", "failed", "valued"))), F.col("kind"))
    items = F.coalesce("items", F.array().cast("array<struct<retail:decimal(18,4),resale:decimal(18,4)>>"))
    row = F.struct("attempt", rank.alias("rank"), "kind", "message", _sum(items, "retail").alias("retail"), _sum(items, "resale").alias("resale"), F.size(items).alias("item_count"), "images", "passes")
    # rows are sorted to be combined, so their items, of any number, are summed up before
    rows = outcomes.where(rank > 0).select("lot_id", F.inline(F.array(F.struct(row.alias("row")))))
    per = rows.groupBy("lot_id").agg(
        F.max("row").alias("last"), F.max(F.when(F.col("row.kind") == "valued", F.col("row"))).alias("v"), F.max(F.when(F.col("row.kind") == "stopped", F.col("row.attempt"))).alias("stop")
    )
    state = F.create_map(*map(F.lit, ("started", "analyzing", "stopped", "pending", "skipped", "skipped", "failed", "failed", "valued", "completed")))
    kept = F.col("v").isNotNull() & (F.col("stop").isNull() | (F.col("stop") < F.col("v.attempt")))
    figure = lambda c, none: F.when(kept, F.coalesce(F.col(f"v.{c}"), F.lit(none))).otherwise(none).alias(c)
    detail = F.when(F.col("last.kind").isin("failed", "skipped"), F.coalesce("last.message", F.lit(""))).otherwise("")
    return per.select(
        "lot_id", F.try_element_at(state, F.col("last.kind")).alias("state"), detail.alias("detail"), figure("retail", 0.0), figure("resale", 0.0), figure("item_count", 0), figure("images", 0), figure("passes", 0),
        F.when(kept, F.col("v.attempt")).alias("valued_by"), (F.col("v").isNotNull() | F.col("stop").isNotNull()).alias("retired"),
    )


def applied(lots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """lots (lot_id, pre_resale, pre_retail, any more) with the figures of newest(): a lot without outcome is pending, and a valuation or a stop retires the estimate from text alone."""
    told = newest(outcomes).withColumnRenamed("lot_id", "o_lot")
    joined = lots.join(told, F.col("lot_id") == F.col("o_lot"), "left")
    estimate = {c: F.when(~F.coalesce("retired", F.lit(False)), F.col(c)) for c in ("pre_resale", "pre_retail")}
    own = [estimate.get(c, F.col(c)).alias(c) for c in lots.columns]
    empty = {"state": "pending", "detail": "", "retail": 0.0, "resale": 0.0, "item_count": 0, "images": 0, "passes": 0}
    return joined.select(*own, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()), "valued_by")


def counts() -> list[Column]:
    """Aggregates over applied() lots: how many are pending, analyzing, valued, failed, skipped; how many of them have ended, and how many a job has answered."""
    of = lambda name, *states: F.count_if(F.col("state").isin(*states)).alias(name)
    ended = ("completed", "failed", "skipped")
    each = [of("pending", "pending"), of("analyzing", "analyzing"), of("valued", "completed"), of("failed", "failed"), of("skipped", "skipped"), of("terminal", *ended)]
    return [F.count(F.lit(1)).alias("lots"), *each, F.count_if(F.col("state").isin(*ended) | (F.col("item_count") > 0)).alias("answered")]
