"""The board: lots with their line items rolled up, ceilings, counters, search, order and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import money as M
from tallyforge.functions import text as T
from tallyforge.scratch import saved

TOTALS = ("total_retail", "total_resale", "item_count", "weakest", "strongest", "anchor_count", "anchor_retail")


def roll_up(items: DataFrame, policy: M.BidPolicy = M.BidPolicy()) -> DataFrame:
    """Per lot: sums, number of items, weakest and strongest confidence, anchors."""
    rank, anchor = M.confidence_rank(F.col("confidence")), M.is_anchor(F.col("retail").cast("double"), policy)
    return items.groupBy("lot_id").agg(
        F.sum("retail").cast("double").alias("total_retail"),
        F.sum("resale").cast("double").alias("total_resale"),
        F.count(F.lit(1)).alias("item_count"),
        M.level_of_rank(F.max(rank)).alias("weakest"),
        M.level_of_rank(F.min(rank)).alias("strongest"),
        F.count_if(anchor).alias("anchor_count"),
        F.coalesce(F.sum(F.when(anchor, F.col("retail"))), F.lit(0)).cast("double").alias("anchor_retail"),
    )


def board(lots: DataFrame, items: DataFrame, policy: M.BidPolicy = M.BidPolicy()) -> DataFrame:
    """Every lot with totals, displayed money, profit, return and ceiling.

    A lot without items has totals of 0 and is shown with its pre-price, if it has one; profit and return never are.
    Return is null only where the bid is 0. An empty lot's weakest confidence is Low and its strongest High.
    """
    b = lots.join(roll_up(items, policy), "lot_id", "left")
    b = b.fillna({"total_retail": 0.0, "total_resale": 0.0, "item_count": 0, "anchor_count": 0, "anchor_retail": 0.0, "weakest": "Low", "strongest": "High"})
    valued = F.col("item_count") > 0
    provisional = ~valued & (F.coalesce("pre_resale", F.lit(0.0)) > 0)
    profit = F.col("total_resale") - F.col("bid")
    level = F.when(valued, F.col("weakest")).when(provisional, M.confidence(F.col("pre_confidence")))
    resale = F.when(valued, F.col("total_resale")).when(provisional, F.col("pre_resale"))
    ceiling = F.when(valued | provisional, M.max_bid(resale, level, policy))
    return b.select(
        *lots.columns,
        *TOTALS,
        valued.alias("has_valuation"),
        provisional.alias("is_provisional"),
        F.when(provisional, F.col("pre_resale")).otherwise(F.col("total_resale")).alias("display_resale"),
        F.when(provisional, F.coalesce("pre_retail", F.lit(0.0))).otherwise(F.col("total_retail")).alias("display_retail"),
        profit.alias("profit"),
        M.ratio(profit, F.col("bid")).alias("roi"),
        M.ratio(F.col("total_resale"), F.col("total_retail")).alias("resale_share"),
        level.alias("bid_confidence"),
        ceiling.alias("max_bid"),
        (ceiling - F.col("bid")).alias("headroom"),
        F.coalesce((ceiling > 0) & (F.col("bid") > ceiling), F.lit(False)).alias("over_target"),
    )


def totals(b: DataFrame) -> DataFrame:
    """One row: sums over the board, by decimals."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,4)")).cast("double")
    return b.agg(
        F.count(F.lit(1)).alias("lots"),
        exact("bid").alias("bids"),
        exact("total_retail").alias("retail"),
        exact("total_resale").alias("resale"),
        exact("profit").alias("profit"),
        F.sum("item_count").alias("items"),
    )


def counters(b: DataFrame) -> DataFrame:
    """One row: how many lots are valued, provisional, unvalued, active, over their ceiling; whether all are sold."""
    return b.agg(
        F.count_if("has_valuation").alias("valued"),
        F.count_if("is_provisional").alias("pre_priced"),
        F.count_if(~F.col("has_valuation")).alias("unvalued"),
        F.count_if(~F.col("has_valuation") & ~F.col("is_provisional")).alias("waiting"),
        F.count_if("active").alias("active"),
        F.count_if("over_target").alias("over_target"),
        F.bool_and(~F.col("active")).alias("all_sold"),
    )


def matches(needle: str, number: Column, title: Column, description: Column) -> Column:
    """The search rule: the needle's letters and digits in the number's, else in those of title and description; an empty needle keeps all."""
    want = "".join(c for c in needle.lower() if c.isalnum())
    if not want:
        return F.lit(True)
    return F.contains(T.search_form(number), F.lit(want)) | F.contains(T.search_form(F.concat_ws(" ", title, description)), F.lit(want))


def sort_key(field: str) -> Column:
    """What a field sorts by: displayed money for resale, valuation alone for profit and return, natural order for text."""
    if field in ("lot_number", "title"):
        return T.natural_key(F.col(field))
    return F.col({"resale": "display_resale", "retail": "display_retail", "maxBid": "max_bid"}.get(field, field))


def order_of(field: str, descending: bool) -> list[Column]:
    """The board's order: the field, nulls last both ways, then scrape position upwards; scrape order has no direction."""
    if field == "seq":
        return [F.col("seq").asc()]
    key = sort_key(field)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("seq").asc()]


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place from 1 in a global order, without one task for all rows.

    Rows are dealt by ranges of the order, written so that both uses see one dealing, and numbered inside a range; the
    totals of the ranges before, one number a range, are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def scope(drawn: DataFrame, selected: DataFrame) -> DataFrame:
    """none, some or all: how many of the drawn rows (lot_id) are selected (lot_id)."""
    marked = drawn.select("lot_id").join(selected.select("lot_id").distinct().withColumn("on", F.lit(True)), "lot_id", "left")
    n, on = F.count(F.lit(1)), F.count("on")
    return marked.agg(F.when(on == 0, "none").when(on == n, "all").otherwise("some").alias("scope"), n.alias("drawn"), on.alias("selected"))


def prune(selected: DataFrame, lots: DataFrame) -> DataFrame:
    """The selection less what is not on the board."""
    return selected.join(lots.select("lot_id"), "lot_id", "left_semi")


def toggle_all(drawn: DataFrame, selected: DataFrame) -> DataFrame:
    """All drawn rows join the selection, or leave it if all were in."""
    union = selected.select("lot_id").union(drawn.select("lot_id")).distinct()
    missing = drawn.select("lot_id").join(selected, "lot_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    gone = drawn.select("lot_id").distinct().withColumn("drawn", F.lit(True))
    return union.join(gone, "lot_id", "left").join(F.broadcast(missing)).where((F.col("missing") > 0) | F.col("drawn").isNull()).select("lot_id")


def visible(columns: list[str], hidden: list[str] | None) -> list[str]:
    """The columns to show, in the table's order: names that are no columns hide nothing, and hiding all hides none."""
    gone = set(hidden or ()) & set(columns)
    return [c for c in columns if c not in gone or len(gone) == len(columns)]


def view(b: DataFrame, needle: str, field: str, descending: bool, hidden: list[str] | None = None) -> DataFrame:
    """The table as shown: lots that match the search, numbered in order, in their visible columns."""
    found = b.where(matches(needle, F.col("lot_number"), F.col("title"), F.lit(None).cast("string")))
    return numbered(found, order_of(field, descending)).select("place", *visible(b.columns, hidden))


def in_hand(b: DataFrame) -> DataFrame:
    """What lots at hand show: bid, displayed money, whether it is provisional, and the profit by displayed resale."""
    return b.select("lot_id", "bid", "display_retail", "display_resale", "is_provisional", (F.col("display_resale") - F.col("bid")).alias("display_profit"))


def job_progress(rows: DataFrame) -> DataFrame:
    """(job, progress) of rows (job, answered, share: of the step in hand, null for none): what is done of a job, 1 at most."""
    done = F.sum(F.when(F.col("answered"), F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))))
    return rows.groupBy("job").agg(F.least(F.lit(1.0), done / F.count(F.lit(1))).alias("progress"))
