"""Walks over the numbered pages of a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: pages of a walk at most.
MOST_PAGES = 100
#: Why a walk ended at a page; a page that it goes on from has none.
NO_LOTS, NOT_A_LISTING, NO_MORE, NO_PAGE, ALREADY_READ, LIMIT = "no active lots", "no lots found", "no more lots", "no such page", "page already read", "page limit"


def walked(pages: DataFrame, limit: int = 0) -> DataFrame:
    """(listing, page, cards, new_lots, repeats, already_read, stop): the pages of each listing that a walk reads, and why it stops.

    pages has listing, page, signature, keys (the dedupe keys of its lots; null: the page has no cards and does not say
    that nothing was found) and, if there, clicks (whether the site's own next control leads on from it). A walk asks for
    page 1, 2 and so on, limit pages at most (0 or less: MOST_PAGES).

    - Page 1 without lots is an error, of the auction (NO_LOTS) or of the reader (NOT_A_LISTING: null keys or no such row);
      a later one is the end (NO_MORE, or NO_PAGE where it has null keys or no row).
    - A lot is new on the first page of the walk that has its key; a key that comes again, on the same page or later, is a repeat.
    - A page after the first whose signature an earlier page of the walk has is already_read: what is new on it counts,
      and the walk ends there unless a click leads on. Null signatures say nothing.

    Of repeated rows of a page the one of least signature and keys counts; rows with a null page do not.
    """
    most = min(limit, MOST_PAGES) if limit > 0 else MOST_PAGES
    clicks = F.coalesce("clicks", F.lit(False)) if "clicks" in pages.columns else F.lit(False)
    rows = pages.where(F.col("page").between(1, most)).select(F.col("listing"), F.col("page").cast("int").alias("page"), F.struct("signature", "keys", clicks.alias("clicks")).alias("p"))
    rows = rows.groupBy("listing", "page").agg(F.min("p").alias("p")).select("listing", "page", "p.*")
    listing, in_order = Window.partitionBy("listing"), Window.partitionBy("listing").orderBy("page")
    seen = F.col("signature").isNotNull() & (F.min("page").over(Window.partitionBy("listing", "signature")) < F.col("page"))
    reached = rows.withColumn("already_read", seen).withColumn("place", F.row_number().over(in_order)).where("place = page").drop("place")
    empty = F.coalesce(F.size("keys"), F.lit(-1)) <= 0
    stop = (
        F.when(empty & (F.col("page") == 1), F.when(F.col("keys").isNull(), NOT_A_LISTING).otherwise(NO_LOTS))
        .when(empty, F.when(F.col("keys").isNull(), NO_PAGE).otherwise(NO_MORE))
        .when(F.col("already_read") & ~F.col("clicks"), ALREADY_READ)
        .when(F.col("page") == most, LIMIT)
    )
    ended = reached.withColumn("stop", stop).withColumn("end", F.min(F.when(F.col("stop").isNotNull(), F.col("page"))).over(listing))
    kept = ended.where("end is null or page <= end").withColumn("last", F.max("page").over(listing))
    # each key's first page; a page's keys stay with it, so a listing's pages are never gathered
    lots = kept.where(F.size("keys") > 0).select("listing", "page", F.explode("keys").alias("key"))
    firsts = lots.groupBy("listing", "key").agg(F.min("page").alias("page")).groupBy("listing", "page").agg(F.count(F.lit(1)).alias("new_lots"))
    there = F.col("k.listing").eqNullSafe(F.col("f.listing")) & (F.col("k.page") == F.col("f.page"))
    counted = kept.alias("k").join(firsts.alias("f"), there, "left").select("k.*", F.coalesce("f.new_lots", F.lit(0)).cast("long").alias("new_lots"))
    cards = F.greatest(F.coalesce(F.size("keys"), F.lit(0)), F.lit(0)).cast("long")
    said = F.when((F.col("page") < F.col("last")) | F.col("stop").isNotNull(), F.col("stop"))
    read = counted.select("listing", "page", cards.alias("cards"), "new_lots", (cards - F.col("new_lots")).alias("repeats"), (F.col("already_read") & (cards > 0)).alias("already_read"), said.alias("stop"), "last", "end")
    none = F.lit(0).cast("long")
    asked = read.where("end is null and page = last").select("listing", (F.col("page") + 1).alias("page"), none.alias("cards"), none.alias("new_lots"), none.alias("repeats"), F.lit(False).alias("already_read"), F.lit(NO_PAGE).alias("stop"))
    lost = rows.groupBy("listing").agg(F.min("page").alias("first")).where("first > 1").select("listing", F.lit(1).alias("page"), none.alias("cards"), none.alias("new_lots"), none.alias("repeats"), F.lit(False).alias("already_read"), F.lit(NOT_A_LISTING).alias("stop"))
    return read.drop("last", "end").unionByName(asked).unionByName(lost)
