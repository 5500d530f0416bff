"""Queries of the board: totals, ceilings, order, search, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import money as M
from tallyforge.functions import text as T
from tallyforge.operators import board as B
from tallyforge.sources.bindings import ITEMS_SQL, LOTS_SQL, line_items, lots


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.board(lots(spark, sf_dir), line_items(spark, sf_dir))


BOARD_SQL = f"""
    WITH lots AS ({LOTS_SQL}), items AS ({ITEMS_SQL}), rolled AS (
        SELECT lot_id, CAST(sum(retail) AS DOUBLE) AS total_retail, CAST(sum(resale) AS DOUBLE) AS total_resale, count(*) AS item_count,
               max(CASE confidence WHEN 'High' THEN 0 WHEN 'Med' THEN 1 ELSE 2 END) AS weak, min(CASE confidence WHEN 'High' THEN 0 WHEN 'Med' THEN 1 ELSE 2 END) AS strong,
               count(*) FILTER (WHERE retail > 0 AND retail >= 100) AS anchor_count, CAST(coalesce(sum(retail) FILTER (WHERE retail > 0 AND retail >= 100), 0) AS DOUBLE) AS anchor_retail
        FROM items GROUP BY lot_id
    ), joined AS (
        SELECT l.*, coalesce(total_retail, 0) AS total_retail, coalesce(total_resale, 0) AS total_resale, coalesce(item_count, 0) AS item_count,
               CASE coalesce(weak, 2) WHEN 0 THEN 'High' WHEN 1 THEN 'Med' ELSE 'Low' END AS weakest, CASE coalesce(strong, 0) WHEN 0 THEN 'High' WHEN 1 THEN 'Med' ELSE 'Low' END AS strongest,
               coalesce(anchor_count, 0) AS anchor_count, coalesce(anchor_retail, 0) AS anchor_retail
        FROM lots l LEFT JOIN rolled r USING (lot_id)
    ), flagged AS (
        SELECT *, item_count > 0 AS has_valuation, item_count = 0 AND coalesce(pre_resale, 0) > 0 AS is_provisional, total_resale - bid AS profit FROM joined
    ), levelled AS (
        SELECT *, CASE WHEN is_provisional THEN pre_resale ELSE total_resale END AS display_resale, CASE WHEN is_provisional THEN coalesce(pre_retail, 0) ELSE total_retail END AS display_retail,
               CASE WHEN bid > 0 THEN profit / bid END AS roi, CASE WHEN total_retail > 0 THEN total_resale / total_retail END AS resale_share,
               CASE WHEN has_valuation THEN weakest WHEN is_provisional THEN pre_confidence END AS bid_confidence
        FROM flagged
    ), board AS (
        SELECT *, max_bid - bid AS headroom, coalesce(max_bid > 0 AND bid > max_bid, false) AS over_target FROM (
            SELECT *, CASE WHEN has_valuation OR is_provisional THEN CASE WHEN display_resale > 0
                       THEN round(display_resale * CASE bid_confidence WHEN 'High' THEN 60 WHEN 'Low' THEN 35 ELSE 50 END / 100.0) ELSE 0 END END AS max_bid
            FROM levelled)
    )
"""


def rank_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by ceiling, unpriced last, then scrape order."""
    ranked = B.numbered(_board(spark, sf_dir).select("seq", "lot_number", "bid", "max_bid", "bid_confidence", "headroom", "over_target", "is_provisional"), [F.col("max_bid").desc_nulls_last(), F.col("seq").asc()])
    return ranked.orderBy("place")


def board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived column of every lot."""
    return _board(spark, sf_dir)


def board_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as shown for a search, by displayed resale, without some columns."""
    b = _board(spark, sf_dir).select("lot_id", "seq", "lot_number", "title", "bid", "display_resale", "max_bid")
    return B.view(b, "urgent", "resale", True, ["bid", "seq", "no column"])


def board_in_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.in_hand(_board(spark, sf_dir))


def lot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.roll_up(line_items(spark, sf_dir))


def board_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.totals(_board(spark, sf_dir))


def board_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counters(_board(spark, sf_dir))


def anchor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that carry their lot at a threshold of 1,000, with the item's own ceiling."""
    policy = M.BidPolicy(anchor=5000)
    i = line_items(spark, sf_dir)
    resale = F.col("resale").cast("double")
    return i.where(M.is_anchor(F.col("retail").cast("double"), policy)).select("lot_id", "item_seq", F.col("retail").cast("double").alias("retail"), M.max_bid(resale, F.col("confidence"), policy).alias("item_max_bid"))


def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = line_items(spark, sf_dir)
    retail, resale = F.col("retail").cast("double"), F.col("resale").cast("double")
    return i.select("lot_id", "item_seq", "quantity", M.unit_value(retail, F.col("quantity")).alias("unit_retail"), M.unit_value(resale, F.col("quantity")).alias("unit_resale"), M.ratio(resale, retail).alias("resale_share"))


def _sorted(field: str, descending: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = _board(spark, sf_dir)
        return B.numbered(b, B.order_of(field, descending)).select("lot_number", "place")

    return query


_NATURAL = "list_transform(regexp_extract_all(lower({0}), '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length(regexp_replace(r, '^0+(.)', '\\1')) AS VARCHAR), 3, '0') || regexp_replace(r, '^0+(.)', '\\1') ELSE r END)"
NATURAL_SQL = "array_to_string(" + _NATURAL + ", '')"


def _sorted_sql(key: str, direction: str) -> str:
    return BOARD_SQL + f"SELECT lot_number, row_number() OVER (ORDER BY {key} {direction} NULLS LAST, seq) AS place FROM board"


def _search(needle: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = lots(spark, sf_dir)
        return b.where(B.matches(needle, F.col("lot_number"), F.col("title"), F.lit(None).cast("string"))).select("lot_id", "lot_number", "title")

    return query


def _search_sql(needle: str) -> str:
    form = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"WITH lots AS ({LOTS_SQL}) SELECT lot_id, lot_number, title FROM lots WHERE contains({form.format('lot_number')}, '{needle}') OR contains({form.format('title')}, '{needle}')"


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lots of urgent orders and one that is not on the board are checked."""
    return lots(spark, sf_dir).where(F.col("title") == "Pallet 1-URGENT").select("lot_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("lot_id")))


_SELECTION_SQL = f"WITH lots AS ({LOTS_SQL}), chosen AS (SELECT lot_id FROM lots WHERE title = 'Pallet 1-URGENT' UNION ALL SELECT -1)"


def select_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scope(lots(spark, sf_dir), _selection(spark, sf_dir))


def prune_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.prune(_selection(spark, sf_dir), lots(spark, sf_dir))


def toggle_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.toggle_all(lots(spark, sf_dir).where("active"), _selection(spark, sf_dir))


def selected_unvalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eval scope: checked lots that have neither a valuation nor a pre-price."""
    b = _board(spark, sf_dir).where("NOT has_valuation AND NOT is_provisional")
    return b.join(_selection(spark, sf_dir), "lot_id", "left_semi").select("lot_id", "bid")


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and listing text of each lot as the board prints them."""
    b = _board(spark, sf_dir)
    return b.select(
        "lot_id",
        M.currency(F.col("total_resale")).alias("resale_text"),
        F.concat_ws("\n", F.concat(F.lit("Lot: "), F.col("lot_number")), F.concat(F.lit("Title: "), F.nullif("title", F.lit(""))), F.when(F.col("bid") > 0, F.concat(F.lit("Bid: "), M.currency(F.col("bid"))))).alias("listing"),
        T.truncated(F.concat_ws(" - ", "lot_number", "title"), 18).alias("short"),
    )


QUERIES = {
    "rank_lots": rank_lots,
    "board_rows": board_rows,
    "board_view": board_view,
    "board_in_hand": board_in_hand,
    "lot_rollup": lot_rollup,
    "board_totals": board_totals,
    "board_counters": board_counters,
    "anchor_items": anchor_items,
    "unit_prices": unit_prices,
    "sort_identifier_natural": _sorted("lot_number", False),
    "sort_profit_desc": _sorted("profit", True),
    "sort_roi_asc": _sorted("roi", False),
    "sort_roi_desc": _sorted("roi", True),
    "sort_resale_desc": _sorted("resale", True),
    "sort_retail_desc": _sorted("retail", True),
    "sort_max_bid_asc": _sorted("maxBid", False),
    "sort_scrape": _sorted("seq", True),
    "sort_identifier_desc": _sorted("lot_number", True),
    "sort_title_asc": _sorted("title", False),
    "sort_title_desc": _sorted("title", True),
    "sort_bid_asc": _sorted("bid", False),
    "sort_bid_desc": _sorted("bid", True),
    "sort_profit_asc": _sorted("profit", False),
    "sort_resale_asc": _sorted("resale", False),
    "sort_retail_asc": _sorted("retail", False),
    "sort_max_bid_desc": _sorted("maxBid", True),
    "search_lot_number": _search("lot1"),
    "search_copy": _search("urgent"),
    "select_scope": select_scope,
    "prune_selection": prune_selection,
    "toggle_selection": toggle_selection,
    "selected_unvalued": selected_unvalued,
    "money_texts": money_texts,
}

ORACLE_SQL = {
    "rank_lots": BOARD_SQL + "SELECT seq, lot_number, bid, max_bid, bid_confidence, headroom, over_target, is_provisional, row_number() OVER (ORDER BY max_bid DESC NULLS LAST, seq) AS place FROM board",
    "board_rows": BOARD_SQL + "SELECT * FROM board",
    "board_view": BOARD_SQL + "SELECT row_number() OVER (ORDER BY display_resale DESC NULLS LAST, seq) AS place, lot_id, lot_number, title, display_resale, max_bid FROM board WHERE title = 'Pallet 1-URGENT'",
    "board_in_hand": BOARD_SQL + "SELECT lot_id, bid, display_retail, display_resale, is_provisional, display_resale - bid AS display_profit FROM board",
    "lot_rollup": f"""WITH items AS ({ITEMS_SQL}) SELECT lot_id, CAST(sum(retail) AS DOUBLE) AS total_retail, CAST(sum(resale) AS DOUBLE) AS total_resale, count(*) AS item_count,
        CASE max(CASE confidence WHEN 'High' THEN 0 WHEN 'Med' THEN 1 ELSE 2 END) WHEN 0 THEN 'High' WHEN 1 THEN 'Med' ELSE 'Low' END AS weakest,
        CASE min(CASE confidence WHEN 'High' THEN 0 WHEN 'Med' THEN 1 ELSE 2 END) WHEN 0 THEN 'High' WHEN 1 THEN 'Med' ELSE 'Low' END AS strongest,
        count(*) FILTER (WHERE retail >= 100) AS anchor_count, CAST(coalesce(sum(retail) FILTER (WHERE retail >= 100), 0) AS DOUBLE) AS anchor_retail FROM items GROUP BY lot_id""",
    "board_totals": BOARD_SQL + """SELECT count(*) AS lots, CAST(sum(CAST(bid AS DECIMAL(28,4))) AS DOUBLE) AS bids, CAST(sum(CAST(total_retail AS DECIMAL(28,4))) AS DOUBLE) AS retail,
        CAST(sum(CAST(total_resale AS DECIMAL(28,4))) AS DOUBLE) AS resale, CAST(sum(CAST(profit AS DECIMAL(28,4))) AS DOUBLE) AS profit, CAST(sum(item_count) AS BIGINT) AS items FROM board""",
    "board_counters": BOARD_SQL + """SELECT count(*) FILTER (WHERE has_valuation) AS valued, count(*) FILTER (WHERE is_provisional) AS pre_priced, count(*) FILTER (WHERE NOT has_valuation) AS unvalued,
        count(*) FILTER (WHERE NOT has_valuation AND NOT is_provisional) AS waiting, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE over_target) AS over_target, bool_and(NOT active) AS all_sold FROM board""",
    "anchor_items": f"""WITH items AS ({ITEMS_SQL}) SELECT lot_id, item_seq, CAST(retail AS DOUBLE) AS retail,
        CASE WHEN resale > 0 THEN round(CAST(resale AS DOUBLE) * CASE confidence WHEN 'High' THEN 60 WHEN 'Low' THEN 35 ELSE 50 END / 100.0) ELSE 0 END AS item_max_bid FROM items WHERE retail >= 1000""",
    "unit_prices": f"""WITH items AS ({ITEMS_SQL}) SELECT lot_id, item_seq, quantity, CASE WHEN quantity > 1 AND retail > 0 THEN CAST(retail AS DOUBLE) / quantity END AS unit_retail,
        CASE WHEN quantity > 1 AND resale > 0 THEN CAST(resale AS DOUBLE) / quantity END AS unit_resale, CASE WHEN retail > 0 THEN CAST(resale AS DOUBLE) / CAST(retail AS DOUBLE) END AS resale_share FROM items""",
    "sort_identifier_natural": _sorted_sql(NATURAL_SQL.format("lot_number"), "ASC"),
    "sort_profit_desc": _sorted_sql("profit", "DESC"),
    "sort_roi_asc": _sorted_sql("roi", "ASC"),
    "sort_roi_desc": _sorted_sql("roi", "DESC"),
    "sort_resale_desc": _sorted_sql("display_resale", "DESC"),
    "sort_retail_desc": _sorted_sql("display_retail", "DESC"),
    "sort_max_bid_asc": _sorted_sql("max_bid", "ASC"),
    "sort_scrape": _sorted_sql("seq", "ASC"),
    "sort_identifier_desc": _sorted_sql(NATURAL_SQL.format("lot_number"), "DESC"),
    "sort_title_asc": _sorted_sql(NATURAL_SQL.format("title"), "ASC"),
    "sort_title_desc": _sorted_sql(NATURAL_SQL.format("title"), "DESC"),
    "sort_bid_asc": _sorted_sql("bid", "ASC"),
    "sort_bid_desc": _sorted_sql("bid", "DESC"),
    "sort_profit_asc": _sorted_sql("profit", "ASC"),
    "sort_resale_asc": _sorted_sql("display_resale", "ASC"),
    "sort_retail_asc": _sorted_sql("display_retail", "ASC"),
    "sort_max_bid_desc": _sorted_sql("max_bid", "DESC"),
    "search_lot_number": _search_sql("lot1"),
    "search_copy": _search_sql("urgent"),
    "select_scope": _SELECTION_SQL + """ SELECT CASE WHEN count(c.lot_id) = 0 THEN 'none' WHEN count(c.lot_id) = count(*) THEN 'all' ELSE 'some' END AS scope, count(*) AS drawn, count(c.lot_id) AS selected
        FROM lots l LEFT JOIN chosen c USING (lot_id)""",
    "prune_selection": _SELECTION_SQL + " SELECT lot_id FROM chosen WHERE lot_id IN (SELECT lot_id FROM lots)",
    "toggle_selection": _SELECTION_SQL + """, drawn AS (SELECT lot_id FROM lots WHERE active), missing AS (SELECT count(*) AS n FROM drawn WHERE lot_id NOT IN (SELECT lot_id FROM chosen))
        SELECT lot_id FROM (SELECT lot_id FROM chosen UNION SELECT lot_id FROM drawn), missing WHERE n > 0 OR lot_id NOT IN (SELECT lot_id FROM drawn)""",
    "selected_unvalued": BOARD_SQL + "SELECT lot_id, bid FROM board WHERE NOT has_valuation AND NOT is_provisional AND title = 'Pallet 1-URGENT'",
    "money_texts": BOARD_SQL + """SELECT lot_id, '$' || format('{:,.2f}', total_resale) AS resale_text,
        'Lot: ' || lot_number || chr(10) || 'Title: ' || title || CASE WHEN bid > 0 THEN chr(10) || 'Bid: $' || format('{:,.2f}', bid) ELSE '' END AS listing,
        CASE WHEN length(lot_number || ' - ' || title) <= 18 THEN lot_number || ' - ' || title ELSE regexp_replace(substr(lot_number || ' - ' || title, 1, 17), '^(.+) [^ ]*$', '\\1') || '…' END AS short FROM board""",
}
