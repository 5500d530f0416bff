"""Queries of states that are projected from the events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.scratch import scratch_path
from tallyforge.streaming import scan_events, states


def stream_row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as lots' rows: where their events leave them."""
    events = states.in_words(scan_events.events(spark, sf_dir), "user_id")
    return states.latest(states.projected(events, states.RowStates, "user_id"), "user_id", scratch_path(spark, "row-states"))


def stream_board_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as walks: the board that their events leave."""
    events = states.as_walk(scan_events.events(spark, sf_dir), "user_id")
    return states.latest(states.projected(events, states.BoardStates, "user_id"), "user_id", scratch_path(spark, "board-states"))


QUERIES = {"stream_row_states": stream_row_states, "stream_board_states": stream_board_states}

ORACLE_SQL = {
    # what each column was last told by
    "stream_row_states": """
        WITH e AS (SELECT user_id, event_id AS seq, ts, coalesce(value, 0) AS v, 'why ' || event_id % 5 AS m,
                   CASE WHEN event_id % 13 = 0 THEN 'stopped' WHEN event_type = 'view' THEN 'analyzing' WHEN event_type = 'purchase' THEN 'valued' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'skipped' END
                        WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'estimating' ELSE 'estimated' END ELSE 'not estimated' END AS kind FROM events),
        a AS (SELECT user_id, arg_max({'k': kind, 'm': m}, (ts, seq)) FILTER (kind IN ('stopped', 'analyzing', 'valued', 'failed', 'skipped')) AS s, arg_max({'k': kind, 'v': v}, (ts, seq)) FILTER (kind IN ('valued', 'stopped')) AS f,
              arg_max({'k': kind, 'v': v}, (ts, seq)) FILTER (kind IN ('estimated', 'valued', 'stopped')) AS p, arg_max(kind, (ts, seq)) FILTER (kind IN ('estimating', 'estimated', 'not estimated', 'valued', 'stopped')) AS g FROM e GROUP BY user_id)
        SELECT user_id, CASE s.k WHEN 'valued' THEN 'completed' WHEN 'stopped' THEN 'pending' ELSE coalesce(s.k, 'pending') END AS state, CASE WHEN s.k IN ('failed', 'skipped') THEN s.m ELSE '' END AS detail,
               CASE WHEN f.k = 'valued' THEN f.v ELSE 0 END AS retail, CASE WHEN f.k = 'valued' THEN f.v / 2 ELSE 0 END AS resale, CASE WHEN p.k = 'estimated' THEN p.v ELSE 0 END AS pre_retail, CASE WHEN p.k = 'estimated' THEN p.v / 2 ELSE 0 END AS pre_resale, coalesce(g = 'estimating', false) AS pre_pricing FROM a""",
    "stream_board_states": """
        WITH e AS (SELECT user_id, event_id AS seq, ts, event_id % 9 + 1 AS page, event_id % 4 + 1 AS nth, event_id % 6 + 1 AS n, event_id % 37 AS lot, 'said ' || event_id % 3 AS m,
                   CASE WHEN event_id % 29 = 0 THEN 'walk ended' WHEN event_type = 'signup' THEN 'page started' WHEN event_type = 'purchase' THEN 'page read' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'status' ELSE 'pages known' END ELSE 'lot' END AS kind FROM events),
        f AS (SELECT *, kind = 'lot' AND row_number() OVER (PARTITION BY user_id, kind, lot ORDER BY ts, seq) = 1 AS fresh, last_value(CASE WHEN kind = 'pages known' THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq) AS listing FROM e),
        g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, seq) AS lots FROM f),
        t AS (SELECT *, CASE WHEN kind = 'status' THEN m WHEN kind = 'page started' THEN 'Scanning page ' || page || ' of ' || least(n, coalesce(listing, n)) WHEN fresh THEN 'Page ' || page || ' — ' || CASE WHEN n > 1 THEN 'card ' || nth || ' of ' || n || ' on it, ' ELSE '' END || lots || ' lot(s) on the board'
                   WHEN kind = 'page read' THEN 'Page ' || page || ' — ' || lots || ' lot(s) on the board' WHEN kind = 'walk ended' THEN 'Scraping done — ' || m END AS said FROM g)
        SELECT user_id, coalesce(arg_max(said, (ts, seq)) FILTER (said IS NOT NULL), '') AS status, CAST(coalesce(arg_max(n, (ts, seq)) FILTER (kind = 'page started'), 0) AS INTEGER) AS page_limit,
               CAST(coalesce(arg_max(CASE kind WHEN 'lot' THEN nth ELSE 0 END, (ts, seq)) FILTER (kind IN ('lot', 'page started', 'page read')), 0) AS INTEGER) AS rows_landed, CAST(coalesce(arg_max(CASE kind WHEN 'lot' THEN n ELSE 0 END, (ts, seq)) FILTER (kind IN ('lot', 'page started', 'page read')), 0) AS INTEGER) AS rows_on_page,
               CAST(coalesce(max(page) FILTER (kind = 'page read'), 0) AS INTEGER) AS pages_extracted, CAST(arg_max(n, (ts, seq)) FILTER (kind = 'pages known') AS INTEGER) AS listing_pages, CAST(max(lots) AS BIGINT) AS lots FROM t GROUP BY user_id""",
}
