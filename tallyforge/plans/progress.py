"""Queries of scans' notes, repeated views, batches, text passes, price states and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import notes as N
from tallyforge.operators import progress as R
from tallyforge.operators import scans as C
from tallyforge.plans.scans import _FRAMES, _frames, _pick, _picked
from tallyforge.sources.bindings import ITEMS_SQL, LOTS_SQL, line_items, lots, table


def note_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the numbers of scans, in words."""
    seq, n, part = F.col("item_seq"), F.col("quantity"), F.col("part_id")
    listed = lambda size, mark: F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), size), lambda k: F.concat(F.lit(mark), k.cast("string")))
    size = lambda k: (part % k).cast("int")
    return line_items(spark, sf_dir).select(
        "lot_id", "item_seq", "part_id",
        N.conflict_note(F.concat_ws(" and ", n.cast("string"), seq.cast("string")), F.greatest(n, seq), F.lit("the sighting that read the barcode")).alias("conflict"),
        N.manifest_phrase(seq, n, seq + 1, size(3), size(2)).alias("manifest"), N.manifest_brief(seq, n).alias("manifest_brief"),
        N.reading_phrase(seq, n, size(3), size(2)).alias("reading"), N.reading_brief(seq, n, size(3)).alias("reading_brief"),
        N.evidence_phrase(seq, listed(size(2), "b"), listed(size(3), "i"), listed(size(4), "w")).alias("evidence"),
    )


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = _frames(spark, sf_dir)
    return C.grouped_frames(frames, limit=5), frames


def view_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of frames that were read for others."""
    return R.view_claims(*_groups(spark, sf_dir)).select("lot", "owner", "phrase", F.array_join("notes", "\n").alias("notes"))


def grouped_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, frames = _groups(spark, sf_dir)
    return R.grouped_views(groups, R.view_claims(groups, frames))


def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are sent, three positions a batch, and the frames that each batch answers for."""
    groups, _ = _groups(spark, sf_dir)
    placed = groups.where("owner = position").select("lot", F.floor((F.col("position") - 1) / 3).cast("int").alias("batch"), "position")
    a = R.batch_answers(placed, groups)
    return a.select("lot", "batch", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "answered")


def text_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of an order's first photographs have their text read."""
    first = line_items(spark, sf_dir).groupBy("lot_id", "item_seq").agg(F.min("part_id").alias("p"))
    return R.text_pass(first.select(F.col("lot_id").alias("lot"), F.col("item_seq").alias("position"), (F.col("p") % 3).cast("int").alias("found")), images=6)


_KINDS = ("apply", "start", "clear", "stop", "reset", "other", "apply")


def price_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of pricing: each user's estimate after all of them."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("lot"), n.alias("seq"), _pick(n, *_KINDS).alias("kind"), (n % 100).cast("double").alias("retail"), (n % 50).cast("double").alias("resale"), _pick(n, "High", "Med", "Low").alias("confidence")
    )
    return R.priced_state(e)


def board_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs may start on boards of thirty orders."""
    board = F.floor(F.col("lot_id") / 30)
    rows = lots(spark, sf_dir).select(board.alias("board"), (F.col("lot_id") % 7 > 0).alias("valued"), F.col("active").alias("estimated"), (F.col("lot_id") % 11 == 0).alias("checked"))
    b = F.col("board")
    return R.gates(rows, rows.select("board").distinct().select("board", (b % 5 > 0).alias("configured"), (b % 7 == 0).alias("exclusive"), (b % 3 == 0).alias("scanning")))


QUERIES = {q.__name__: q for q in (note_phrases, view_claims, grouped_views, batch_answers, text_passes, price_states, board_gates)}

_CLAIMS = (
    _FRAMES.format(limit=5)
    + """, f AS (SELECT lot, owner, reason, min(position) AS first, string_agg(CAST(position AS VARCHAR), ', ' ORDER BY position) AS frames FROM said WHERE reason IS NOT NULL GROUP BY ALL),
        c AS (SELECT *, CASE reason WHEN 'same picture' THEN 'are the same picture as photograph ' || owner ELSE 'carry the same decoded barcode as photograph ' || owner || ' (a, b)' END AS claim FROM f),
        v AS (SELECT lot, owner, string_agg('photograph(s) ' || frames || ' ' || claim, '; ' ORDER BY first) AS phrase,
            string_agg('Photograph(s) ' || frames || ' — ' || claim || CASE reason WHEN 'same picture' THEN ', to the pixel — were not read on their own: photograph ' || owner || '''s reading already covers everything in them, and they are attached below for completeness.'
            ELSE ', so the same goods — were not read on their own: photograph ' || owner || '''s reading covers that product. They are attached below; check them for units of it that the reading''s count missed rather than counting the same stack twice.' END, chr(10) ORDER BY first) AS notes
            FROM c GROUP BY lot, owner)"""
)

ORACLE_SQL = {
    "note_phrases": f"""WITH i AS (SELECT *, part_id % 2 AS b, part_id % 3 AS c, part_id % 4 AS d FROM ({ITEMS_SQL})),
        e AS (SELECT *, concat_ws(' · ', CASE WHEN b = 1 THEN 'barcode(s) b1' END, CASE c WHEN 1 THEN 'identifier(s) i1' WHEN 2 THEN 'identifier(s) i1, i2' END,
            CASE d WHEN 1 THEN 'label wording w1' WHEN 2 THEN 'label wording w1 · w2' WHEN 3 THEN 'label wording w1 · w2 (+1 more)' END) AS legible FROM i)
        SELECT lot_id, item_seq, part_id, 'counts ' || quantity || ' and ' || item_seq || ' disagreed; kept ' || greatest(quantity, item_seq) || ' — the sighting that read the barcode' AS conflict,
        item_seq || ' distinct item(s) — ' || quantity || ' unit(s) — read from ' || (item_seq + 1) || ' photograph(s)' || CASE WHEN c > 0 THEN ' — ' || c || ' of the rest declared empty' ELSE '' END || CASE WHEN b > 0 THEN ' — ' || b || ' count(s) in dispute' ELSE '' END AS manifest,
        item_seq || ' item(s) · ' || quantity || ' unit(s)' AS manifest_brief,
        item_seq || ' photograph(s) read one by one — ' || quantity || ' product group(s)' || CASE WHEN c > 0 THEN ' — ' || c || ' identifier(s)' ELSE '' END || CASE WHEN b > 0 THEN ' — ' || b || ' unpriced' ELSE '' END AS reading,
        item_seq || ' photo(s) · ' || quantity || ' group(s)' || CASE WHEN c > 0 THEN ' · ' || c || ' id(s)' ELSE '' END AS reading_brief,
        CASE WHEN legible = '' THEN 'nothing legible on ' || item_seq || ' photograph(s) — priced from what is visible' ELSE legible END AS evidence FROM e""",
    "view_claims": _CLAIMS + " SELECT * FROM v",
    "grouped_views": _CLAIMS + " SELECT lot, (SELECT count(*) FROM said s WHERE s.lot = v.lot AND reason IS NOT NULL) || ' frame(s) read once: ' || string_agg(phrase, '; ' ORDER BY owner) AS said FROM v GROUP BY lot",
    "batch_answers": _FRAMES.format(limit=5)
    + """, n AS (SELECT lot, owner, count(*) AS n FROM said GROUP BY lot, owner)
        SELECT lot, CAST((owner - 1) // 3 AS INTEGER) AS batch, string_agg(CAST(owner AS VARCHAR), ',' ORDER BY owner) AS positions, CAST(sum(n) AS BIGINT) AS answered FROM n GROUP BY 1, 2""",
    "text_passes": f"""WITH f AS (SELECT lot_id AS lot, item_seq AS position, min(part_id) % 3 AS found FROM ({ITEMS_SQL}) GROUP BY 1, 2)
        SELECT lot, position, coalesce((SELECT sum(b.found) FROM f b WHERE b.lot = f.lot AND b.position < f.position), 0) < 4 AS text_read FROM f WHERE position <= 6""",
    "price_states": f"""WITH e AS (SELECT user_id AS lot, event_id AS seq, {_picked("event_id", *_KINDS)} AS kind FROM events), k AS (SELECT * FROM e WHERE kind <> 'other'),
        s AS (SELECT lot, max(seq) FILTER (WHERE kind IN ('apply', 'clear', 'reset')) AS at, arg_max(kind, seq) AS last FROM k GROUP BY lot)
        SELECT s.lot, CASE WHEN kind = 'apply' THEN CAST(seq % 100 AS DOUBLE) ELSE 0.0::DOUBLE END AS retail, CASE WHEN kind = 'apply' THEN CAST(seq % 50 AS DOUBLE) ELSE 0.0::DOUBLE END AS resale,
        CASE WHEN kind = 'apply' THEN {_picked("seq", "High", "Med", "Low")} ELSE 'Low' END AS confidence, last = 'start' AS pricing FROM s LEFT JOIN k ON k.lot = s.lot AND k.seq = s.at""",
    "board_gates": f"""WITH r AS (SELECT lot_id // 30 AS board, lot_id % 7 > 0 AS valued, active, lot_id % 11 = 0 AS checked FROM ({LOTS_SQL})),
        g AS (SELECT board, board % 5 > 0 AND board % 7 <> 0 AS price_row, bool_or(NOT valued) AS p, bool_or(NOT valued AND NOT active) AS e, bool_or(checked) AS ps, bool_or(checked AND NOT valued) AS es FROM r GROUP BY board)
        SELECT board, price_row, price_row AND board % 3 <> 0 AND p AS price_all, price_row AND board % 3 <> 0 AND e AS eval_all, price_row AND board % 3 <> 0 AND ps AS price_selected, price_row AND board % 3 <> 0 AND es AS eval_selected FROM g""",
}
