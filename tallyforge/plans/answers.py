"""Queries of decoded readings and manifests, hints to wait, the archive of readings and event windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import answers as J
from tallyforge.scratch import saved, scratch_path
from tallyforge.sources.archive import ReadingArchive
from tallyforge.sources.bindings import ITEMS_SQL, line_items, table
from tallyforge.streaming import scan_events


def _listed(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")


def decoded_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one reading of each order, decoded again; every seventh part has no name and is left out."""
    name = F.when(F.col("part_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" part \t "), "part_id", F.lit(" ")))
    said = F.struct(
        name.alias("name"), (F.col("quantity") + 0.25).alias("quantity"), (-F.col("quantity")).cast("double").alias("unitRetail"), (F.col("quantity") * 30_000.0).alias("unitResale"),
        F.array(F.concat(F.lit("P  "), "part_id")).alias("identifiers"), F.lower("confidence").alias("confidence"),
    )
    text = F.concat(F.lit("Seen: "), J.payload(objects=F.collect_list(said), notes=F.lit("")))
    decoded = J.readings(line_items(spark, sf_dir).groupBy("lot_id").agg(text.alias("text")))
    rows = decoded.select("lot_id", "status", F.explode_outer("objects").alias("o"))
    return rows.select("lot_id", "status", "o.name", "o.quantity", "o.unit_retail", "o.unit_resale", F.array_join("o.identifiers", ",").alias("identifiers"), "o.confidence")


def decoded_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one manifest of each order: how many lines and units, and which positions nothing accounts for.

    Even items are seen by their own line, items that 3 divides are declared unread, the others are unaccounted.
    """
    seq = F.col("item_seq")
    line = F.struct(F.concat(F.lit("part "), "part_id").alias("itemName"), F.col("quantity").cast("double").alias("quantity"), F.when(seq % 2 == 0, F.array(seq, seq)).otherwise(F.array(F.lit(0))).cast("array<double>").alias("views"))
    unread = F.collect_list(F.when(seq % 3 == 0, seq.cast("double")))
    lots = line_items(spark, sf_dir).groupBy("lot_id").agg(F.array_sort(F.collect_set(seq)).alias("positions"), F.to_json(F.struct(F.collect_list(line).alias("manifest"), unread.alias("unreadFrames"))).alias("text"))
    decoded = J.manifests(lots)
    return decoded.select(
        "lot_id", "status", F.size("lines").alias("lines"), F.aggregate("lines", F.lit(0), lambda n, i: n + i["quantity"]).alias("units"), _listed(F.col("unread")).alias("unread"),
        _listed(J.unaccounted(F.col("positions"), F.flatten(F.transform("lines", lambda i: i["views"])), F.col("unread"))).alias("missing"),
    )


def request_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed requests: which may be sent again, and after how many seconds."""
    n = F.col("event_id")
    hint = F.when(n % 4 == 0, F.concat((n % 60).cast("string"), F.lit("s"))).when(n % 4 == 1, F.concat(F.lit(" "), (n % 90).cast("string"), F.lit(".5 "))).when(n % 4 == 2, F.lit("soon"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (n % 10 + 497).alias("status"), hint.alias("hint"))
    return e.select("event_id", J.retryable(F.col("status")).alias("again"), J.retry_after(F.col("hint"), F.col("ts")).alias("seconds"))


def stored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose readings were stored, stored anew for every third part, and forgotten for every fifth order, matched by address."""
    item = line_items(spark, sf_dir).groupBy("lot_id", "part_id").agg(F.min("item_seq").alias("position"))
    item = saved(item.select(F.col("lot_id").cast("string").alias("lot"), F.concat(F.lit("https://img/"), "part_id").alias("url"), "position", F.col("part_id").alias("part")), "photographs")
    reading = item.select("lot", F.lit("m").alias("model"), F.lit(1).alias("version"), "url", "position", F.lit(1).cast("long").alias("generation"), F.concat(F.lit("first "), "part").alias("summary"), "part")
    archive = ReadingArchive(spark, scratch_path(spark, "readings"))
    archive.store(reading)
    archive.store(reading.where(F.col("part") % 3 == 0).withColumn("generation", F.lit(2).cast("long")).withColumn("summary", F.concat(F.lit("second "), "part")))
    archive.forget(item.where(F.col("lot").cast("long") % 5 == 0).select("lot").distinct())
    return archive.matched(item.select("lot", "url", "position"), "m").select("lot", "url", "position", "summary")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the windows that the watermark has closed."""
    closed = scan_events.drained(scan_events.windowed(scan_events.events(spark, sf_dir)), "append")
    return closed.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


QUERIES = {q.__name__: q for q in (decoded_readings, decoded_manifests, request_hints, stored_readings, stream_event_windows)}

ORACLE_SQL = {
    "decoded_readings": f"""WITH i AS (SELECT *, part_id % 7 <> 0 AS named FROM ({ITEMS_SQL})), l AS (SELECT lot_id, bool_or(named) AS any_named FROM i GROUP BY lot_id)
        SELECT lot_id, 'ok' AS status, 'part ' || part_id AS name, quantity, 0::DOUBLE AS unit_retail, least(quantity * 30000::DOUBLE, 1000000::DOUBLE) AS unit_resale, 'P ' || part_id AS identifiers, confidence FROM i WHERE named
        UNION ALL SELECT lot_id, 'malformed', NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE NOT any_named""",
    "decoded_manifests": f"""SELECT lot_id, 'ok' AS status, CAST(count(*) AS INTEGER) AS lines, CAST(sum(quantity) AS INTEGER) AS units,
        coalesce(string_agg(DISTINCT CAST(item_seq AS VARCHAR), ',' ORDER BY CAST(item_seq AS VARCHAR)) FILTER (WHERE item_seq % 3 = 0), '') AS unread,
        coalesce(string_agg(DISTINCT CAST(item_seq AS VARCHAR), ',' ORDER BY CAST(item_seq AS VARCHAR)) FILTER (WHERE item_seq % 2 <> 0 AND item_seq % 3 <> 0), '') AS missing FROM ({ITEMS_SQL}) GROUP BY lot_id""",
    "request_hints": """SELECT event_id, event_id % 10 + 497 BETWEEN 500 AND 504 AS again,
        CASE event_id % 4 WHEN 0 THEN CAST(event_id % 60 AS DOUBLE) WHEN 1 THEN event_id % 90 + 0.5::DOUBLE END AS seconds FROM events""",
    "stored_readings": f"""SELECT CAST(lot_id AS VARCHAR) AS lot, 'https://img/' || part_id AS url, min(item_seq) AS position,
        CASE WHEN lot_id % 5 <> 0 THEN CASE WHEN part_id % 3 = 0 THEN 'second ' ELSE 'first ' END || part_id END AS summary FROM ({ITEMS_SQL}) GROUP BY lot_id, part_id""",
    "stream_event_windows": """SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events
        WHERE time_bucket(INTERVAL 10 MINUTES, ts) + INTERVAL 10 MINUTES <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
}
