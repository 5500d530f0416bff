"""Queries of smaller rules of photographs, rows, links and downloads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import images as I
from tallyforge.functions import money as M
from tallyforge.functions import phrases as P
from tallyforge.functions import text as T
from tallyforge.functions import urls as U
from tallyforge.operators import answers as J
from tallyforge.operators import board as B
from tallyforge.operators import resolve as R
from tallyforge.operators import scans as C
from tallyforge.plans.listings import _case, _html
from tallyforge.plans.scans import _FRAMES, _LABELS, _frames, _labels
from tallyforge.sources import pages as G
from tallyforge.sources.bindings import ITEMS_SQL, line_items, table
from tallyforge.streaming import scan_events


def _listed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def labelled_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs of the first four places with the labels that two of three of them have."""
    labels = _labels(spark, sf_dir)
    rows = C.labelled(labels.where("position <= 4").select("lot", "position"), labels.where("position % 3 > 0"))
    return rows.select("lot", "position", _listed(F.col("codes")).alias("codes"), _listed(F.col("wording")).alias("wording"))


def pending_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs that neither a reading nor a frame before them covers."""
    frames = _frames(spark, sf_dir)
    photos = frames.select("lot", "position", F.concat(F.lit("u"), F.col("position") % 4).alias("url"))
    read = photos.where((F.col("lot") + F.col("position")) % 3 == 0).select("lot", "url")
    return C.pending(photos, read, C.grouped_frames(frames, limit=5))


def leftover_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are still to be sent after a scan of four, half of whose frames were read."""
    groups = C.grouped_frames(_frames(spark, sf_dir), limit=5)
    return C.leftovers(groups, 4, groups.where((F.col("lot") + F.col("position")) % 2 == 0).select("lot", "position"))


def reading_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readings of an order's photographs hold."""
    i = line_items(spark, sf_dir)
    part = F.col("part_id")
    code = F.concat(F.when(part % 2 == 0, "K").otherwise("k"), (part % 4).cast("string"))
    objects = i.select(F.col("lot_id").alias("lot"), F.col("item_seq").alias("position"), part.alias("seq"), F.when(part % 3 > 0, F.col("quantity").cast("double")).alias("unit_retail"), F.lit(0.0).alias("unit_resale"), F.when(part % 5 > 0, F.array(code, F.lit("Z"))).alias("identifiers"))
    s = C.reading_summary(objects.dropDuplicates(["lot", "position", "seq"]).withColumn("unit_retail", F.when(F.col("seq") % 3 > 0, 1.0)))
    return s.withColumn("identifiers", _listed(F.array_sort(F.transform("identifiers", F.lower))))


def routed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports by lot number; customers as lots of which several share a number."""
    lots = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("lot_id"), (F.col("c_custkey") % 90).cast("string").alias("lot_number"), (-F.col("c_custkey")).cast("long").alias("seq"))
    return C.routed(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 120).cast("string").alias("lot_number")), lots)


def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an inventory's lines: lines, units, photographs, disputed counts."""
    seq, q = F.col("item_seq"), F.col("quantity")
    lines = line_items(spark, sf_dir).select(F.col("lot_id").alias("lot"), (q - 3).alias("quantity"), F.array(seq, seq % 3).alias("views"), F.when(q % 4 == 0, F.array(q, q + 1)).otherwise(F.array().cast("array<int>")).alias("counts"))
    return R.inventory_totals(lines)


def repeated_line_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's three parts that most line items are of."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("lot"), F.col("l_partkey").cast("long").alias("label"), F.col("l_linenumber").cast("int").alias("photo"))
    lines = i.groupBy("lot", "label").agg(F.count(F.lit(1)).alias("sightings"), F.array_sort(F.collect_set("photo")).alias("photos")).withColumn("name", F.concat(F.lit("part "), "label")).withColumn("quantity", F.col("sightings").cast("int"))
    return R.repeated_lines(lines, 3)


def job_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of line items: what is done of each."""
    i = line_items(spark, sf_dir)
    return B.job_progress(i.select(F.col("lot_id").alias("job"), (F.col("item_seq") % 2 == 0).alias("answered"), F.when(F.col("item_seq") % 3 == 0, F.lit(0.25)).alias("share")))


def download_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as downloads of images: why one is of no use; and codes as barcodes."""
    n = F.col("event_id")
    url, status = _case(n, "https://h/a.jpg", "ftp://h/a.jpg", "http://h/b", "h.jpg"), F.when(n % 11 == 0, 404).when(n % 13 == 0, F.lit(None)).otherwise(200 + (n % 2))
    kind, size = _case(F.floor(n / 4), "image/png", " IMAGE/jpeg", "text/html"), F.when(n % 17 == 0, F.lit(0).cast("long")).when(n % 19 == 0, F.lit(7_000_000).cast("long")).otherwise(n)
    code = _case(n, _html("ab-", n.cast("string")), _html(" 4006381", F.lpad((n % 1000).cast("string"), 3, "0"), " "), "111111", _html("x", (n % 10).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", I.validity(url, status.cast("int"), kind, size.cast("long")).alias("why"), T.barcode(code).alias("barcode"))


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles, descriptions, tokens, addresses and shares."""
    k, name = F.col("p_partkey").cast("long"), F.col("p_name")
    n = k.cast("string")
    old, found = _html("old ", name), _case(k, _html(" new  ", name), " ", "")
    token = _case(k, " Lot ", "SKU", "pallets", _html("No", n), "code")
    address = _case(k, _html("http://h/ItemMain", n, "/x"), _html("https://h/items?itemid=", n, "#x"), _html(" HTTP://h/spring-", n, "a"), "ftp://h", "plain")
    title = _case(k, name, _html("  ", name, " "), "")
    return table(spark, sf_dir, "part").select(
        k.alias("part_id"), P.title_and_description(title, _case(k, "", name, F.col("p_type"))).alias("both"), P.replaced_description(old, found).alias("description"), P.is_filler(token).alias("filler"),
        U.page_lot_number_of(address).alias("number"), U.is_auction_address(address).alias("address"), M.percent_text((k % 400) / 100.0).alias("percent"),
        P.failures_phrase(F.slice(F.array(_html("a", n), _html("b", n), _html("c", n)), F.lit(1), (k % 4).cast("int")), F.lit(3)).alias("failures"),
    )


def stream_first_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, each by the first of the events that the watermark remembers."""
    stream = scan_events.first_seen(scan_events.events(spark, sf_dir).select("ts", "user_id"), ["user_id"])
    return scan_events.drained(stream, "append").select("user_id")


def _pagers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listing pages that tell their number of pages in several ways."""
    k = F.col("p_partkey").cast("long")
    n, last = k.cast("string"), (k % 30 + 2).cast("string")
    listing = _html("/cat", (k % 7).cast("string"))
    link = lambda page, word: _html('<a href="', listing, "?page=", page, '">', word, "</a>")
    body = _case(
        k,
        _html('<div class="pagination">', link("2", "2"), link(last, last), link("3", "Next"), "</div>", link("99", "99")),
        _html("<p>", link(last, last), link("2", "2"), "</p>"),
        _html("<p>Page 1 of ", last, "</p>"),
        _html("<p>Showing 1-20 of ", (k % 50 * 20 + 21).cast("string"), "</p>"),
        _html('<a rel="next" href="/elsewhere">more</a>'),
        _html("<p>", n, "</p>"),
    )
    return table(spark, sf_dir, "part").select(k.alias("page_id"), _html("https://www.example.org", listing, "/").alias("url"), body.alias("html"))


def pager_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages listings say that they have."""
    return G.page_counts(_pagers(spark, sf_dir))


def pager_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of listings to their page 2."""
    return G.page_link(_pagers(spark, sf_dir), 2)


def covered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded frames that a reading of their owner covers."""
    groups = C.grouped_frames(_frames(spark, sf_dir), limit=5)
    return C.covered_views(groups, groups.where((F.col("lot") + F.col("position")) % 3 < 2).select("lot", "position")).withColumn("frames", _listed(F.col("frames")))


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labels of several lines: their identifiers."""
    k = F.col("p_partkey").cast("long")
    n = F.lpad(k.cast("string"), 5, "0")
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(F.lit("ZX"), F.lpad(i.cast("string"), 2, "0"), n)), " ")
    lines = _case(
        k,
        F.array(_html("sku:ab", n, " / qty 12"), _html("UPC#0", n, "78 AB", n, "."), _html("AB", n)),
        F.array(_html("plain ", n), F.lit("batch of 9")),
        F.array(_html("Model: ", n), F.lit(None).cast("string"), _html("(Q-", n, ")")),
        F.array(many, F.lit("later ABC-999")),
    )
    return table(spark, sf_dir, "part").select(k.alias("part_id"), F.array_join(T.label_identifiers(F.filter(lines, lambda x: x.isNotNull())), ",").alias("codes"))


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as appraisals that fail in every way there is."""
    n = F.col("event_id")
    e = F.struct(
        (n % 31 != 0).alias("has_key"), F.when(n % 5 > 0, F.when(n % 7 == 0, 0).otherwise(3)).alias("images"), F.when(n % 29 == 0, "http://h/a.jpg").alias("unavailable"),
        F.when(n % 11 == 0, 429).when(n % 13 == 0, 500).otherwise(200).alias("status"), F.when(n % 17 == 0, "SAFETY").otherwise("STOP").alias("finish"), F.when(n % 19 == 0, "  ").otherwise("{}").alias("text"),
        (n % 23 != 0).alias("decodes"), F.when(n % 3 == 0, 4).otherwise(0).alias("photographs"), (n % 4).alias("read"), (n % 9 != 0).alias("one_by_one"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", P.failure_kind(e).alias("kind"), e["status"].alias("status"))
    return rows.select("event_id", "kind", P.short_reason(F.col("kind"), F.col("status")).alias("reason"))


def step_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of rows: what each has done; and hints to wait as dates."""
    n = F.col("event_id").cast("int")
    step = _case(n, "readingPage", "evaluatingText", "photograph", "wholeGallery", "reconciling", "pricingManifest", "other")
    ts = F.col("ts").cast("timestamp")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(ts) + n % 90 - 20), "EEE, dd MMM yyyy HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", M.step_share(step, n % 12 - 1, n % 9).alias("share"), J.retry_after(F.concat(date, F.lit(" GMT")), ts).alias("seconds"))


def line_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in words: how many, what one goes for, where they were seen; and the photographs of a lot's page in place of its card's."""
    q, seq = F.col("quantity"), F.col("item_seq")
    worth = F.when(F.col("part_id") % 3 > 0, (q * (F.col("part_id") % 50)).cast("double")).otherwise(0.0)
    photos = F.slice(F.array(seq + 4, seq, seq + 9), F.lit(1), (F.col("part_id") % 4).cast("int"))
    card = F.array(F.lit("card"))
    return line_items(spark, sf_dir).select(
        "lot_id", "item_seq", "part_id", P.quantity_text(q).alias("units"), P.unit_price_phrase(q, worth, worth / 2).alias("each"), P.photo_source(photos).alias("seen"),
        F.array_join(P.replaced_images(card, F.when(F.col("part_id") % 5 > 0, F.transform(photos, lambda p: F.concat(F.lit("p"), p)))), ",").alias("images"),
    )


QUERIES = {
    q.__name__: q
    for q in (covered_views, label_codes, failure_kinds, step_shares, line_phrases, labelled_photos, pending_photos, leftover_frames, reading_summaries, routed_reports, inventory_counts, repeated_line_phrases, job_shares, download_checks, text_rules, stream_first_users, pager_counts, pager_links)
}

_GROUPED = _FRAMES.format(limit=5) + ", g AS (SELECT s.lot, s.position, s.owner FROM said s)"
_P = "CAST(p_partkey AS VARCHAR)"

ORACLE_SQL = {
    "covered_views": _FRAMES.format(limit=5)
    + ", f AS (SELECT * FROM said WHERE reason IS NOT NULL AND (lot + owner) % 3 < 2 AND (lot + position) % 3 >= 2) SELECT lot, owner, reason, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS frames FROM f GROUP BY lot, owner, reason",
    "label_codes": """SELECT CAST(p_partkey AS BIGINT) AS part_id, CASE p_partkey % 4 WHEN 0 THEN 'AB' || n || ',0' || n || '78' WHEN 1 THEN '' WHEN 2 THEN CASE WHEN len(list_distinct(string_split(n, ''))) >= 3 THEN n || ',' ELSE '' END || 'Q-' || n
        ELSE array_to_string(list_transform(range(1, 13), lambda i: 'ZX' || lpad(CAST(i AS VARCHAR), 2, '0') || n), ',') END AS codes FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS n FROM part)""",
    "failure_kinds": """WITH k AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'missing_key' WHEN event_id % 29 = 0 THEN 'image_unavailable' WHEN event_id % 5 > 0 AND event_id % 7 = 0 THEN 'no_images' WHEN event_id % 3 = 0 AND event_id % 9 = 0 THEN 'scan_unsupported' WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'photographs_failed'
            WHEN event_id % 11 = 0 THEN 'rate_limited' WHEN event_id % 13 = 0 THEN 'http' WHEN event_id % 17 = 0 THEN 'blocked' WHEN event_id % 19 = 0 THEN 'no_content' WHEN event_id % 23 = 0 THEN 'malformed' END AS kind FROM events)
        SELECT event_id, kind, CASE kind WHEN 'missing_key' THEN 'missing API key' WHEN 'no_images' THEN 'no readable images' WHEN 'image_unavailable' THEN 'image unavailable' WHEN 'rate_limited' THEN 'rate limited' WHEN 'blocked' THEN 'blocked by safety filter' WHEN 'no_content' THEN 'empty model answer'
            WHEN 'malformed' THEN 'unreadable model answer' WHEN 'photographs_failed' THEN 'no readable photographs' WHEN 'scan_unsupported' THEN 'one-photograph reads unsupported' WHEN 'http' THEN 'HTTP 500' END AS reason FROM k""",
    "step_shares": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 0.2::DOUBLE + 0.7::DOUBLE * (least(greatest(event_id % 12 - 1, 0), greatest(event_id % 9, 1)) / greatest(event_id % 9, 1)) WHEN 3 THEN 0.6::DOUBLE WHEN 4 THEN 0.9::DOUBLE WHEN 5 THEN 0.9::DOUBLE END AS share,
        CAST(greatest(event_id % 90 - 20, 0) AS DOUBLE) AS seconds FROM events""",
    "line_phrases": f"""WITH i AS (SELECT *, CASE WHEN part_id % 3 > 0 THEN part_id % 50 ELSE 0 END AS unit, list_slice([item_seq + 4, item_seq, item_seq + 9], 1, part_id % 4) AS p FROM ({ITEMS_SQL}))
        SELECT lot_id, item_seq, part_id, CASE WHEN quantity > 1 THEN quantity || ' unit(s)' END AS units, CASE WHEN quantity > 1 AND unit > 0 THEN '$' || printf('%.2f', CAST(unit AS DOUBLE)) || ' ea retail · $' || printf('%.2f', unit / 2) || ' ea resale' END AS each,
        CASE len(p) WHEN 0 THEN NULL WHEN 1 THEN 'photograph ' || p[1] ELSE 'photographs ' || array_to_string(list_sort(p), ', ') END AS seen,
        CASE WHEN part_id % 5 > 0 AND len(p) > 0 THEN array_to_string(list_transform(p, lambda x: 'p' || x), ',') ELSE 'card' END AS images FROM i""",
    "labelled_photos": _LABELS + " SELECT lot, position, CASE WHEN position % 3 > 0 THEN array_to_string(codes, ',') ELSE '' END AS codes, CASE WHEN position % 3 > 0 THEN array_to_string(wording, ',') ELSE '' END AS wording FROM labels WHERE position <= 4",
    "pending_photos": _GROUPED + " SELECT g.lot, g.position, 'u' || g.position % 4 AS url FROM g WHERE g.owner = g.position AND NOT EXISTS (SELECT 1 FROM g r WHERE r.lot = g.lot AND (r.lot + r.position) % 3 = 0 AND r.position % 4 = g.position % 4)",
    "leftover_frames": _GROUPED + " SELECT lot, position FROM g WHERE position > 4 OR (owner <> position AND (lot + owner) % 2 <> 0)",
    "reading_summaries": f"""WITH o AS (SELECT DISTINCT lot_id AS lot, item_seq AS position, part_id AS p FROM ({ITEMS_SQL})), c AS (SELECT lot, count(DISTINCT position) AS photographs, count(*) AS objects, count(*) FILTER (p % 3 = 0) AS unpriced FROM o GROUP BY lot),
        i AS (SELECT DISTINCT lot, unnest(['k' || p % 4, 'z']) AS id FROM o WHERE p % 5 > 0), l AS (SELECT lot, string_agg(id, ',' ORDER BY id) AS identifiers FROM i GROUP BY lot)
        SELECT c.*, coalesce(identifiers, '') AS identifiers FROM c LEFT JOIN l USING (lot)""",
    "routed_reports": "SELECT CAST(event_id % 120 AS VARCHAR) AS lot_number, event_id, l.lot_id FROM events e LEFT JOIN (SELECT c_custkey % 90 AS n, CAST(max(c_custkey) AS BIGINT) AS lot_id FROM customer GROUP BY 1) l ON l.n = e.event_id % 120",
    "inventory_counts": f"""WITH i AS (SELECT * FROM ({ITEMS_SQL})), v AS (SELECT DISTINCT lot_id, unnest([item_seq, item_seq % 3]) AS v FROM i)
        SELECT lot_id AS lot, count(*) AS lines, CAST(sum(greatest(quantity - 3, 0)) AS BIGINT) AS units, CAST((SELECT count(*) FROM v WHERE v.lot_id = i.lot_id AND v > 0) AS INTEGER) AS photographs, count(*) FILTER (quantity % 4 = 0) AS disputed FROM i GROUP BY lot_id""",
    "repeated_line_phrases": """WITH l AS (SELECT CAST(l_suppkey AS BIGINT) AS lot, CAST(l_partkey AS BIGINT) AS label, count(*) AS n, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ', ' ORDER BY CAST(l_linenumber AS VARCHAR)) AS photos FROM lineitem GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY n DESC, label) AS place FROM l WHERE n > 1)
        SELECT lot, CAST(place AS INTEGER) AS place, '- part ' || label || ' ×' || n || ' — ' || n || ' sightings, in photograph(s) ' || photos AS phrase FROM r WHERE place <= 3""",
    "job_shares": f"SELECT lot_id AS job, least(1.0::DOUBLE, sum(CASE WHEN item_seq % 2 = 0 THEN 1.0::DOUBLE WHEN item_seq % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END) / count(*)) AS progress FROM ({ITEMS_SQL}) GROUP BY lot_id",
    "download_checks": """SELECT event_id, CASE WHEN event_id % 4 IN (1, 3) THEN 'unsupported address' WHEN event_id % 11 = 0 THEN 'HTTP 404' WHEN event_id % 13 = 0 THEN 'HTTP 0' WHEN event_id % 17 = 0 OR event_id = 0 THEN 'empty' WHEN event_id % 19 = 0 THEN 'too large' WHEN event_id // 4 % 3 = 2 THEN 'not an image' END AS why,
        CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id >= 100 THEN 'AB-' || event_id END WHEN 1 THEN '4006381' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS barcode FROM events""",
    "text_rules": f"""SELECT CAST(p_partkey AS BIGINT) AS part_id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' — ' WHEN 1 THEN p_name ELSE p_type END AS both, CASE p_partkey % 3 WHEN 0 THEN 'new ' || p_name ELSE 'old ' || p_name END AS description, p_partkey % 5 IN (0, 1, 4) AS filler,
        CASE p_partkey % 5 WHEN 0 THEN {_P} WHEN 1 THEN {_P} END AS number, p_partkey % 5 < 3 AS address, p_partkey % 400 || '%' AS percent,
        CASE p_partkey % 4 WHEN 0 THEN 'the batches read no goods' WHEN 3 THEN 'no batch could be read (a' || p_partkey || ')' ELSE p_partkey % 4 || ' of 3 batch(es) could not be read (a' || p_partkey || ')' END AS failures FROM part""",
    "stream_first_users": "SELECT DISTINCT user_id FROM events",
    "pager_counts": """SELECT CAST(p_partkey AS BIGINT) AS page_id, CAST(CASE WHEN p_partkey % 6 < 3 THEN p_partkey % 30 + 2 WHEN p_partkey % 6 = 3 THEN p_partkey % 50 + 2 END AS INTEGER) AS pages, CASE WHEN p_partkey % 6 < 2 THEN 'page' END AS parameter,
        p_partkey % 6 IN (0, 4) AS has_next, CASE p_partkey % 6 WHEN 0 THEN 'pager' WHEN 1 THEN 'links' WHEN 2 THEN 'text' WHEN 3 THEN 'text' WHEN 4 THEN 'next control' ELSE 'nothing' END AS source FROM part""",
    "pager_links": "SELECT CAST(p_partkey AS BIGINT) AS page_id, 'https://www.example.org/cat' || p_partkey % 7 || '?page=2' AS link FROM part WHERE p_partkey % 6 < 2",
}
