"""Queries of photograph scans, rows in words, page walks and answers' envelopes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import paging as G
from tallyforge.functions import phrases as P
from tallyforge.functions import urls as U
from tallyforge.operators import scans as C
from tallyforge.operators import walks as K
from tallyforge.sources.bindings import ITEMS_SQL, line_items, table


def _pick(n: Column, *values: str) -> Column:
    """The value that a number's remainder picks."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _picked(n: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({n} % {len(values)} AS INTEGER) + 1]"


_VARIANTS = ("/thumbs/{}_s.jpg", "/large/{}.jpg?w=900", "/img/{}-300x200.jpg", "/img/{}_thumb.jpg?x=1&w=20", "/icons/next-arrow.png?n={}")
_HINTS = ("", "srcset", "large")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images in several variants, fifty to a page."""
    n = F.col("p_partkey").cast("long")
    url = F.concat(F.lit("http://img.example.org"), F.replace(_pick(n, *_VARIANTS), F.lit("{}"), F.floor(n / 5).cast("string")))
    return table(spark, sf_dir, "part").select(F.floor(n / 50).alias("page_id"), n.alias("seq"), url.alias("url"), _pick(n, *_HINTS).alias("hint"))


def image_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each photograph of a page, by its best variant."""
    return C.image_list(_candidates(spark, sf_dir))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page an address asks for as a link, and what its listing is."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", G.linked_page(url).alias("n"), G.linked_parameter(url).alias("parameter"), G.listing_path(U.path(url)).alias("listing"))


def row_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in words."""
    i = line_items(spark, sf_dir)
    unit = (F.col("retail") / F.col("quantity")).cast("double")
    seq, none = F.col("item_seq"), F.lit("")
    return i.select(
        "lot_id", "item_seq", "part_id",
        P.object_details(F.col("quantity"), F.round(unit), F.lit(0.0), F.when(seq % 2 == 0, "carton").otherwise(""), none, F.lit("left")).alias("details"),
        P.images_phrase(seq, F.col("quantity"), F.col("quantity") - seq - 2).alias("images"),
        P.job_text(F.lit("Pricing"), F.when(seq % 3 == 0, "7"), seq, seq, F.col("quantity"), seq % 2 == 0).alias("job"),
        P.item_name(F.concat(F.lit("Part "), F.col("part_id")), F.when(seq == 1, "PART").otherwise("Acme"), F.when(seq > 4, "M1").otherwise("")).alias("name"),
        P.views_phrase(F.array_distinct(F.array(seq, F.lit(2)))).alias("views"),
        P.state_label(_pick(seq, "pending", "failed", "completed", "skipped"), F.lit("why")).alias("state"),
        P.page_limit(seq - 3).alias("pages"),
        P.is_priced(F.col("retail"), F.col("resale")).alias("priced"),
    )


_EVENTS = ("reading", "reused", "read", "failed", "aggregating", "manifested", "manifestGap", "pricing", "aggregated", "fallingBack")


def scan_event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log texts and steps of scan events."""
    n = F.col("event_id").cast("int")
    e = F.struct(_pick(n, *_EVENTS).alias("event"), (n % 7 + 1).alias("index"), (n % 3 + 1).alias("of"), (n % 5).alias("answered"), F.lit(9).alias("total"), (n % 4).alias("count"), F.array(n % 7 + 1).alias("frames"), F.lit("why").alias("reason"))
    return table(spark, sf_dir, "events").select("event_id", P.event_text(e).alias("said"), P.event_step(e["event"]).alias("step"))


def text_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line items as pieces of text of 1 to 50 characters, within 60."""
    i = line_items(spark, sf_dir).groupBy("lot_id").agg(F.sort_array(F.collect_list(F.struct("item_seq", "part_id", "quantity"))).alias("s"))
    text = C.within_text_budget(F.transform("s", lambda x: F.rpad(x["part_id"].cast("string"), x["quantity"], "x")), 60)
    return i.select("lot_id", text.alias("t")).select("lot_id", "t.text", "t.omitted")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as label readings of their order's photographs."""
    first = line_items(spark, sf_dir).groupBy("lot_id", "item_seq").agg(F.min("part_id").alias("p"))
    code = F.concat(F.when(F.col("p") % 2 == 0, "C").otherwise("c"), (F.col("p") % 5).cast("string"))
    return first.select(F.col("lot_id").alias("lot"), F.col("item_seq").alias("position"), F.array(code, F.concat(F.lit("X"), F.col("item_seq"))).alias("codes"), F.when(F.col("p") % 3 == 0, F.array(F.concat(F.lit("label "), F.col("p")))).otherwise(F.array().cast("array<string>")).alias("wording"))


_LABELS = f"""WITH labels AS (SELECT lot_id AS lot, item_seq AS position, [CASE WHEN min(part_id) % 2 = 0 THEN 'C' ELSE 'c' END || min(part_id) % 5, 'X' || item_seq] AS codes,
        CASE WHEN min(part_id) % 3 = 0 THEN ['label ' || min(part_id)] ELSE [] END AS wording FROM ({ITEMS_SQL}) GROUP BY lot_id, item_seq)"""


def local_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line an order that rests on its first three photographs, with the codes and the wording of their labels."""
    labels = _labels(spark, sf_dir)
    lines = labels.select("lot").distinct().select("lot", F.lit(0).alias("line"), F.array(F.lit("x2")).alias("identifiers"), F.lit("").alias("label"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("views"))
    return C.with_local_codes(lines, labels).select("lot", F.array_join("identifiers", ",").alias("identifiers"), "label")


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all photographs of an order."""
    r = _labels(spark, sf_dir).select("lot", F.col("position").alias("seq"), F.lit(1).alias("images_read"), F.slice("codes", 1, 1).alias("barcodes"), F.col("codes").alias("identifiers"), "wording")
    m = C.merged_evidence(r, limits=(3, 4, 2))
    return m.select("lot", "images_read", *(F.array_join(c, ",").alias(c) for c in ("barcodes", "identifiers", "wording")))


def _response(event_type: Column, value: Column) -> Column:
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(value.alias("text")), F.struct(F.lit("!").alias("text"))).alias("parts")).alias("content"), F.when(event_type == "view", "SAFETY").otherwise("STOP").alias("finishReason"))).alias("candidates")))
    choice = F.to_json(F.struct(F.array(F.struct(F.struct(value.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")))
    return F.when(event_type == "purchase", choice).when(event_type == "error", F.lit('{"error":{"message":"slow down"}}')).otherwise(answer)


def response_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses of two providers: answers, refusals, errors."""
    n, kind = F.col("event_id"), F.col("event_type")
    r = table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", F.when(n % 2 == 0, 429).otherwise(503)).otherwise(200).alias("status"), _response(kind, n.cast("string")).alias("body"))
    u = C.unwrapped(r)
    return u.select("event_id", "answer", "finish", "error", "message", P.short_reason(F.col("error"), F.col("status")).alias("reason"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frames: a picture's print for some, codes for others."""
    first = line_items(spark, sf_dir).groupBy("lot_id", "item_seq").agg(F.min("part_id").alias("p"))
    return first.select(F.col("lot_id").alias("lot"), F.col("item_seq").alias("position"), F.when(F.col("p") % 3 == 0, (F.col("p") % 2).cast("string")).alias("fingerprint"), F.when(F.col("p") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("codes"))


def repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of an order repeat an earlier one of its first five, and why."""
    return C.grouped_frames(_frames(spark, sf_dir), limit=5)


def frame_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.folds_by_reason(C.grouped_frames(_frames(spark, sf_dir)))
    return f.select("lot", "place", "reason", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


_FRAMES = f"""WITH frames AS (SELECT lot_id AS lot, item_seq AS position, CASE min(part_id) % 3 WHEN 0 THEN 'picture:' || min(part_id) % 2 WHEN 1 THEN 'barcode:a+b' END AS signal FROM ({ITEMS_SQL}) GROUP BY lot_id, item_seq),
        owned AS (SELECT lot, position, signal, CASE WHEN signal IS NULL OR position > {{limit}} THEN position ELSE min(CASE WHEN position <= {{limit}} THEN position END) OVER (PARTITION BY lot, signal) END AS owner FROM frames),
        said AS (SELECT lot, position, owner, CASE WHEN owner <> position THEN CASE WHEN starts_with(signal, 'picture') THEN 'same picture' ELSE 'same barcode' END END AS reason FROM owned)"""


def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' orders as listing pages of a walk: pages that repeat, are missing, empty or clicked on from, and lots that come again."""
    n = F.col("l_suppkey") % 20
    i = table(spark, sf_dir, "lineitem").select(n.cast("long").alias("listing"), (F.col("l_linenumber") + 4 * (F.col("l_partkey") % 3)).cast("int").alias("page"), (F.col("l_orderkey") % 997).cast("string").alias("key"))
    p = i.groupBy("listing", "page").agg(F.collect_set("key").alias("keys"))
    listing, page = F.col("listing"), F.col("page")
    p = p.where(~((listing % 7 == 3) & (page == 5)) & ~((listing % 19 == 4) & (page == 1)))
    keys = F.when((listing % 3 == 0) & (page == 6) | (listing == 8) & (page == 1), F.array().cast("array<string>")).when((listing == 5) & (page == 4), F.lit(None)).otherwise(F.col("keys"))
    told = p.select("listing", "page", F.when(listing % 2 == 0, page % 5).otherwise(page).cast("string").alias("signature"), keys.alias("keys"), (listing % 4 == 0).alias("clicks"))
    return K.walked(told, limit=9)


def lot_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the outcomes of routes: the first that priced anything."""
    i = line_items(spark, sf_dir)
    return C.chosen_route(i.select(F.col("lot_id").alias("lot"), _pick(F.col("part_id"), "single", "thorough", "two pass", "manifest").alias("route"), F.when(F.col("quantity") > 25, F.col("item_seq")).otherwise(0).alias("items")))


QUERIES = {
    q.__name__: q
    for q in (image_lists, page_links, row_phrases, scan_event_texts, text_budgets, local_codes, evidence_merge, response_envelopes, repeated_frames, frame_folds, page_walk, lot_routes)
}

_ONE = "list_filter({l}, lambda x, k: list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = k)"

ORACLE_SQL = {
    # the five variants of a photograph: two have an identity of their own, the arrow is junk
    "image_lists": f"""WITH c AS (SELECT p_partkey // 50 AS page_id, CAST(p_partkey AS BIGINT) AS seq, p_partkey // 5 AS k, p_partkey % 5 AS v, {_picked("p_partkey", *_HINTS)} AS hint FROM part WHERE p_partkey % 5 < 4),
        w AS (SELECT *, CASE v WHEN 0 THEN '/large/' || k || '_s.jpg' WHEN 1 THEN '/large/' || k || '.jpg' WHEN 2 THEN '/img/' || k || '.jpg' ELSE '/img/' || k || '.jpg?x=1' END AS whole,
                CASE hint WHEN 'large' THEN 200 WHEN 'srcset' THEN 100 ELSE 0 END + CASE v WHEN 0 THEN 50 WHEN 1 THEN 150 WHEN 2 THEN 0 ELSE -100 END AS score,
                CASE WHEN v < 2 THEN 'a' ELSE 'b' END AS identity FROM c),
        best AS (SELECT page_id, k, identity, min(seq) AS seq, arg_max('http://img.example.org' || whole, CAST(score AS BIGINT) * 100000000 - seq) AS url FROM w GROUP BY 1, 2, 3)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq) AS INTEGER) AS place, url FROM best""",
    "page_links": r"""WITH c AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '(?i)[?&](page|paged|pg)(?:\[\])?=(\d{1,7})', 2) AS INTEGER), TRY_CAST(regexp_extract(url, '(?i)/page[/-](\d{1,7})(?:[/?#]|$)', 1) AS INTEGER), 0) AS n,
        nullif(lower(regexp_extract(url, '(?i)[?&](page|paged|pg)(?:\[\])?=(\d{1,7})', 1)), '') AS parameter, regexp_replace(regexp_replace(path, '/page(?:[/-]\d{1,7})?/?$', ''), '/$', '') AS listing FROM c""",
    "row_phrases": f"""SELECT lot_id, item_seq, part_id,
        concat_ws(' · ', CASE WHEN quantity > 1 THEN quantity || ' visible' END, CASE WHEN retail > 0 THEN '$' || format('{{:,.2f}}', round(CAST(retail / quantity AS DOUBLE))) || ' ea retail' END, CASE WHEN item_seq % 2 = 0 THEN 'carton' END, 'left') AS details,
        CASE WHEN item_seq >= quantity THEN item_seq || ' image(s)' ELSE item_seq || ' of ' || quantity || ' image(s)' || CASE WHEN quantity - item_seq - 2 > 0 THEN ', ' || (quantity - item_seq - 2) || ' over the inline budget' ELSE '' END END AS images,
        CASE WHEN item_seq % 2 = 0 THEN 'Pricing Lot #' || least(greatest(item_seq, 1), greatest(quantity, 1)) || ' of ' || quantity WHEN item_seq % 3 = 0 THEN 'Pricing Lot #7' ELSE 'Pricing ' || item_seq || ' of ' || quantity END AS job,
        'Part ' || part_id || CASE WHEN item_seq = 1 THEN '' ELSE ' · Acme' END || CASE WHEN item_seq > 4 THEN ' · M1' ELSE '' END AS name,
        CASE WHEN item_seq = 2 THEN 'photograph 2' ELSE 'photographs ' || least(item_seq, 2) || ', ' || greatest(item_seq, 2) END AS views,
        CASE item_seq % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Failed — why' WHEN 2 THEN 'Valuated' ELSE 'Skipped — why' END AS state, CASE WHEN item_seq > 3 THEN item_seq - 3 ELSE 100 END AS pages, retail > 0 OR resale > 0 AS priced FROM ({ITEMS_SQL})""",
    "scan_event_texts": f"""WITH e AS (SELECT event_id, {_picked("event_id", *_EVENTS)} AS event, event_id % 7 + 1 AS i, event_id % 3 + 1 AS o, event_id % 5 AS answered, event_id % 4 AS n FROM events)
        SELECT event_id, CASE event WHEN 'reading' THEN 'reading photograph ' || i || ' of ' || o WHEN 'reused' THEN 'photograph ' || i || ' of ' || o || ': already read on this machine — reusing it, no request'
            WHEN 'read' THEN 'photograph ' || i || ' of ' || o || ' read: ' || n || ' product group(s)' WHEN 'failed' THEN 'photograph ' || i || ' of ' || o || ' could not be read (why) — carrying on with the rest'
            WHEN 'aggregating' THEN 'reconciling ' || i || ' reading(s)' || CASE WHEN n > 0 THEN ' plus ' || n || ' unread photograph(s)' ELSE '' END || ' into the pallet''s line items'
            WHEN 'manifested' THEN CASE WHEN o > 1 THEN 'manifest batch ' || i || ' of ' || o || ' read' ELSE 'manifest read' END || ': ' || n || ' item(s), ' || answered || ' of 9 photograph(s) answered'
            WHEN 'manifestGap' THEN CASE WHEN o > 1 THEN 'manifest batch ' || i || ' of ' || o ELSE 'the manifest batch' END || ' did not account for photograph ' || i || ' — it is in no item''s views and was not declared empty, so the inventory may be short of what it showed'
            WHEN 'pricing' THEN 'pricing ' || n || ' manifest item(s) in one request, with no photographs attached' WHEN 'aggregated' THEN 'reconciled into ' || n || ' line item(s)'
            ELSE 'nothing could be read photograph by photograph (why) — falling back to one pass over the whole gallery' END AS said,
        CASE WHEN event IN ('reading', 'reused', 'read', 'failed', 'manifested') THEN 'photograph' WHEN event = 'aggregating' THEN 'reconciling' WHEN event = 'pricing' THEN 'pricingManifest' WHEN event = 'fallingBack' THEN 'wholeGallery' END AS step FROM e""",
    "text_budgets": f"""WITH RECURSIVE p AS (SELECT lot_id, rpad(CAST(part_id AS VARCHAR), quantity, 'x') AS t, row_number() OVER (PARTITION BY lot_id ORDER BY item_seq, part_id, quantity) AS n FROM ({ITEMS_SQL})),
        walk AS (SELECT lot_id, n, [t] AS kept, 3 + length(t) AS used, 0 AS omitted FROM p WHERE n = 1 UNION ALL
        SELECT w.lot_id, p.n, CASE WHEN w.used + length(p.t) + 1 <= 60 THEN list_append(w.kept, p.t) ELSE w.kept END, CASE WHEN w.used + length(p.t) + 1 <= 60 THEN w.used + length(p.t) + 1 ELSE w.used END,
               CASE WHEN w.used + length(p.t) + 1 <= 60 THEN w.omitted ELSE w.omitted + 1 END FROM walk w JOIN p ON p.lot_id = w.lot_id AND p.n = w.n + 1)
        SELECT lot_id, '[' || array_to_string(arg_max(kept, n), ',') || ']' AS text, arg_max(omitted, n) AS omitted FROM walk GROUP BY lot_id""",
    "local_codes": _LABELS
    + f""", met AS (SELECT lot, list_concat(['x2'], flatten(list(codes ORDER BY position) FILTER (WHERE position <= 3))) AS l, flatten(list(wording ORDER BY position) FILTER (WHERE position <= 3)) AS w FROM labels GROUP BY lot)
        SELECT lot, array_to_string({_ONE.format(l="l")}, ',') AS identifiers, coalesce(w[1], '') AS label FROM met""",
    "evidence_merge": _LABELS
    + f""", met AS (SELECT lot, count(*) AS images_read, list(codes[1] ORDER BY position) AS b, flatten(list(codes ORDER BY position)) AS i, flatten(list(wording ORDER BY position)) AS w FROM labels GROUP BY lot)
        SELECT lot, images_read, array_to_string(({_ONE.format(l="b")})[1:3], ',') AS barcodes, array_to_string(({_ONE.format(l="i")})[1:4], ',') AS identifiers, array_to_string(({_ONE.format(l="w")})[1:2], ',') AS wording FROM met""",
    "response_envelopes": """SELECT event_id, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) WHEN event_type NOT IN ('error', 'view') THEN event_id || '!' END AS answer,
        CASE event_type WHEN 'purchase' THEN 'stop' WHEN 'error' THEN NULL WHEN 'view' THEN 'SAFETY' ELSE 'STOP' END AS finish,
        CASE WHEN event_type = 'view' THEN 'blocked' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'rate_limited' ELSE 'http' END END AS error,
        CASE WHEN event_type = 'error' THEN 'slow down' END AS message,
        CASE WHEN event_type = 'view' THEN 'blocked by safety filter' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'rate limited' ELSE 'HTTP 503' END END AS reason FROM events""",
    "repeated_frames": _FRAMES.format(limit=5) + " SELECT * FROM said",
    "frame_folds": _FRAMES.format(limit=1000)
    + ", f AS (SELECT lot, reason, min(position) AS first, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS frames FROM said WHERE reason IS NOT NULL GROUP BY lot, reason) SELECT lot, CAST(row_number() OVER (PARTITION BY lot ORDER BY first) AS INTEGER) AS place, reason, frames FROM f",
    # one page after another: what is known so far is carried along as lists
    "page_walk": """WITH RECURSIVE i AS (SELECT CAST(l_suppkey % 20 AS BIGINT) AS listing, CAST(l_linenumber + 4 * (l_partkey % 3) AS INTEGER) AS page, list(DISTINCT CAST(l_orderkey % 997 AS VARCHAR)) AS keys FROM lineitem GROUP BY 1, 2),
        p AS (SELECT listing, page, CASE WHEN listing % 3 = 0 AND page = 6 OR listing = 8 AND page = 1 THEN [] WHEN listing = 5 AND page = 4 THEN NULL ELSE keys END AS keys, CASE WHEN listing % 2 = 0 THEN page % 5 ELSE page END AS signature
              FROM i WHERE NOT (listing % 7 = 3 AND page = 5) AND NOT (listing % 19 = 4 AND page = 1)),
        walk AS (
            SELECT listing, 0 AS page, CAST(0 AS BIGINT) AS cards, CAST(0 AS BIGINT) AS new_lots, CAST([] AS VARCHAR[]) AS known, CAST([] AS BIGINT[]) AS prints, false AS already_read, CAST(NULL AS VARCHAR) AS stop FROM (SELECT DISTINCT listing FROM p WHERE page <= 9)
            UNION ALL
            SELECT w.listing, w.page + 1, coalesce(len(p.keys), 0), coalesce(len(list_filter(p.keys, lambda k: NOT list_contains(w.known, k))), 0), list_distinct(list_concat(w.known, coalesce(p.keys, []))), list_append(w.prints, CAST(p.signature AS BIGINT)),
                   coalesce(len(p.keys) > 0 AND list_contains(w.prints, p.signature), false),
                   CASE WHEN p.keys IS NULL THEN CASE WHEN w.page = 0 THEN 'no lots found' ELSE 'no such page' END
                        WHEN len(p.keys) = 0 THEN CASE WHEN w.page = 0 THEN 'no active lots' ELSE 'no more lots' END
                        WHEN list_contains(w.prints, p.signature) AND w.listing % 4 <> 0 THEN 'page already read' WHEN w.page = 8 THEN 'page limit' END
            FROM walk w LEFT JOIN p ON p.listing = w.listing AND p.page = w.page + 1 WHERE w.stop IS NULL
        )
        SELECT listing, page, cards, new_lots, cards - new_lots AS repeats, already_read, stop FROM walk WHERE page > 0""",
    "lot_routes": f"""WITH o AS (SELECT lot_id AS lot, {_picked("part_id", "single", "thorough", "two pass", "manifest")} AS route, CASE WHEN quantity > 25 THEN item_seq ELSE 0 END AS items FROM ({ITEMS_SQL})),
        r AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY items = 0, CASE route WHEN 'manifest' THEN 0 WHEN 'thorough' THEN 1 WHEN 'two pass' THEN 2 ELSE 3 END, items) AS n FROM o)
        SELECT lot, CASE WHEN items > 0 THEN route ELSE 'none' END AS route, items FROM r WHERE n = 1""",
}
