"""Queries of ordered computations over line items, events and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import arrays as A
from tallyforge.functions import money as M
from tallyforge.operators import answers as J
from tallyforge.operators import resolve as R
from tallyforge.operators import sequences as S
from tallyforge.sources.bindings import ITEMS_SQL, line_items, table
from tallyforge.streaming import scan_events


def _order() -> Column:
    """The order of a lot's photographs."""
    return F.struct("item_seq", "part_id", "quantity", "retail")


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as photographs of n bytes."""
    return line_items(spark, sf_dir).withColumn("n", (F.col("quantity") * 1000 + F.col("item_seq")).cast("long"))


_PHOTOS = f"WITH RECURSIVE photos AS (SELECT *, CAST(quantity * 1000 + item_seq AS BIGINT) AS n, row_number() OVER (PARTITION BY lot_id ORDER BY item_seq, part_id, quantity, retail) AS p FROM ({ITEMS_SQL}))"


def pieces_of_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("lot_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = S.pieces(items, "lot_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), 12)
    return out.groupBy("lot_id", "piece").agg(F.count(F.lit(1)).alias("items"), F.min("l_orderkey").alias("first_order"))


def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.prefix_budget(_photos(spark, sf_dir), "lot_id", _order(), F.col("n"), 60_000)
    return kept.groupBy("lot_id").agg(F.count(F.lit(1)).alias("photos"), F.max("used").alias("used"))


def next_fit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.next_fit(_photos(spark, sf_dir), "lot_id", _order(), "n", 3, 60_000)
    return b.groupBy("lot_id", "batch").agg(F.count(F.lit(1)).alias("photos"), F.sum("n").alias("bytes"))


def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.greedy_budget(_photos(spark, sf_dir), "lot_id", _order(), "n", 60_000)
    return g.groupBy("lot_id").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("over"), F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).alias("bytes"))


def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of ten to a lot, grouped by the signs of their first four components."""
    v = table(spark, sf_dir, "embeddings")
    signal = F.array_join(F.transform(F.slice("embedding", 1, 4), lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return S.frame_groups(v.select(F.floor(F.col("vec_id") / 10).alias("lot_id"), F.col("vec_id").alias("position"), signal.alias("signal")))


def frame_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of whole levels, their components held to 0 to 255 around 128."""
    grays = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(128 + 256 * x.cast("double")), F.lit(0)), F.lit(255)))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.fingerprint(grays).alias("bits"))


def reading_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stored first, then everything else; of a user and type's readings the newest stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return S.upsert(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), ["user_id"], "event_id")


def running_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.running(e.where("event_type IN ('click', 'view')"), "user_id", F.col("event_id"))


def settled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors whose user's event before was an error, too."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.twice_seen(e, "user_id", F.col("event_id"), F.col("event_type") == "error").where("settled").select("user_id", "event_id")


def row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event decides a row's state."""
    e = S.latest(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), "event_type")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "analyzing").otherwise("pending")
    return e.select("user_id", state.alias("state"), state.isin("failed", "completed").alias("terminal"))


def recent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last five events."""
    return S.last_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"), 5)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk's progress and step share, from each line's numbers."""
    i = line_items(spark, sf_dir)
    target = M.page_target(F.col("item_seq"), F.col("confidence") == "High", F.when(F.col("confidence") != "Low", F.col("quantity")))
    return i.select(
        "lot_id", "item_seq", "part_id",
        target.cast("int").alias("target"),
        M.progress(F.col("item_seq") - 1, F.col("quantity"), F.lit(24), target).alias("done"),
        M.step_share(F.lit("photograph"), F.col("item_seq"), F.col("quantity")).alias("share"),
    )


def count_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a part as sightings of one product: which count stands."""
    s = line_items(spark, sf_dir).select("part_id", "quantity", "confidence", (F.col("retail") > 20000).alias("has_code"), F.col("item_seq").alias("n_views"))
    out = R.counted(s, ["part_id"])
    return out.withColumn("counts", F.array_join(F.transform("counts", lambda x: x.cast("string")), ","))


def decode_items_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a fenced JSON answer of each lot, decoded again."""
    i = line_items(spark, sf_dir)
    item = F.struct(F.concat(F.lit(" part  "), "part_id").alias("itemName"), F.lower("confidence").alias("confidence"), F.col("retail").cast("double").alias("retailValue"), (-F.col("resale").cast("double")).alias("resaleValue"), F.col("quantity").cast("double").alias("quantity"), F.array("item_seq", "item_seq").alias("photos"))
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.collect_list(item).alias("items"))), F.lit("\n```"))
    decoded = J.line_items(i.groupBy("lot_id").agg(text.alias("text")))
    rows = decoded.select("lot_id", "status", F.explode("items").alias("i"))
    return rows.select("lot_id", "status", "i.item_name", "i.confidence", "i.retail", "i.resale", "i.quantity", F.array_join(F.transform("i.photos", lambda x: x.cast("string")), ",").alias("photos"))


def pre_price_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as pre-price answers: those without resale are errors."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", F.col("props")).otherwise(F.concat(F.lit('Sure: {"resaleValue": '), F.col("value").cast("string"), F.lit(', "confidence": "guess"}')))
    return J.pre_prices(e.select("event_id", text.alias("text"))).select("event_id", "status", "retail", "resale", "confidence")


def _sightings(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Line items as sightings, every second part's with its code as identifier; more: further columns of the part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), *more)
    code = F.lpad(F.col("part_id").cast("string"), 12, "9")
    return line_items(spark, sf_dir).join(part, "part_id").select(
        F.col("lot_id").cast("string").alias("lot"), (F.col("item_seq") * 1_000_000 + F.col("part_id")).cast("long").alias("seq"), "part_id", "item_seq", "name", "brand", "quantity", "confidence", "retail", "resale",
        F.when(F.col("part_id") % 2 == 0, F.array(code)).otherwise(F.array().cast("array<string>")).alias("identifiers"), *part.columns[3:],
    )


def product_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot's line items as sightings, every third part's with its type as model, folded greedily."""
    s = _sightings(spark, sf_dir, F.col("p_type").alias("type")).withColumn("model", F.when(F.col("part_id") % 3 == 0, F.col("type")).otherwise(""))
    f = R.fold(s.select("lot", F.lit(0).alias("batch"), "seq", "name", "brand", "model", "quantity", "confidence", "identifiers", F.array("item_seq").alias("views")))
    return f.select("lot", "line", "name", "brand", "quantity", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"), "reason", "confidence", F.array_join("identifiers", ",").alias("identifiers"), F.array_join(F.transform("views", lambda x: x.cast("string")), ",").alias("views"), "sightings")


def long_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items of a supplier as one lot's sightings of parts, folded without gathering the lot."""
    part, seq = F.col("l_partkey").cast("long"), F.col("l_linenumber") * 100_000 + F.col("l_partkey") % 100_000
    i = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 25).cast("string").alias("lot"), F.col("l_orderkey").cast("int").alias("batch"), seq.cast("int").alias("seq"), part.alias("part")).agg(F.max("l_quantity").cast("int").alias("quantity"))
    code = F.concat(F.lit("PK"), F.lpad(F.col("part").cast("string"), 7, "0"))
    s = i.select("lot", "batch", "seq", F.concat(F.lit("Part "), "part").alias("name"), "quantity", F.lit("High").alias("confidence"), F.when(F.col("part") % 2 == 0, F.array(code)).otherwise(F.array().cast("array<string>")).alias("identifiers"), F.array(F.lit(1)).alias("views"))
    f = R.fold_long(s)
    return f.select("lot", "line", "name", "quantity", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"), F.array_join("identifiers", ",").alias("identifiers"), "sightings")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as photograph objects with their keys, dealt by lot."""
    unit = lambda c: F.col(c).cast("double") / F.col("quantity")
    # one shuffle by lot serves all that follows
    s = _sightings(spark, sf_dir).repartition("lot")
    o = s.select("lot", "seq", "part_id", "name", "brand", "quantity", "confidence", "identifiers", unit("retail").alias("unit_retail"), unit("resale").alias("unit_resale"), F.col("item_seq").alias("photo"))
    key = ["lot", "seq", "part_id"]  # parts of 1,000,000 and more share numbers with those of the next item: two objects, though one node
    rest = [c for c in o.columns if c not in key]
    return o.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select("lot", "seq", "r.*").withColumn("keys", R.merge_keys(F.col("name"), F.col("brand"), F.col("identifiers")))


def product_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot's 12 best lines of line items as photograph objects, merged by identifiers and names."""
    top = R.best_lines(_objects(spark, sf_dir), counted=line_items(spark, sf_dir).select(F.col("lot_id").cast("string").alias("lot")))
    return top.select("lot", "place", "label", R.display_name(F.col("name"), F.col("quantity")).alias("name"), "brand", "quantity", "retail", "resale", "confidence", "sightings", R.evidence_text(F.col("identifiers"), F.col("label_text"), F.col("evidence")).alias("evidence"), R.merge_note(F.col("sightings"), F.col("photos")).alias("note"))


QUERIES = {
    "pieces_of_12": pieces_of_12,
    "prefix_budget": prefix_budget,
    "next_fit_batches": next_fit_batches,
    "greedy_budget": greedy_budget,
    "frame_groups": frame_groups,
    "frame_fingerprints": frame_fingerprints,
    "reading_upsert": reading_upsert,
    "running_answered": running_answered,
    "settled_errors": settled_errors,
    "row_states": row_states,
    "recent_log": recent_log,
    "progress": progress,
    "count_conflicts": count_conflicts,
    "decode_items_json": decode_items_json,
    "pre_price_answers": pre_price_answers,
    "product_fold": product_fold,
    "long_fold": long_fold,
    "product_merge": product_merge,
    "stream_event_counts": scan_events.event_counts,
    "stream_first_events": scan_events.first_events,
}

ORACLE_SQL = {
    # objects reach each other over shared codes and names, step by step
    "product_merge": f"""
        WITH RECURSIVE o AS (SELECT lot_id, CAST(item_seq * 1000000 + part_id AS BIGINT) AS seq, part_id, min({{'name': p_name, 'brand': p_brand, 'quantity': quantity, 'confidence': confidence, 'retail': CAST(retail AS DOUBLE) / quantity, 'resale': CAST(resale AS DOUBLE) / quantity, 'photo': item_seq}}) AS x FROM ({ITEMS_SQL}) JOIN part ON p_partkey = part_id GROUP BY 1, 2, 3),
        k AS (SELECT lot_id, seq, 'name:' || x.brand || '|' || x.name AS key FROM o UNION ALL SELECT lot_id, seq, 'id:' || lpad(CAST(part_id AS VARCHAR), 12, '9') FROM o WHERE part_id % 2 = 0),
        e AS (SELECT DISTINCT a.lot_id, a.seq AS a, b.seq AS b FROM k a JOIN k b ON a.lot_id = b.lot_id AND a.key = b.key),
        reach AS (SELECT lot_id, seq, seq AS r FROM o UNION SELECT e.lot_id, e.b, reach.r FROM reach JOIN e ON e.lot_id = reach.lot_id AND e.a = reach.seq),
        l AS (SELECT lot_id, seq, min(r) AS label FROM reach GROUP BY 1, 2),
        c AS (SELECT lot_id, label, string_agg(code, ', ' ORDER BY first) AS ids FROM (SELECT lot_id, label, lpad(CAST(part_id AS VARCHAR), 12, '9') AS code, min(seq) AS first FROM o JOIN l USING (lot_id, seq) WHERE part_id % 2 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
        m AS (SELECT lot_id, label, count(*) AS n, arg_max(x.name, (length(x.name), -seq)) AS name, arg_min(x.brand, seq) AS brand, max(x.quantity) AS q, max(x.retail) * greatest(max(x.quantity), 1) AS retail, max(x.resale) * greatest(max(x.quantity), 1) AS resale,
                max(CASE x.confidence WHEN 'High' THEN 3 WHEN 'Med' THEN 2 ELSE 1 END) AS level, string_agg(DISTINCT CAST(x.photo AS VARCHAR), ', ' ORDER BY CAST(x.photo AS VARCHAR)) AS photos FROM o JOIN l USING (lot_id, seq) GROUP BY 1, 2),
        t AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY resale DESC, retail DESC, label) AS place FROM m)
        SELECT CAST(lot_id AS VARCHAR) AS lot, CAST(place AS INTEGER) AS place, label, name || CASE WHEN q > 1 THEN ' ×' || q ELSE '' END AS name, brand, q AS quantity, retail, resale, ['Low', 'Med', 'High'][level] AS confidence, n AS sightings, coalesce(ids, '') AS evidence,
               'Merged on this machine from ' || n || ' photograph reading(s) (photograph(s) ' || photos || ').' AS note FROM t LEFT JOIN c USING (lot_id, label) WHERE place <= 12""",
    # parts have nothing in common with each other, so each is one line
    "long_fold": """WITH d AS (SELECT CAST(l_suppkey % 25 AS VARCHAR) AS lot, l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CAST(max(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY l_suppkey % 25, 2, 3, 4),
        g AS (SELECT lot, p, min((o, n * 100000 + p % 100000)) AS first, max(q) AS quantity, count(DISTINCT q) AS k, list_sort(list(DISTINCT q)) AS qs, count(*) AS c FROM d GROUP BY lot, p)
        SELECT lot, CAST(row_number() OVER (PARTITION BY lot ORDER BY first) - 1 AS INTEGER) AS line, 'Part ' || p AS name, quantity, CASE WHEN k > 1 THEN array_to_string(qs, ',') ELSE '' END AS counts, CASE WHEN p % 2 = 0 THEN 'PK' || lpad(CAST(p AS VARCHAR), 7, '0') ELSE '' END AS identifiers, CAST(c AS INTEGER) AS sightings FROM g""",
    "pieces_of_12": """WITH p AS (SELECT l_suppkey AS lot_id, l_orderkey, CAST((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1) // 12 AS INTEGER) AS piece FROM lineitem)
        SELECT CAST(lot_id AS BIGINT) AS lot_id, piece, count(*) AS items, min(l_orderkey) AS first_order FROM p GROUP BY ALL""",
    "prefix_budget": _PHOTOS + ", r AS (SELECT lot_id, sum(n) OVER (PARTITION BY lot_id ORDER BY p) AS used FROM photos) SELECT lot_id, count(*) AS photos, CAST(max(used) AS BIGINT) AS used FROM r WHERE used <= 60000 GROUP BY lot_id",
    "next_fit_batches": _PHOTOS
    + """, walk AS (SELECT lot_id, p, n, 0 AS batch, 1 AS k, n AS used FROM photos WHERE p = 1 UNION ALL
        SELECT w.lot_id, x.p, x.n, CASE WHEN w.k >= 3 OR w.used + x.n > 60000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 3 OR w.used + x.n > 60000 THEN 1 ELSE w.k + 1 END,
               CASE WHEN w.k >= 3 OR w.used + x.n > 60000 THEN x.n ELSE w.used + x.n END FROM walk w JOIN photos x ON x.lot_id = w.lot_id AND x.p = w.p + 1)
        SELECT lot_id, batch, count(*) AS photos, CAST(sum(n) AS BIGINT) AS bytes FROM walk GROUP BY 1, 2""",
    "greedy_budget": _PHOTOS
    + """, walk AS (SELECT lot_id, p, n, n <= 60000 AS taken, CASE WHEN n <= 60000 THEN n ELSE 0 END AS used FROM photos WHERE p = 1 UNION ALL
        SELECT w.lot_id, x.p, x.n, w.used + x.n <= 60000, CASE WHEN w.used + x.n <= 60000 THEN w.used + x.n ELSE w.used END FROM walk w JOIN photos x ON x.lot_id = w.lot_id AND x.p = w.p + 1)
        SELECT lot_id, count(*) FILTER (WHERE taken) AS taken, count(*) FILTER (WHERE NOT taken) AS over, CAST(sum(CASE WHEN taken THEN n ELSE 0 END) AS BIGINT) AS bytes FROM walk GROUP BY 1""",
    "frame_groups": """WITH f AS (SELECT CAST(vec_id // 10 AS BIGINT) AS lot_id, vec_id AS position, array_to_string(list_transform(embedding[1:4], lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS signal FROM embeddings)
        SELECT *, first_value(position) OVER (PARTITION BY lot_id, signal ORDER BY position) AS owner FROM f""",
    "frame_fingerprints": """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(128 + 256 * CAST(x AS DOUBLE)), 0), 255) AS BIGINT)) AS l FROM embeddings)
        SELECT vec_id, CASE WHEN len(list_distinct(l)) >= 8 THEN array_to_string(list_transform(l, lambda x: CASE WHEN x >= list_sum(l) // len(l) THEN '1' ELSE '0' END), '') END AS bits FROM g""",
    "reading_upsert": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "running_answered": "SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS answered FROM events WHERE event_type IN ('click', 'view')",
    "settled_errors": "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type = 'error' AND before = 'error'",
    "row_states": """WITH s AS (SELECT user_id, CASE max_by(event_type, event_id) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'analyzing' ELSE 'pending' END AS state FROM events GROUP BY user_id)
        SELECT user_id, state, state IN ('failed', 'completed') AS terminal FROM s""",
    "recent_log": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5",
    "progress": f"""WITH t AS (SELECT *, CASE WHEN confidence = 'High' THEN quantity WHEN confidence = 'Low' THEN greatest(item_seq, 1) ELSE least(greatest(item_seq, 1), quantity) END AS target FROM ({ITEMS_SQL}))
        SELECT lot_id, item_seq, part_id, CAST(target AS INTEGER) AS target, CASE WHEN target > 0 THEN least(1.0, (greatest(item_seq - 1, 0) + least(greatest(quantity, 0), 24) / 24::DOUBLE) / target) END AS done,
        0.2::DOUBLE + 0.7::DOUBLE * (least(greatest(item_seq, 0), greatest(quantity, 1)) / greatest(quantity, 1)::DOUBLE) AS share FROM t""",
    "count_conflicts": f"""WITH s AS (SELECT part_id, quantity, CASE confidence WHEN 'High' THEN 0 WHEN 'Med' THEN 1 ELSE 2 END AS rank, retail > 20000 AS code, item_seq AS views FROM ({ITEMS_SQL})),
        best AS (SELECT part_id, quantity FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY rank, code DESC, views DESC, quantity DESC) AS n FROM s WHERE quantity > 0) WHERE n = 1),
        agg AS (SELECT part_id, count(*) AS sightings, list_sort(list(DISTINCT quantity) FILTER (WHERE quantity > 0)) AS counts FROM s GROUP BY part_id)
        SELECT part_id, sightings, coalesce(quantity, 0) AS quantity, array_to_string(counts, ',') AS counts, len(counts) > 1 AS disputed FROM agg LEFT JOIN best USING (part_id)""",
    "decode_items_json": f"""SELECT lot_id, 'ok' AS status, 'part ' || part_id AS item_name, confidence, CAST(retail AS DOUBLE) AS retail, 0::DOUBLE AS resale, quantity, CAST(item_seq AS VARCHAR) AS photos FROM ({ITEMS_SQL})""",
    "pre_price_answers": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'empty' WHEN event_type = 'view' OR NOT value > 0 THEN 'no resale' ELSE 'ok' END AS status,
        CASE WHEN event_type NOT IN ('error', 'view') AND value > 0 THEN 0::DOUBLE END AS retail, CASE WHEN event_type NOT IN ('error', 'view') AND value > 0 THEN value END AS resale,
        CASE WHEN event_type NOT IN ('error', 'view') AND value > 0 THEN 'Low' END AS confidence FROM events""",
    "stream_event_counts": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "stream_first_events": "SELECT DISTINCT user_id, event_type FROM events",
}
