"""Queries over the HTML of pages: cards, lot pages, page profiles, descriptions, page counts; catalogue pages rendered from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import urls as U
from tallyforge.operators.links import page_wide
from tallyforge.sources import pages as P
from tallyforge.sources.bindings import table


def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of all pages: an article each, and what their fields fall back to."""
    return P.listings(table(spark, sf_dir, "pages"), P.ARTICLES)


def page_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page has of a gallery; the table's pages print no image, so each row tells that."""
    return P.lot_pages(table(spark, sf_dir, "pages"), P.ARTICLES).select("page_id", F.size("images").alias("images"), "note")


def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profiles(table(spark, sf_dir, "pages"), P.ARTICLES)


def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.descriptions(table(spark, sf_dir, "pages"), P.ARTICLES)


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_counts(table(spark, sf_dir, "pages"))


def _case(n: Column, *values: Column | str) -> Column:
    """The value that a number's remainder picks."""
    out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
    for k in range(len(values) - 2, -1, -1):
        out = F.when(n % len(values) == k, values[k]).otherwise(out)
    return out


def _html(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: few bytes of a table become much HTML, so neither a file's splits nor partitions put together by size will do."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue pages of 20 cards, which print their fields in all the ways that sites do."""
    k = F.col("p_partkey").cast("long")
    n, page = (k + 100_000).cast("string"), F.floor(k / 20)
    price = F.format_string("%.2f", "p_retailprice")
    number = _case(k, _html('<i class="lot-number">Lot #', n, "</i>"), _html("<i>Item: ", n, "</i>"), "", "")
    title = _case(k, _html("<h3>", F.col("p_name"), "</h3>"), _html('<a title="', F.col("p_name"), '" href="#top"></a>'), "")
    label = _case(k, "", "", _html(' aria-label="', F.col("p_name"), '"'))
    bid = _case(k, _html('<b class="bid" data-bid="', price, '">soon</b>'), _html('<i class="price">$', price, "</i>"), _html("<i>Current Bid: $", price, "</i>"), "")
    sold = _case(k, '<i class="badge">SOLD</i>', "", "<i>all sold as one</i>", "", "")
    state = _case(k, "", "", "", "", ' data-status="Sold"')
    link = _case(k, "", _html('<a href="/share/', n, '">s</a><a class="lot-link" href="/lot/', n, '">Open</a>'), _html('<a href="/view?x=b&id=', n, '">View</a>'), _html('<a href="../x/', n, '/more">More</a>'))
    image = _case(k, _html('<img src="/t/', n, '_s.jpg" data-large_image="/t/', n, '_l.jpg">'), _html('<a href="/big/', n, '.jpg"><img src="/thumbs/', n, '.jpg"></a>'), _html('<picture><source srcset="/p/', n, "-a.webp 300w, /p/", n, '-b.webp 800w"><img src="/p/', n, '.jpg"></picture>'), "")
    body = _html(title, number, "<p>", F.col("p_brand"), " ", F.col("p_type"), "</p>", bid, sold, link, image)
    own_id = _case(k, "", "", "", _html(' id="ItemMain', n, '"'))
    card = _case(
        page,
        _html('<div data-lot-id="', n, '"', label, state, ">", body, "</div>"),
        _html('<div class="lot-card x"', own_id, label, state, ">", body, "</div>"),
        _html("<li", own_id, label, state, ">", body, "<li>a</li>"),
    )
    parts = table(spark, sf_dir, "part").withColumn("page_id", page)
    parts = dealt(parts, "page_id")
    rows = parts.select("page_id", F.struct(k.alias("k"), card.alias("card")).alias("c"), _html('<a href="/catalog/item', n, '">x</a>').alias("foot"))
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list("c")).alias("cards"), F.array_join(F.array_sort(F.collect_list("foot")), "").alias("feet"))
    inside = F.array_join(F.transform("cards", lambda c: c["card"]), "")
    html = _html('<nav><div data-lot-id="1">Lot 1 of the menu</div></nav><ul class="grid">', inside, "</ul><section>", F.col("feet"), "</section>")
    return pages.select("page_id", _html("https://www.example.org/cat/", F.col("page_id").cast("string")).alias("url"), html.alias("html"))


def catalogue_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of catalogue pages, every field read by whichever of its ways the card has."""
    return P.listings(catalogue(spark, sf_dir)).withColumn("images", F.array_join("images", " "))


def catalogue_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue pages in one row each, and pages that say that they are empty."""
    pages = catalogue(spark, sf_dir)
    none = pages.select((-F.col("page_id") - 1).alias("page_id"), "url", F.when(F.col("page_id") % 2 == 0, "<p>Results: No Items Found.</p>").otherwise("<p>Soon</p>").alias("html"))
    return P.profiles(pages.unionByName(none)).select("page_id", "cards", "linked", "sold", F.col("signature").isNotNull().alias("signed"), "nothing_found")


def lot_galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lot pages: galleries in one container or two, nested ones, photographs that only scripts or the head name."""
    k = F.col("p_partkey").cast("long")
    n = k.cast("string")
    strip = _html('<ul class="mediaThumbnails"><li><a href="/g/', n, '/1.jpg"><img src="/g/', n, '/thumbs/1.jpg"></a></li><li><img src="/g/', n, '/2.jpg"></li><li><img src="/img/spacer.gif"></li></ul>')
    frame = _html('<img src="/g/', n, '/1_large.jpg">')
    script = _html('<script>var d = ["https://www.example.org/g/', n, '/3.jpg", "https://www.example.org/other/9.jpg"];</script>')
    head = _html('<head><meta property="og:image" content="/lead/', n, '.jpg"></head>')
    body = _case(k, _html('<div class="auc_slide left">', frame, strip, "</div>"), _html(strip, script), _html(head, "<p>none</p>", script), '<div class="auc_slide left"><p>soon</p></div>', _html(head, '<div class="auc_slide">', frame, "</div>"), "<p>no markup</p>")
    words = _case(k, _html('<div class="auc_info right"><p>Bid box</p><div class="active ins_cnt description-info-content">Lot Description: ', F.col("p_name"), "</div></div>"), _html('<div class="auc_info right">Description - ', F.col("p_type"), "</div>"), "")
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    pages = parts.select(k.alias("page_id"), F.lit("https://www.example.org/lot/1").alias("url"), _html(body, words).alias("html"))
    return P.lot_pages(pages).withColumn("images", F.array_join("images", " "))


def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards without a link and parts as links: which link of its page carries a card's number, the nearest first."""
    k, c = F.col("p_partkey").cast("long"), F.col("c_custkey").cast("long")
    five = lambda x: F.lpad(x.cast("string"), 5, "0")
    url = _html("http://h/", _case(k, five(k), _html("item", five(k), "x?v=", (k % 10).cast("string")), _html(five(k), "0"), _html("pallet", F.lower(F.substring("p_type", 1, 6)))))
    anchors = table(spark, sf_dir, "part").select((k % 5).alias("page_id"), k.cast("int").alias("pre"), url.alias("url"))
    number = _case(c, _html("", five(c)), _html("0-", F.substring(five(c), 2, 4)), _html("Item ", five(c)), F.upper(F.substring("c_mktsegment", 1, 6)), F.substring(five(c), 3, 3))
    scope = lambda w: F.struct((c - w).cast("int").alias("pre"), (c + w).cast("int").alias("last"))
    asked = table(spark, sf_dir, "customer").select((c % 5).alias("page_id"), c.cast("int").alias("position"), number.alias("number"), F.array(scope(2), scope(40)).alias("scopes"))
    return page_wide(asked, anchors)


def srcset_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as srcset attributes: the widest candidate of each; and the media type that an address is served as."""
    k = F.col("p_partkey").cast("long")
    n = k.cast("string")
    srcset = _case(k, _html("/a", n, ".jpg 300w,/b", n, ".png ", (k % 700).cast("string"), "w"), _html("/a", n, " , /b", n, " 1.5x, /c", n, " 2x"), _html(" /only", n, ".gif "), "", _html("/a", n, " 100w, /b", n, " 0.1x"))
    best = U.best_of_srcset(srcset)
    declared = _case(k, "image/JPG; q=1", "text/html", "")
    return table(spark, sf_dir, "part").select(k.alias("part_id"), best.alias("best"), U.image_mime(declared, F.concat(F.lit("http://h"), best)).alias("mime"))


QUERIES = {
    q.__name__: q
    for q in (listing_cards, page_gallery, page_profiles, page_descriptions, page_numbers, catalogue_cards, catalogue_profiles, lot_galleries, detail_links, srcset_choices)
}

_N = "CAST(p_partkey + 100000 AS VARCHAR)"

#: What parts print is known without reading any HTML; the driver's pages themselves are read by a parser, and small pages test that.
ORACLE_SQL = {
    "catalogue_cards": f"""
        WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey // 20 AS BIGINT) AS page_id, CAST(p_partkey % 20 AS INTEGER) AS place, {_N} AS n, p_name, p_brand || ' ' || p_type AS words, p_retailprice AS price, printf('%.2f', p_retailprice) AS shown FROM part)
        SELECT page_id, place AS position, CASE page_id % 3 WHEN 0 THEN '[data-lot-id]' WHEN 1 THEN '[class*=''lot-card'']' ELSE '[class*=''grid''] > li' END AS selector,
               n AS lot_number, p_name AS title, words AS description,
               CASE k % 4 WHEN 0 THEN shown WHEN 1 THEN '$' || shown WHEN 2 THEN 'Current Bid: $' || shown ELSE '' END AS bid_text, CASE WHEN k % 4 < 3 THEN round(price, 2) END AS bid,
               k % 5 NOT IN (0, 4) AS active, CASE k % 5 WHEN 0 THEN 'SOLD' WHEN 4 THEN 'Sold' ELSE '' END AS status,
               'https://www.example.org' || CASE k % 4 WHEN 0 THEN '/catalog/item' || n WHEN 1 THEN '/lot/' || n WHEN 2 THEN '/view?x=b&id=' || n ELSE '/x/' || n || '/more' END AS detail_url,
               CASE k % 4 WHEN 0 THEN 'https://www.example.org/t/' || n || '_l.jpg' WHEN 1 THEN 'https://www.example.org/big/' || n || '.jpg' WHEN 2 THEN 'https://www.example.org/p/' || n || '-b.webp' ELSE '' END AS images
        FROM p""",
    "catalogue_profiles": """
        WITH p AS (SELECT CAST(p_partkey // 20 AS BIGINT) AS page_id, count(*) AS cards, count(*) FILTER (p_partkey % 4 > 0) AS linked, count(*) FILTER (p_partkey % 5 = 0) AS sold FROM part GROUP BY 1)
        SELECT page_id, CAST(cards AS INTEGER) AS cards, CAST(linked AS INTEGER) AS linked, CAST(sold AS INTEGER) AS sold, true AS signed, false AS nothing_found FROM p
        UNION ALL SELECT -page_id - 1, 0, 0, 0, false, page_id % 2 = 0 FROM p""",
    "lot_galleries": """
        WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS page_id, 'https://www.example.org/g/' || p_partkey AS g, 'https://www.example.org/lead/' || p_partkey || '.jpg' AS lead, p_name, p_type FROM part)
        SELECT page_id, CASE page_id % 6 WHEN 0 THEN g || '/1.jpg ' || g || '/2.jpg' WHEN 1 THEN g || '/1.jpg ' || g || '/2.jpg ' || g || '/3.jpg'
                 WHEN 2 THEN lead || ' ' || g || '/3.jpg https://www.example.org/other/9.jpg' WHEN 4 THEN lead ELSE '' END AS images,
               CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'the page data supplied 1 more photograph(s) than the gallery markup held' WHEN 2 THEN 'no gallery container matched — 3 declared image(s) used instead'
                 WHEN 3 THEN 'the gallery carried no photographs' WHEN 4 THEN 'no gallery container matched — 1 declared image(s) used instead' ELSE 'the page carried no gallery markup' END AS note,
               CASE page_id % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE '' END AS description,
               CASE page_id % 3 WHEN 0 THEN 'div.active.ins_cnt.description-info-content' WHEN 1 THEN 'div.auc_info.right' ELSE '' END AS description_selector
        FROM p""",
    # every number against every link of its page, by the rule's own words
    "detail_links": """
        WITH a AS (SELECT CAST(p_partkey % 5 AS BIGINT) AS page_id, CAST(p_partkey AS INTEGER) AS pre, 'http://h/' || CASE p_partkey % 4 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') WHEN 1 THEN 'item' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || 'x?v=' || p_partkey % 10 WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '0' ELSE 'pallet' || lower(substr(p_type, 1, 6)) END AS url FROM part),
        t AS (SELECT DISTINCT url, unnest(list_filter(regexp_split_to_array(lower(url), '[^0-9a-z]+'), lambda x: x <> '')) AS token FROM a),
        c AS (SELECT CAST(c_custkey % 5 AS BIGINT) AS page_id, CAST(c_custkey AS INTEGER) AS position, lower(regexp_replace(CASE c_custkey % 5 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') WHEN 1 THEN '0-' || substr(lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 2, 4) WHEN 2 THEN 'Item ' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') WHEN 3 THEN upper(substr(c_mktsegment, 1, 6)) ELSE substr(lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 3, 3) END, '[^0-9a-zA-Z]', '', 'g')) AS v FROM customer),
        v AS (SELECT DISTINCT v FROM c WHERE length(v) >= 3),
        held AS (SELECT DISTINCT v, url FROM v JOIN t ON t.token = v.v OR (length(v.v) >= 5 AND contains(t.token, v.v) AND NOT regexp_matches(concat(substr(t.token, 1, instr(t.token, v.v) - 1), substr(t.token, instr(t.token, v.v) + length(v.v))), '[0-9]'))),
        m AS (SELECT c.page_id, c.position, a.url, row_number() OVER (PARTITION BY c.page_id, c.position ORDER BY CASE WHEN a.pre > c.position - 2 AND a.pre <= c.position + 2 THEN 1 WHEN a.pre > c.position - 40 AND a.pre <= c.position + 40 THEN 2 ELSE 99 END, a.pre) AS r
              FROM c JOIN held USING (v) JOIN a ON a.page_id = c.page_id AND a.url = held.url)
        SELECT page_id, position, url FROM m WHERE r = 1""",
    "srcset_choices": """
        SELECT CAST(p_partkey AS BIGINT) AS part_id, b AS best, CASE WHEN p_partkey % 3 = 0 THEN 'image/jpeg' WHEN ends_with(b, '.png') THEN 'image/png' WHEN ends_with(b, '.gif') THEN 'image/gif' ELSE 'image/jpeg' END AS mime
        FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 700 > 300 THEN '/b' || p_partkey || '.png' ELSE '/a' || p_partkey || '.jpg' END WHEN 1 THEN '/c' || p_partkey WHEN 2 THEN '/only' || p_partkey || '.gif' WHEN 4 THEN '/a' || p_partkey END AS b FROM part)""",
}
