"""Goldens of addresses, galleries, page counts, phrases, frames and the archive; edge rows of the scan operators."""

from pyspark.sql import functions as F

from tallyforge.functions import arrays as A
from tallyforge.functions import images as I
from tallyforge.functions import paging as G
from tallyforge.functions import phrases as P
from tallyforge.functions import text as T
from tallyforge.functions import urls as U
from tallyforge.operators import board as B
from tallyforge.operators import scans as C
from tallyforge.scratch import scratch_path
from tallyforge.sources import pages as S
from tallyforge.sources.archive import SCHEMA, ReadingArchive


def mapped(spark, rule, *values):
    """rule of each value, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    return [r[0] for r in rows.select(rule(F.col("v"))).collect()]


def test_image_addresses(spark):
    assert mapped(spark, I.full_size, "http://h/thumbs/a_s.jpg?w=20&id=1", "http://h/a-300x200.jpg", "http://h/a_thumb.png?h=2#f", "http://h/a_medium.webp", "http://h/a_small.txt") == [
        "http://h/large/a_s.jpg?id=1", "http://h/a.jpg", "http://h/a.png#f", "http://h/a.webp", "http://h/a_small.txt"]
    assert len(set(mapped(spark, I.identity, "http://h/p/large/77_xl.jpg", "http://H/p/thumb/77_s.jpg?x", "http://h/p/77.jpg#a", "http://h/p/77@2x.jpg", "http://h/p/77-120x90.jpg"))) == 1
    assert mapped(spark, I.is_junk, "http://h/sprite.png", "http://h/next.svg", "http://h/arrow-left.png", "http://h/pallet.jpg") == [True, True, True, False]
    score = lambda url, hint: spark.range(1).select(I.score(F.lit(url), I.full_size(F.lit(url)), F.lit(hint))).first()[0]
    assert [score("http://h/large/a.jpg", "opened"), score("http://h/small/a.jpg", ""), score("http://h/800x600/a.jpg", "srcset"), score("http://h/a.jpg?w=900", "")] == [450, 50, 900, 0]
    got = spark.createDataFrame([("ftp://a/b", 200, "image/png", 9), ("http://a/b", 404, None, 9), ("http://a/b", 200, "image/png", 0), ("http://a/b", 200, "image/png", 7_000_000), ("http://a/b", 200, "text/html", 9), ("http://a/b", 200, None, 9)], "u string, s int, t string, n long")
    assert [r[0] for r in got.select(I.validity(F.col("u"), F.col("s"), F.col("t"), F.col("n"))).collect()] == ["unsupported address", "HTTP 404", "empty", "too large", "not an image", None]


def test_image_list_keeps_the_first_place_and_the_best_variant(spark):
    rows = [(1, 0, "http://h/thumb/1_s.jpg", ""), (1, 1, "http://h/2.jpg", ""), (1, 2, "http://h/large/1_xl.jpg", "opened"), (1, 3, "http://h/spinner.gif", ""), (1, 4, None, ""), (2, 0, "http://h/2.jpg", None)]
    got = C.image_list(spark.createDataFrame(rows, "page_id long, seq int, url string, hint string")).orderBy("page_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, "http://h/large/1_xl.jpg"), (1, 2, "http://h/2.jpg"), (2, 1, "http://h/2.jpg")]


def test_page_links(spark):
    assert mapped(spark, G.linked_page, "?page=4", "/x?a=1&paged=12", "/page/7", "/page-9?x=1", "?p=9999", "", None) == [4, 12, 7, 9, 0, 0, 0]
    assert mapped(spark, G.listing_path, "/catalog/page/3", "/catalog/page", "/catalog/", "/page-2/") == ["/catalog", "/catalog", "/catalog", ""]
    step = lambda label: G.is_step(label, F.lit(""))
    assert mapped(spark, step, "Next ›", "« Prev", "Last page", "7", "Load more") == [True, True, True, False, True]
    assert mapped(spark, lambda x: G.looks_like_next(x, F.lit("")), "Next", "previous page", "›", "3", "Show more") == [True, False, True, False, True]
    assert mapped(spark, G.pages_in_text, "Page 1 of 7", "page 2/24", "of 20 pages", "1-24 of 480 items", "1 – 50 of 1,001", "of 900 pages", "24-1 of 9", "none") == [7, 24, 20, 20, 21, 200, None, None]


def test_page_counts(spark):
    pager = lambda *n: "<div class='My-Pagination'>" + "".join(f"<a href='?page={i}'>{i}</a>" for i in n) + "<a href='?page=99' rel='next'>Next</a></div>"
    html = {
        1: pager(2, 24) + "<a href='/other?page=88'>88</a>",
        2: "<a href='/list/page/2'>2</a><a href='/list/page/999'>999</a>",
        3: "<p>Page 1 of <b>7</b></p>",
        4: "<script>page 1 of 9</script><a href='#' title='next'>go</a>",
        5: "",
        6: None,
        7: "Showing 1-24 of 480",
    }
    pages = spark.createDataFrame([(k, "http://h/list?page=1", v) for k, v in html.items()], "page_id long, url string, html string")
    got = {r.page_id: (r.pages, r.parameter, r.source) for r in S.page_counts(pages).collect()}
    assert got == {1: (24, "page", "pager"), 2: (2, None, "links"), 3: (7, None, "text"), 4: (None, None, "next control"), 5: (None, None, "nothing"), 6: (None, None, "nothing"), 7: (20, None, "text")}
    assert {r.page_id: r.link for r in S.page_link(pages, 24).collect()} == {1: "http://h/list?page=24"}
    assert S.page_counts(pages.limit(0)).count() == 0


def test_page_signature_and_nothing_found(spark):
    def fnv(text):
        h = 2166136261
        for k in range(0, len(b := text.encode("utf-16-be")), 2):
            h = (h ^ int.from_bytes(b[k : k + 2], "big")) * 16777619 % (1 << 32)
        return h

    assert mapped(spark, T.fnv32, "", "a", "Lot é 漢 𝄞 ~|,") == [fnv(""), fnv("a"), fnv("Lot é 漢 𝄞 ~|,")]
    html = "<div class='lot-card'>Pallet of lamps one<img src='/a.jpg'><img src='/b.jpg'><img src='/c.jpg'></div><div class='lot-card'>Pallet of chairs</div>"
    pages = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", "<p>No <b>lots</b> found</p>"), (3, "http://h/", "<script>'no lots found'</script>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in S.profiles(pages).collect()}
    assert got[1].signature == fnv("Pallet of lamps one|http://h/a.jpg,http://h/b.jpg~Pallet of chairs|")
    assert [got[k].nothing_found for k in (1, 2, 3)] == [False, True, False]


def test_phrases(spark):
    assert mapped(spark, P.without_heading, "Lot Description: lamps", "description - x", "plain", None) == ["lamps", "x", "plain", ""]
    assert mapped(spark, P.bid_text, "Lot 4 Current Bid: $45.00 now", "price €3,5", "nothing") == ["Current Bid: $45.00", "price €3,5", None]
    assert mapped(spark, P.is_filler, "No", " lot ", "142", "pallets") == [True, True, False, False]
    assert mapped(spark, lambda d: P.title_and_description(F.lit(" A  b"), d), "A b", "c", None, "") == ["A b", "A b — c", "A b — ", "A b — "]
    assert mapped(spark, lambda d: P.display_name(F.lit(""), d), "x") == ["x"] and mapped(spark, lambda d: P.replaced_description(F.lit("old"), d), " ", "new  text", None) == ["old", "new text", "old"]
    fails = lambda *f: spark.range(1).select(P.failures_phrase(F.array(*map(F.lit, f)).cast("array<string>"), F.lit(3))).first()[0]
    assert [fails(), fails("a"), fails("a", "b", "c")] == ["the batches read no goods", "1 of 3 batch(es) could not be read (a)", "no batch could be read (a)"]
    assert mapped(spark, lambda x: T.run_phrase(F.split(x, ",").cast("array<int>")), "7,8,9", "1,3,4") == ["7-9", "1, 3 and 4"]
    assert mapped(spark, lambda x: T.counts_phrase(F.split(x, ",").cast("array<int>")), "6,4", "4,6,9", "5") == ["6 and 4", "4, 6 and 9", "5"]
    assert mapped(spark, T.barcode, "0123456789012", "12345", "ABCDEF") == ["0123456789012", None, None]


def test_natural_order_of_long_numerals(spark):
    lots = ["Lot 2", "Lot 10", "lot 1", "Lot " + "9" * 25, "Lot 1" + "0" * 25, "Lot 007"]
    got = spark.createDataFrame([(x,) for x in lots], "v string").orderBy(T.natural_key(F.col("v"))).collect()
    assert [r.v for r in got] == ["lot 1", "Lot 2", "Lot 007", "Lot 10", "Lot " + "9" * 25, "Lot 1" + "0" * 25]


def test_retail_orders_by_what_is_shown(spark):
    lots = spark.createDataFrame([(1, 1, 0.0, None, None, "Low"), (2, 2, 0.0, 500.0, 900.0, "Med"), (3, 3, 0.0, 10.0, 20.0, "Med")], "lot_id long, seq long, bid double, pre_resale double, pre_retail double, pre_confidence string")
    items = spark.createDataFrame([(1, 400.0, 300.0, "High")], "lot_id long, retail double, resale double, confidence string")
    b = B.board(lots, items)
    assert [(r.lot_id, r.place) for r in B.numbered(b, B.order_of("retail", True)).select("lot_id", "place").orderBy("place").collect()] == [(2, 1), (1, 2), (3, 3)]


def test_fingerprints_take_the_whole_mean(spark):
    cells = [*range(97, 105), 100, 101, 101, 102]  # mean 100.83
    got = spark.createDataFrame([(cells,), ([1] * 12,)], "v array<int>").select(A.fingerprint(F.col("v"))).collect()
    assert [r[0] for r in got] == ["".join("1" if c >= 100 else "0" for c in cells), None]


def test_frames(spark):
    frame = "lot string, position int, fingerprint string, codes array<string>"
    rows = [("a", 1, "P", []), ("a", 2, "P", ["x"]), ("a", 3, "Q", []), ("b", 1, None, ["x"]), ("b", 2, None, ["x"]), ("b", 3, None, ["x", "y"]), ("b", 4, None, []), (None, 1, "P", None), (None, 2, "P", None)]
    df = spark.createDataFrame(rows, frame)
    groups = C.grouped_frames(df)
    assert {(r.lot, r.position): (r.owner, r.reason) for r in groups.collect() if r.reason} == {("a", 2): (1, "same picture"), ("b", 2): (1, "same barcode"), (None, 2): (1, "same picture")}
    assert not [r for r in C.grouped_frames(df, limit=1).collect() if r.reason]
    assert [(r.lot, r.place, r.reason, r.frames) for r in C.folds_by_reason(groups).where("lot = 'b'").collect()] == [("b", 1, "same barcode", [2])]
    photos = spark.createDataFrame([("a", 1, "u1"), ("a", 2, "u2"), ("a", 3, "u3")], "lot string, position int, url string")
    assert [r.position for r in C.pending(photos, spark.createDataFrame([("a", "u3")], "lot string, url string"), groups).collect()] == [1]


def test_scan_operators_on_edge_rows(spark):
    labels = spark.createDataFrame([("a", 2, ["B2", "b2"], ["w"]), ("a", 3, None, None)], "lot string, position int, codes array<string>, wording array<string>")
    lines = spark.createDataFrame([("a", 0, ["x"], "", [1, 2, 2, 3]), ("a", 1, None, "own", []), (None, 0, None, None, None)], "lot string, line int, identifiers array<string>, label string, views array<int>")
    assert sorted(tuple(r)[1:4] for r in C.with_local_codes(lines, labels).where("lot = 'a'").collect()) == [(0, ["x", "B2"], "w"), (1, [], "own")]
    assert C.with_local_codes(lines, labels).count() == 3
    photos = spark.createDataFrame([("a", 1), ("a", 2)], "lot string, position int")
    assert sorted((r.position, r.codes) for r in C.labelled(photos, labels).collect()) == [(1, []), (2, ["B2", "b2"])]
    budget = spark.createDataFrame([(["a" * 50, "b" * 9, "c" * 5],), ([],)], "p array<string>").select(C.within_text_budget(F.col("p"), 20).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in budget] == [(f"[{'a' * 50}]", 2), ("[]", 0)]
    responses = spark.createDataFrame([(1, 200, "{}"), (2, 200, '{"promptFeedback":{"blockReason":"X"}}'), (3, 500, "oops " * 100), (4, 200, '{"choices":[{"message":{"content":" "}}]}'), (5, 200, None), (6, 401, "")], "i int, status int, body string")
    got = {r.i: (r.error, r.message and len(r.message)) for r in C.unwrapped(responses).collect()}
    assert got == {1: ("malformed", None), 2: ("blocked", None), 3: ("http", 300), 4: ("no_content", None), 5: ("malformed", None), 6: ("http", 10)}
    routes = spark.createDataFrame([("a", "single", 3), ("a", "thorough", 2), ("b", "manifest", 0)], "lot string, route string, items int")
    assert sorted(tuple(r) for r in C.chosen_route(routes).collect()) == [("a", "thorough", 2), ("b", "none", 0)]


def test_more_rows_and_addresses(spark):
    assert B.visible(["a", "b", "c"], ["b", "x"]) == ["a", "c"] and B.visible(["a", "b"], ["a", "b"]) == ["a", "b"] and B.visible(["a"], None) == ["a"]
    jobs = spark.createDataFrame([("j", True, None), ("j", False, 0.5), ("j", False, None), ("k", True, 0.9)], "job string, answered boolean, share double")
    assert {r.job: r.progress for r in B.job_progress(jobs).collect()} == {"j": 0.5, "k": 1.0}
    assert mapped(spark, U.page_lot_number_of, "http://h/ItemMain19002", "http://h/items?itemid=77#x", "http://h/spring-sale", "", None, "http://h/1234567890123") == ["19002", "77", None, None, None, None]
    assert mapped(spark, U.is_auction_address, " https://h ", "HTTP://h/x", "ftp://h", "http://", "h", None) == [True, True, False, False, False, False]
    objects = spark.createDataFrame([("l", 1, 0, 0.0, 0.0, ["A"]), ("l", 1, 1, 2.0, 0.0, ["a", "B"]), ("l", 4, 0, None, None, None)], "lot string, position int, seq int, unit_retail double, unit_resale double, identifiers array<string>")
    assert [tuple(r) for r in C.reading_summary(objects).collect()] == [("l", 2, 3, 2, ["A", "B"])]
    groups = spark.createDataFrame([("l", 1, 1), ("l", 2, 1), ("l", 3, 3), ("l", 4, 3), ("l", 5, 5)], "lot string, position int, owner int")
    assert sorted(r.position for r in C.leftovers(groups, 4, groups.where("position = 1")).collect()) == [4, 5]
    lots = spark.createDataFrame([(1, "7", 5), (2, "7", 4), (3, "8", 1)], "lot_id long, lot_number string, seq long")
    reports = spark.createDataFrame([("7", "x"), ("9", "y")], "lot_number string, note string")
    assert sorted((r.lot_number, r.lot_id) for r in C.routed(reports, lots).collect()) == [("7", 2), ("9", None)]


def test_fallback_numbers_match_brute_force(spark):
    def number(image, text):
        h = 0xCBF29CE484222325
        for b in (image or " ".join((text or "").split()) or "unknown-lot").encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"AUTO-{h % (1 << 32):08X}"

    values = ["http://h/é.jpg", "", None, "x" * 3000]
    assert mapped(spark, lambda v: T.fallback_number(v, F.lit(" a  b ")), *values) == [number(v, "a b") for v in values]
    assert mapped(spark, lambda v: T.fallback_number(F.lit(""), v), *values) == [number("", v) for v in values]


def test_archive_forgets_lots_of_every_version(spark):
    archive = ReadingArchive(spark, scratch_path(spark, "archive"))
    archive.store(spark.createDataFrame([("a", "m", 1, "u", 1, 1, "old"), ("a", "m", 2, "u", 1, 1, "two"), ("b", "m", 2, "u", 1, 1, "b")], SCHEMA))
    archive.store(spark.createDataFrame([("a", "m", 1, "u", 1, 2, "new"), ("c", "m", 1, "v", 1, 1, "c")], SCHEMA))
    assert {(r.lot, r.summary) for r in archive.read().collect()} == {("a", "new"), ("c", "c")} and archive.stored_lots() == 2
    photos = spark.createDataFrame([("a", 7, "u"), ("a", 8, "w")], "lot string, position int, url string")
    assert sorted((r.position, r.summary) for r in archive.matched(photos, "m").collect()) == [(7, "new"), (8, None)]
    archive.forget(spark.createDataFrame([("a",)], "lot string"))
    assert {r.lot for r in archive.read().collect()} == {"c"} and {r.lot for r in archive.read(version=2).collect()} == {"b"}
    archive.forget()
    assert archive.stored_lots() == 0
