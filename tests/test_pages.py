"""Cards, galleries, profiles and links of small pages, one for each way that a field is read."""

import dataclasses
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.links import page_wide
from tallyforge.sources import pages as P

URL = "https://www.example.org/list"
OLD = dataclasses.replace(P.PRESET, cards=(".lot", "article"), description=(".lot-description", ".description", "[class*='description' i]"))


def _pages(spark, *html, url=URL):
    rows = [(i, url, h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("position", F.lit("clash")).withColumn("cards", F.lit(1))


def _cards(spark, *html, profile=P.PRESET):
    """The cards of each page, in order."""
    rows = P.listings(_pages(spark, *html), profile).orderBy("page_id", "position").collect()
    return [[r for r in rows if r.page_id == i] for i in range(len(html))]


CARD = '<div class="lot-card" {a}>{b}<p>twelve letters and more</p></div>'


def _card(body="", attributes=""):
    return CARD.format(a=attributes, b=body)


def test_number_by_each_of_its_ways(spark):
    pages = {
        "card attribute": (_card(attributes='data-id="Lot #A-77"'), "A-77"),
        "first attribute that is not blank": (_card(attributes='data-lotnumber=" " data-id=" 12  34 "'), "12 34"),
        "attribute too long": (_card('<i class="sku">S55</i>', f'data-id="{"9" * 61}"'), "S55"),
        "number element": (_card('<i class="Lot-Number">Lot Number 142</i>'), "142"),
        "its attribute first": (_card('<i class="lot-number" data-id="8">Lot 9</i>'), "8"),
        "glued id": (_card('<i class="lot-id">ItemMain19002</i>'), "19002"),
        "a code stays": (_card('<i class="lot-id">ABC123</i>'), "ABC123"),
        "label words alone": (_card('<i class="lot-number">Item Number</i><a href="/x/31">o</a>'), "31"),
        "words of the card": (_card("<i>Pallet: QX-9</i>"), "QX-9"),
        "address": (_card('<a href="/lots/page/2/item-552?ref=top">open</a>'), "552"),
        "address of a photograph": (_card('<a href="/img/lot-19002.jpg">photo</a>'), "19002"),
        "element id": (_card(attributes='id="item-row-88"'), "88"),
        "raw element id": (_card(attributes='data-key="k_9z"'), "k_9z"),
        "forty characters": (_card(attributes=f'data-id="{"x" * 50}"'), "x" * 40),
    }
    got = _cards(spark, *(html for html, _ in pages.values()))
    assert {name: [c.lot_number for c in cards] for name, cards in zip(pages, got)} == {name: [want] for name, (_, want) in pages.items()}
    none = _cards(spark, _card('<img src="/a.jpg">'), _card())
    assert [re.fullmatch("AUTO-[0-9A-F]{8}", cards[0].lot_number) is not None for cards in none] == [True, True]


def test_title_description_and_bid_by_each_of_their_ways(spark):
    pages = {
        "heading": _card("<h2>Two</h2><h1>One</h1>"),
        "class": _card('<b class="itemName">Named</b>'),
        "attribute": _card(attributes='title=" by  attribute "'),
        "anchor": _card('<i><a aria-label="By anchor" href="#">x</a></i>'),
        "description": _card(),
        "card's words": '<div class="lot-card"><i>nothing but these words here</i></div>',
    }
    got = {name: cards[0] for name, cards in zip(pages, _cards(spark, *pages.values()))}
    said = "twelve letters and more"
    assert {k: c.title for k, c in got.items()} == {"heading": "One", "class": "Named", "attribute": "by attribute", "anchor": "By anchor", "description": said, "card's words": "nothing but these words here"}
    assert got["heading"].description == said and got["card's words"].description == "nothing but these words here"
    bids = {
        '<b class="current-bid">$1,250.50</b><i class="price">$9</i>': ("$1,250.50", 1250.5),
        '<i class="price" content="42">from</i>': ("42", 42.0),
        "<strong>$7</strong>": ("$7", 7.0),
        "<i>High bid: 12.50 now</i>": ("High bid: 12.50", 12.5),
        "": ("", None),
    }
    assert [(c[0].bid_text, c[0].bid) for c in _cards(spark, *map(_card, bids))] == list(bids.values())
    long = _cards(spark, _card(f"<h3>{'t' * 400}</h3><i class='desc'>{'d ' * 500}</i><b class='bid'>{'1' * 100}</b>"))[0][0]
    assert (len(long.title), len(long.description), len(long.bid_text)) == (300, 600, 80)


def test_sold_by_badge_attribute_and_words(spark):
    pages = [
        (_card('<i class="badge">New</i><i class="status">SOLD today</i>'), (False, "SOLD today")),
        (_card('<i class="badge">Sold as one pallet</i>'), (True, "")),
        (_card(attributes='data-state="sold"'), (False, "sold")),
        (_card(f'<i class="badge">sold {"x" * 40}</i>'), (False, "")),
        (_card("<i>this one is sold</i>"), (False, "")),
        (_card("<i>unsold, resold</i>"), (True, "")),
    ]
    assert [(c[0].active, c[0].status) for c in _cards(spark, *(h for h, _ in pages))] == [w for _, w in pages]


def test_links_by_each_of_their_ways(spark):
    here = "https://www.example.org"
    tail = '<div><a href="/a">a</a><a href="/c/item-5501">b</a></div><footer><a href="/z/lot77001">z</a><a href="/y/77001">y</a></footer>'
    pages = {
        "named": (_card('<a href="/first">f</a><a class="lot-link" href="/named">n</a>'), "/named"),
        "named that leads nowhere": (_card('<a class="lot-link" href="/login">n</a><a href="/o">o</a>'), "/o"),
        "own": (_card('<a href="#x">j</a><a href="/cart">c</a><a href="/f.PDF?x">p</a><a href="mailto:a@b">m</a><a href="/o">o</a>'), "/o"),
        "own that carries the number": (_card('<a href="/o">o</a><a href="/p/5501/x">p</a>', 'data-id="5501"'), "/p/5501/x"),
        "wrapping": (f'<section><a href="/w"><div>{_card()}</div></a></section>', "/w"),
        "wrapped too far up": (f'<section><a href="/w"><b><i><u>{_card()}</u></i></b></a></section>', None),
        "around, nearer than the wrapping one": (f'<section><a href="/w"><div><div>{_card(attributes="data-id=5501")}</div><a href="/n/5501">n</a></div></a></section>', "/n/5501"),
        "page": (f'<div><div><div><div><div>{_card(attributes="data-id=77001")}</div></div></div></div></div>{tail}', "/z/lot77001"),
        "short numbers inside a word are none": (_card(attributes='data-id="550"') + tail, None),
        "no number": (_card() + tail, None),
    }
    got = _cards(spark, *(h for h, _ in pages.values()))
    assert {k: c[0].detail_url for k, c in zip(pages, got)} == {k: w and here + w for k, (_, w) in pages.items()}


def test_first_selector_with_a_card_wins(spark):
    pages = [
        '<nav><div data-lot-id="9">excluded, however long</div></nav>' + _card(),  # the only hit of the first selector is excluded
        '<div data-lot="x">1</div><div class="lot-card">short</div>' + _card(),  # an attribute of lots is sign enough
        '<div class="lot-card">short</div><div class="lot-card" id="lot-7">x</div>',  # so is a wrapped id
        '<ul class="grid"><li>a card of the grid</li><li><ul><li>not a child of the grid</li></ul></li></ul>',
        "<table><tbody><tr><td>a row of a table</td></tr><tr><td>x</td></tr></tbody></table>",
        "",
    ]
    got = _cards(spark, *pages)
    assert [(len(c), {x.selector for x in c}) for c in got] == [(1, {"[class*='lot-card']"}), (1, {"[data-lot]"}), (1, {"[class*='lot-card']"}), (2, {"[class*='grid'] > li"}), (1, {"table tbody tr"}), (0, set())]
    assert got[1][0].lot_number == "x" and got[2][0].lot_number == "7"


def test_photographs_of_a_card(spark):
    body = """<a href="/big/1.jpg"><img src="/thumbs/1.jpg"></a><img src="/2_s.jpg" data-zoom-image="/2_xl.jpg"><picture><source srcset="/3.webp 400w, /3b.webp 900w"><img src="/3.jpg"></picture>
    <img src="data:image/gif;base64,x"><img src="/arrow.png"><div style="background: url('/4.jpg')"></div><img srcset="/5.jpg 1x, /6.jpg 2x"><img src="/2_l.jpg">"""
    images = _cards(spark, _card(body), profile=dataclasses.replace(P.PRESET, most_images=9))[0][0].images
    assert images == [f"https://www.example.org{x}" for x in ("/big/1.jpg", "/2_xl.jpg", "/3b.webp", "/4.jpg", "/6.jpg")]
    assert len(_cards(spark, _card(body))[0][0].images) == 4


def test_galleries_and_their_notes(spark):
    head = '<head><meta property="og:image" content="/lead.jpg"></head>'
    script = '<script>{"image": ["https://www.example.org/g/9.png", "https://www.example.org/logo/1.png"]}</script>'
    strip = '<ul class="mediaThumbnails"><li><a href="/g/1.jpg"><img src="/g/thumbs/1.jpg"></a></li><li><img src="/g/2.jpg"></li></ul>'
    pages = [
        head + f'<div class="auc_slide left"><img src="/g/1_large.jpg">{strip}</div><img src="/logo.png">',  # a nested container is not read twice
        strip + '<div class="auc_slide left"><img src="/f/0.jpg"></div>',  # by selector, not by place
        strip + script,
        head + script,
        '<ul class="mediaThumbnails"></ul>',
        "<p>none</p>",
        None,
    ]
    got = {r.page_id: (r.images, r.note) for r in P.lot_pages(_pages(spark, *pages)).collect()}
    at = lambda *names: [f"https://www.example.org/{n}.jpg" for n in names]
    assert got[0] == (at("g/1", "g/2"), "") or got[0] == (at("g/1_large", "g/2"), "")
    assert got[1] == (at("f/0", "g/1", "g/2"), "")
    assert got[2] == ([*at("g/1", "g/2"), "https://www.example.org/g/9.png"], "the page data supplied 1 more photograph(s) than the gallery markup held")
    assert got[3] == ([*at("lead"), "https://www.example.org/g/9.png", "https://www.example.org/logo/1.png"], "no gallery container matched — 3 declared image(s) used instead")
    assert got[4] == ([], "the gallery carried no photographs") and got[5] == got[6] == ([], "the page carried no gallery markup")
    assert P.gallery(_pages(spark, *pages)).where("page_id = 1").orderBy("place").collect()[1][1:] == (2, at("g/1")[0])
    many = "".join(f'<img src="/g/{i}.jpg">' for i in range(3000))
    assert P.gallery(_pages(spark, f'<div class="auc_slide left">{many}</div>')).count() == 3000


def test_listings_of_old_style_pages(spark):
    listing = """<body><nav><div class="lot">Lot 99 of the menu</div></nav>
    <div class="lot" id="lotrow12"><a href="/lot/12"><img src="https://cdn.example.org/a/1.jpg"></a><h3 class="title">Mixed tools</h3><b class="bid">$1,250.50</b></div>
    <div class="lot"><h3>Chairs<br>and tables</h3><span class="badge">SOLD</span><img data-src="/b/2.png"></div><div class="lot">x</div></body>"""
    pages = _cards(spark, listing, "<p>No items found</p>", None, "<article>" + "word " * 50_000 + "<p>unclosed", profile=OLD)
    first, second = pages[0]
    assert (first.title, first.bid, first.active, first.detail_url, first.images, first.lot_number) == ("Mixed tools", 1250.5, True, "https://www.example.org/lot/12", ["https://cdn.example.org/a/1.jpg"], "12")
    assert (second.title, second.active, second.images) == ("Chairs and tables", False, ["https://www.example.org/b/2.png"])
    assert [len(c) for c in pages[1:]] == [0, 0, 1] and pages[3][0].selector == "article"


def test_what_says_that_nothing_was_found(spark):
    pages = ["<p>Results: No Items Found.</p>", '<div class="alert">0 results</div>' + _card(), '<div class="alert" style="display: none">0 results</div>' + _card(), f'<div class="empty">no lots {"x" * 250}</div>' + _card(), "<p>No items found</p>" + _card(), "", '<p hidden>x</p><i role="status">Sorry: zero lots available</i>']
    got = {r.page_id: tuple(r)[1:] for r in P.empty_listings(_pages(spark, *pages)).collect()}
    assert got == {0: (0, True, "body", "No Items Found"), 1: (1, True, "[class*='alert' i]", "0 results"), 2: (1, False, "", ""), 3: (1, False, "", ""), 4: (1, False, "", ""), 5: (0, False, "", ""), 6: (0, True, "[role='status']", "Sorry: zero lots available")}


def test_profiles_have_a_row_for_every_page(spark):
    pages = _pages(spark, _card('<a href="/lot/12">x</a>') + _card("<i>sold</i>") + _card('<a href="/login">x</a>'), "<p>No items found</p>", None, "")
    got = {r.page_id: r for r in P.profiles(pages).collect()}
    assert {k: (r.cards, r.linked, r.sold, r.nothing_found) for k, r in got.items()} == {0: (3, 1, 1, False), 1: (0, 0, 0, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False)}
    assert got[0].signature is not None and got[2].signature is None
    assert P.listings(pages.limit(0)).count() == P.lot_pages(pages.limit(0)).count() == 0


def test_descriptions_take_the_first_block_with_text(spark):
    pages = {
        1: '<div class="description">Lot Description: Description - Six  lamps</div>',
        2: '<p class="Item-Description-Box">Aside</p><div class="description"> Description: </div><div class="description">item DESCRIPTION – Chairs</div>',
        3: '<p class="Item-Description-Box">Descriptions of goods</p>',
        4: '<div class="lot-description"><script>x</script></div>',
        5: "",
        6: None,
        7: '<div class="description">' + "word " * 50_000 + "</div>",
    }
    rows = spark.createDataFrame([(k, "https://e.org", html) for k, html in pages.items()], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.selector) for r in P.descriptions(rows, OLD).collect()}
    box = "[class*='description' i]"
    assert got == {1: ("Six lamps", ".description"), 2: ("Chairs", ".description"), 3: ("s of goods", box), 4: ("", ""), 5: ("", ""), 6: ("", ""), 7: (("word " * 50_000).strip(), ".description")}


def _carries(url, number):
    token = re.sub("[^0-9a-zA-Z]", "", number or "").lower()
    if len(token) < 3:
        return False
    parts = [p.lower() for p in re.split("[^0-9a-zA-Z]+", url)]
    return any(p == token or (len(token) >= 5 and token in p and not re.search("[0-9]", p.replace(token, "", 1))) for p in parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_page_wide_links_match_a_look_at_every_link(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ab", "abcde", "7", "12345", "x", "Y", "123", "9"]) for _ in range(rng.randint(1, 4)))
    anchors = [(page, pre, f"http://h/{word()}/{word()}-{word()}?q={word()}") for page in (1, 2, None) for pre in range(1, 120)]
    asked = [(page, i, rng.choice([word(), f"{word()}-{word()}", None, "ab", "abcde"]), [(max(0, i - w), i + w) for w in (1, 5, 30)]) for page in (1, 2, None) for i in range(60)]
    got = {(r.page_id, r.position): r.url for r in page_wide(spark.createDataFrame(asked, "page_id long, position int, number string, scopes array<struct<pre:int,last:int>>"), spark.createDataFrame(anchors, "page_id long, pre int, url string")).collect()}
    want = {}
    for page, i, number, scopes in asked:
        hits = [(next((k + 1 for k, (a, b) in enumerate(scopes) if a < pre <= b), 99), pre, url) for p, pre, url in anchors if p == page and _carries(url, number)]
        if hits:
            want[page, i] = min(hits)[2]
    assert got == want and len(want) > 20


def test_queries_over_pages(spark):
    from tallyforge.plans import listings

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert listings.page_profiles(spark, sf).count() == listings.page_descriptions(spark, sf).count() == listings.page_numbers(spark, sf).count() == listings.page_gallery(spark, sf).count() == n
    cards = listings.listing_cards(spark, sf)
    assert cards.select("page_id").distinct().count() == n and cards.where("lot_number IS NULL or lot_number = ''").count() == 0


@pytest.mark.parametrize("name", ["lot_galleries", "catalogue_profiles"])
def test_rendered_pages_are_read_by_as_many_tasks_as_a_shuffle_has(spark, name):
    from tallyforge.plans import listings

    made = listings.QUERIES[name](spark, "/root/testdata/sf0.001") if name == "lot_galleries" else listings.catalogue(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
