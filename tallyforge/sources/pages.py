"""Listing and lot pages as tables: cards, galleries, links and page profiles read from HTML by the standard library's parser.

What a page holds is found in Python, one page at a time and whatever the page's size; every rule that judges what was
found is a Column of tallyforge.functions, over arrays that stay in the page's row, so that reading a page needs no
shuffle. Null and empty pages give no cards and no images, and a profile of zeros.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import images as I
from tallyforge.functions import paging as G
from tallyforge.functions import phrases as P
from tallyforge.functions import text as T
from tallyforge.functions import urls as U
from tallyforge.operators.links import page_wide
from tallyforge.scratch import saved
from tallyforge.sources.dom import Node, index, parsed


@dataclass(frozen=True)
class Profile:
    """What to look for on a site's pages: selectors and attributes, the earlier the better. A profile is data: see to_json and of_json.

    The values here are those of the preset for liquidation grids.
    """

    # The preset's selectors, attributes and numbers.
    cards: tuple[str, ...] = (
        "[data-lot-id]", "[data-lot-number]", "[data-item-id]", "[data-lot]",
        "[class*='lot-card']", "[class*='lotCard']", "[class*='lot-item']",
        "[class*='lotItem']", "[class*='lot-tile']", "[class*='pallet-card']",
        "[class*='product-card']", "[class*='productCard']", "[class*='auction-card']",
        "[class*='listing-card']", "[class*='auction-item']", "[class*='card-body']",
        "li[class*='lot']", "article[class*='lot']", "article[class*='card']",
        "[class*='grid'] > [class*='card']", "[class*='grid'] > li",
        "table tbody tr", "[role='row'][data-row-key]", "tr[data-lot-id]",
    )
    exclude: tuple[str, ...] = (
        "nav", "header", "footer", "[class*='advert']", "[class*='banner']",
        "[class*='promo']", "[class*='recommend']", "[class*='related']",
        "[class*='newsletter']", "[class*='cookie']", "[class*='pagination']",
    )
    least_text: int = 12
    signal_attributes: tuple[str, ...] = ("data-lot-id", "data-lotnumber", "data-lot-number", "data-lot", "data-item-id", "data-auction-id")
    number_attributes: tuple[str, ...] = ("data-lot-id", "data-lotnumber", "data-lot-number", "data-lot", "data-item-id", "data-auction-id", "data-id")
    number: tuple[str, ...] = (
        "[class*='lot-id' i]", "[class*='lotnumber' i]", "[class*='lot-number' i]",
        "[class*='item-id' i]", "[class*='sku' i]", "[data-testid*='lot' i]",
        "[aria-label*='lot' i]",
    )
    id_attributes: tuple[str, ...] = ("id", "data-key", "data-row-key", "data-testid")
    title: tuple[str, ...] = (
        "h1", "h2", "h3", "h4", "[class*='title' i]", "[class*='name' i]",
        "[class*='headline' i]", "[itemprop='name']", "[data-testid*='title' i]", "a[title]",
    )
    card_description: tuple[str, ...] = (
        "[class*='description' i]", "[class*='desc' i]", "[class*='subtitle' i]",
        "[class*='sub-title' i]", "[class*='detail' i]", "[class*='brand' i]",
        "[class*='condition' i]", "p",
    )
    bid: tuple[str, ...] = (
        "[class*='current-bid' i]", "[class*='currentbid' i]", "[class*='current_bid' i]",
        "[class*='bid-amount' i]", "[class*='bid' i]", "[class*='high-bid' i]",
        "[class*='price' i]", "[class*='amount' i]", "[data-testid*='bid' i]",
        "[itemprop='price']", "strong", "b",
    )
    bid_attributes: tuple[str, ...] = ("data-bid", "data-current-bid", "data-price", "data-amount", "content", "value")
    status: tuple[str, ...] = (
        "[class*='sold' i]", "[class*='lot-status' i]", "[class*='lotstatus' i]",
        "[class*='lot-state' i]", "[class*='item-status' i]", "[class*='status' i]",
        "[class*='badge' i]", "[data-status]", "[data-lot-status]", "[data-state]",
        "[aria-label*='sold' i]",
    )
    status_attributes: tuple[str, ...] = ("data-status", "data-lot-status", "data-state", "aria-label")
    links: tuple[str, ...] = (
        "[class*='lot-link' i]", "[class*='lotlink' i]", "[class*='card-link' i]",
        "[class*='detail-link' i]", "[class*='detaillink' i]", "[class*='item-link' i]",
        "a[href*='/lot/' i]", "a[href*='/lots/' i]", "a[href*='/item/' i]",
        "a[href*='/items/' i]", "a[href*='/listing/' i]", "a[href*='/product/' i]",
        "a[href*='/auction/' i]",
    )
    image_attributes: tuple[str, ...] = (
        "src", "data-src", "data-original", "data-lazy-src", "data-lazy", "data-image",
        "data-image-url", "data-img", "data-thumb", "data-large_image", "data-zoom-image",
        "data-srcset", "srcset",
    )
    most_images: int = 4
    declared: tuple[str, ...] = (
        "meta[property='og:image']", "meta[property='og:image:secure_url']",
        "meta[name='twitter:image']", "meta[property='twitter:image']",
        "link[rel='image_src']",
    )
    description: tuple[str, ...] = (
        "div.active.ins_cnt.description-info-content",
        "div.ins_cnt.description-info-content",
        "[class*='description-info-content' i]",
        "div.auc_info.right",
        "[class*='auc_info' i]",
    )
    gallery: tuple[str, ...] = ("div.auc_slide.left", "ul.mediaThumbnails", "[class*='mediaThumbnails' i]")
    nothing: tuple[str, ...] = (
        "[class*='no-results' i]", "[class*='noresult' i]", "[class*='noresults' i]",
        "[class*='no-items' i]", "[class*='noitems' i]", "[class*='no-lots' i]",
        "[class*='nolots' i]", "[class*='empty' i]", "[class*='not-found' i]",
        "[class*='notfound' i]", "[class*='zero-results' i]", "[id*='no-results' i]",
        "[class*='alert' i]", "[role='status']", "[role='alert']",
    )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of_json(cls, text: str) -> Profile:
        """The profile of a JSON object; what it does not name is the preset's, names that no profile has are passed over."""
        have, found = {f.name for f in fields(cls)}, json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in have})


PRESET = Profile()

#: Pages that print an article each and no catalogue: the article is the card, headings and bold words its fields.
ARTICLES = Profile(cards=(*PRESET.cards, "article"), description=(*PRESET.description, "article"))


def absolute(link: str, base: str | None) -> str | None:
    """The whole http(s) address of a link; null for anything else."""
    link = link.strip().strip("'\"").strip()
    if not link or link.split(":", 1)[0].lower() in ("data", "blob", "javascript", "mailto", "tel"):
        return None
    try:
        found = urljoin(base or "", link)
    except ValueError:
        return None
    return found if found.startswith(("http://", "https://")) else None


def _table(pages: DataFrame, rows_of: Callable[[int, str | None, str | None], list[dict]], schema: str) -> DataFrame:
    """Rows of every page (page_id, url, html); a page never leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [r for p in batch.slice(at, 64).to_pylist() for r in rows_of(p["page_id"], p["url"], p["html"])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spark = pages.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


# ------------------------------------------------------------------ photographs

#: What an element offers: addresses (raw as printed, url whole) by attribute, the descriptor that a srcset gives one, and what the attribute says of its size.
OFFER = "array<struct<attribute int, raw string, url string, descriptor string, hint string>>"
ELEMENTS = f"array<struct<pre int, slot boolean, offers {OFFER}>>"


def _offers(node: Node, attributes: tuple[str, ...], base: str | None, at: int = 0) -> list[dict]:
    out = []
    for k, name in enumerate(attributes):
        value = node.attributes.get(name, "")
        if not value:
            continue
        low = name.lower()
        hint = "srcset" if "srcset" in low else "large" if any(w in low for w in ("large", "full", "orig", "zoom", "big", "max", "hires", "highres")) else ""
        tokens = [x.split() for x in value.split(",") if x.strip()] if hint == "srcset" else [[value]]
        out += [{"attribute": at + k, "raw": t[0], "url": absolute(t[0], base), "descriptor": t[1] if len(t) > 1 else "", "hint": hint} for t in tokens]
    return out


def photographs(root: Node, profile: Profile, base: str | None) -> list[dict]:
    """ELEMENTS below root in document order: each is one photograph, and offers the addresses that it may be read from."""
    out, pictures, slots = [], [], []
    within = lambda node, parts: any(a < node.pre <= b for a, b in parts)
    for node in root.walk():
        offers: list[dict] = []
        if node.tag == "a" and "href" in node.attributes:
            href = node.attributes["href"]
            if not U.is_image_address(href):
                continue
            slots.append((node.pre, node.last))
            offers = [{"attribute": 0, "raw": href, "url": absolute(href, base), "descriptor": "", "hint": "opened"}]
            for k, inner in enumerate(n for n in node.walk() if n.tag == "img"):
                offers += _offers(inner, profile.image_attributes, base, 1 + k * len(profile.image_attributes))
        elif node.tag == "img":
            if within(node, slots) or within(node, pictures):
                continue
            offers = _offers(node, profile.image_attributes, base)
        elif node.tag == "picture":
            pictures.append((node.pre, node.last))
            inner = [n for n in node.walk() if n.tag == "source" and ("srcset" in n.attributes or "data-srcset" in n.attributes)]
            for k, source in enumerate(inner):
                offers += _offers(source, ("srcset",) if source.attributes.get("srcset") else ("data-srcset",), base, k)
            for k, image in enumerate(n for n in node.walk() if n.tag == "img"):
                offers += _offers(image, profile.image_attributes, base, len(inner) + k * len(profile.image_attributes))
        elif node.tag == "source" and not within(node, pictures):
            offers = _offers(node, ("srcset",) if node.attributes.get("srcset") else ("data-srcset",), base)
        elif "background" in node.attributes.get("style", ""):
            found = U.style_address(node.attributes["style"])
            offers = [{"attribute": 0, "raw": found, "url": absolute(found, base), "descriptor": "", "hint": ""}] if found else []
        if offers:
            out.append({"pre": node.pre, "slot": node.tag == "a", "offers": offers})
    return out


def best_offer(offers: Column) -> Column:
    """The address that an element is read by: of a srcset the widest candidate, then the attribute that promises most; of equals the first."""
    weight = lambda o: F.when(o["hint"] != "srcset", 0.0).otherwise(U.srcset_weight(o["descriptor"]))
    weighed = F.transform(offers, lambda o, k: F.struct(o["attribute"].alias("attribute"), (-weight(o)).alias("w"), k.alias("k"), o["raw"].alias("raw"), o["url"].alias("url"), o["hint"].alias("hint")))
    widest = F.get(F.transform(F.array(F.array_sort(weighed)), lambda w: F.filter(w, lambda o, k: (k == 0) | (F.get(w, k - 1)["attribute"] != o["attribute"]))), F.lit(0))
    scored = F.transform(widest, lambda o: F.struct((-I.score(o["raw"], I.full_size(o["url"]), o["hint"])).alias("s"), o["attribute"].alias("attribute"), o["raw"].alias("raw"), o["url"].alias("url"), o["hint"].alias("hint")))
    return F.get(F.array_sort(F.filter(scored, lambda o: o["s"].isNotNull())), F.lit(0))


def photo_list(found: Column) -> Column:
    """Whole addresses of an array of (raw, url, hint): one for each photograph in order of its first place, by its best copy; junk and null addresses give none."""
    whole = F.transform(found, lambda p, k: F.struct(I.full_size(p["url"]).alias("whole"), p["raw"].alias("raw"), p["hint"].alias("hint"), k.alias("k")))
    usable = F.filter(whole, lambda p: F.coalesce(p["whole"].isNotNull() & ~I.is_junk(p["whole"]), F.lit(False)))
    named = F.transform(usable, lambda p: F.struct(I.identity(p["whole"]).alias("identity"), (-I.score(p["raw"], p["whole"], p["hint"])).alias("s"), p["k"].alias("k"), p["whole"].alias("url")))
    one = lambda rows: F.filter(rows, lambda p, i: (i == 0) | (F.get(rows, i - 1)["identity"] != p["identity"]))
    bound = lambda rows: F.get(F.transform(F.array(F.array_sort(rows)), one), F.lit(0))  # noqa: E731  sorted once
    best = bound(named)
    first = bound(F.transform(named, lambda p: F.struct(p["identity"].alias("identity"), p["k"].alias("first"))))
    both = F.zip_with(best, first, lambda b, f: F.struct(f["first"].alias("first"), b["url"].alias("url")))
    return F.transform(F.array_sort(both), lambda p: p["url"])


def element_photos(elements: Column) -> Column:
    """photo_list of ELEMENTS, each by its best offer."""
    read = F.filter(F.transform(elements, lambda e: best_offer(e["offers"])), lambda o: o.isNotNull())
    return photo_list(F.transform(read, lambda o: F.struct(o["raw"].alias("raw"), o["url"].alias("url"), o["hint"].alias("hint"))))


# ------------------------------------------------------------------ cards

LINK = "struct<pre int, href string, url string>"
CARD = (
    "selector string, pre int, text string, number_attribute string, holder_attribute string, holder_text string, id_attribute string, "
    "title_text string, title_attribute string, anchor_title string, description_text string, bid_attribute string, bid_text string, "
    f"statuses array<string>, status_attribute string, named {LINK}, own array<{LINK}>, around array<{LINK}>, scopes array<struct<pre int, last int>>, elements {ELEMENTS}"
)
FOUND = f"page_id long, cards array<struct<{CARD}>>, anchors array<{LINK}>"


def _link(node: Node, base: str | None) -> dict:
    href = node.attributes.get("href", "")
    return {"pre": node.pre, "href": href, "url": absolute(href, base)}


def _card_nodes(root: Node, profile: Profile) -> tuple[str, list[Node]]:
    """The earliest selector with a card, and its cards: hits outside of excluded parts with text or a sign of a lot on them."""
    hits: list[list[Node]] = [[] for _ in profile.cards]
    best, every = len(profile.cards), index(profile.cards)
    for node in root.walk():
        for rank in every.ranks(node):
            if rank > best:
                break
            if node.matches(profile.cards[rank]) and carries_signal(node, profile) and not node.inside(profile.exclude):
                hits[rank].append(node)
                best = min(best, rank)
    return (profile.cards[best], hits[best]) if best < len(profile.cards) else ("", [])


def carries_signal(node: Node, profile: Profile) -> bool:
    """Whether a hit is a lot at all: enough text, an attribute of lots, or an element id that is a known word and digits."""
    return len(node.text()) >= profile.least_text or bool(node.attribute(profile.signal_attributes)) or any(T.is_wrapped_id(node.attributes.get(a, "")) for a in profile.id_attributes)


def found(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """FOUND of every page: the cards with all that their fields may be read from, and the page's links."""

    def rows_of(page_id: int, url: str | None, html: str | None) -> list[dict]:
        root = parsed(html)
        selector, nodes = _card_nodes(root, profile)
        cards = []
        for card in nodes:
            text = lambda node: node.text() if node is not None else ""
            holder, bid = card.first(profile.number), card.first(profile.bid)
            titled, named = card.first(("a[title]", "a[aria-label]")), card.first(profile.links)
            outer = [*card.ancestors()][:4]
            statuses = [t for _, n in card.ranked(profile.status) if 0 < len(t := n.text()) <= 32]
            cards.append(
                {
                    "selector": selector, "pre": card.pre, "text": card.text(),
                    "number_attribute": card.attribute(profile.number_attributes),
                    "holder_attribute": holder.attribute(profile.number_attributes) if holder is not None else "", "holder_text": text(holder),
                    "id_attribute": card.attribute(profile.id_attributes),
                    "title_text": text(card.first(profile.title)), "title_attribute": card.attribute(("aria-label", "title", "data-title")),
                    "anchor_title": titled.attribute(("title", "aria-label")) if titled is not None else "",
                    "description_text": text(card.first(profile.card_description)),
                    "bid_attribute": bid.attribute(profile.bid_attributes) if bid is not None else "", "bid_text": text(bid),
                    "statuses": statuses, "status_attribute": card.attribute(profile.status_attributes),
                    "named": _link(named, url) if named is not None and "href" in named.attributes else None,
                    "own": [_link(a, url) for a in card.walk() if a.tag == "a" and "href" in a.attributes],
                    "around": [_link(a, url) for a in outer[:3] if a.tag == "a" and "href" in a.attributes],
                    "scopes": [{"pre": a.pre, "last": a.last} for a in outer], "elements": photographs(card, profile, url),
                }
            )
        anchors = [_link(a, url) for a in root.walk() if a.tag == "a" and "href" in a.attributes] if cards else []
        return [{"page_id": page_id, "cards": cards, "anchors": anchors}]

    return _table(pages, rows_of, FOUND)


def _first_usable(links: Column) -> Column:
    return F.get(F.filter(links, lambda a: F.coalesce(U.is_page_link(a["href"]), F.lit(False)) & a["url"].isNotNull()), F.lit(0))["url"]


def _carrying(links: Column, number: Column) -> Column:
    return _first_usable(F.filter(links, lambda a: F.coalesce(U.carries_number(a["url"], number), F.lit(False))))


CARD_COLUMNS = ("page_id", "position", "selector", "lot_number", "title", "description", "bid_text", "bid", "active", "status", "detail_url", "images")


def cards(read: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """CARD_COLUMNS (lot_number empty where nothing names one) and scopes, of found(): each field by its ordered fallbacks.

    Number: the card's attribute, its number element's attribute or text, the card's words, the address, the element id.
    Link: the named one, the card's own, one that the card is in; detail_url is null where only a search of the page can tell.
    Cards without title, number and photographs give no row.
    """
    c = read.select("page_id", F.posexplode("cards").alias("position", "c")).select("page_id", "position", "c.*")
    some = lambda *cols: F.coalesce(*(F.nullif(x, F.lit("")) for x in cols), F.lit(""))
    named = F.when(F.coalesce(U.is_page_link(F.col("named.href")), F.lit(False)), F.col("named.url"))
    around = F.get(F.filter("around", lambda a: F.coalesce(U.is_page_link(a["href"]), F.lit(False)) & a["url"].isNotNull()), F.lit(0))
    c = c.withColumn("named_url", named).withColumn("near_url", F.coalesce(named, _first_usable(F.col("own")), around["url"]))
    printed = F.when(F.length("number_attribute") <= 60, F.col("number_attribute")).otherwise("")
    c = c.withColumn("read_number", T.read_number(some(printed, F.col("holder_attribute"), F.col("holder_text")), F.col("text")))
    by_address = F.coalesce(U.page_lot_number_of(F.coalesce("near_url", F.get("own", F.lit(0))["url"])), F.lit(""))
    by_id = some(F.coalesce(T.wrapped_digits(F.col("id_attribute")), F.lit("")), T.read_number(F.col("id_attribute"), F.lit("")))
    c = c.withColumn("lot_number", F.substring(some(F.col("read_number"), by_address, by_id), 1, 60))
    title, description = some(F.col("title_text"), F.col("title_attribute"), F.col("anchor_title")), some(F.col("description_text"), F.substring("text", 1, 300))
    bid = some(F.col("bid_attribute"), F.col("bid_text"), F.regexp_extract("text", T.BID_WORDS, 0))
    badge = F.get(F.filter("statuses", T.is_sold), F.lit(0))
    marked = (F.length("status_attribute") <= 32) & T.is_sold(F.col("status_attribute"))
    sold = badge.isNotNull() | marked | T.is_sold(F.col("text"))
    out = c.select(
        "page_id", "position", "selector", "lot_number",
        F.substring(some(title, description), 1, 300).alias("title"),
        F.substring(some(description, title), 1, 600).alias("description"),
        F.substring(bid, 1, 80).alias("bid_text"), T.first_price(F.substring(bid, 1, 80)).alias("bid"),
        (~sold).alias("active"), F.substring(F.coalesce(badge, F.when(marked, F.col("status_attribute")), F.lit("")), 1, 40).alias("status"),
        F.coalesce("named_url", F.when(F.col("lot_number") != "", _carrying(F.col("own"), F.col("lot_number"))), _first_usable(F.col("own"))).alias("detail_url"),
        F.slice(element_photos(F.col("elements")), 1, max(1, profile.most_images)).alias("images"),
        "scopes", around["url"].alias("around_url"), around["pre"].alias("around_pre"),
    )
    return out.where((F.col("title") != "") | (F.col("lot_number") != "") | (F.size("images") > 0))


def listings(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """CARD_COLUMNS of listing pages, every card with a number, and with a link where the page has one.

    A card that is no link itself takes, once its number is known, the link that it lies in or the first link around it
    that carries the number, whichever level comes first, else the first on the page (operators.links.page_wide). A card that names no
    number takes one of its first photograph's address or its words.
    """
    read = saved(found(pages, profile), "found-cards")
    known = saved(cards(read, profile), "cards")  # read twice below
    lost = known.where("detail_url is null").select("page_id", "position", F.col("lot_number").alias("number"), "scopes", "around_url", "around_pre")
    anchors = read.select("page_id", F.explode("anchors").alias("a")).select("page_id", "a.pre", "a.url", "a.href").where(F.coalesce(U.is_page_link(F.col("href")), F.lit(False)) & F.col("url").isNotNull()).drop("href")
    linked = page_wide(lost, anchors).select(F.col("page_id").alias("l_page"), F.col("position").alias("l_position"), F.col("url").alias("l_url"))
    joined = known.join(linked, F.col("page_id").eqNullSafe(F.col("l_page")) & (F.col("position") == F.col("l_position")), "left")
    number = F.when(F.col("lot_number") == "", T.fallback_number(F.get("images", F.lit(0)), F.col("description"))).otherwise(F.col("lot_number"))
    changed = {"lot_number": number, "detail_url": F.coalesce("detail_url", "l_url", "around_url")}
    return joined.select(*(changed.get(x, F.col(x)).alias(x) for x in CARD_COLUMNS))


# ------------------------------------------------------------------ lot pages

ADDRESS = "struct<raw string, url string>"
PAGE = f"page_id long, containers array<struct<pre int, last int>>, elements {ELEMENTS}, declared array<{ADDRESS}>, script string, blocks array<struct<selector string, text string>>"


def lot_pages(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """(page_id, images, note, description, description_selector): each lot page's own photographs and words; never fails.

    Photographs: those in the gallery containers, which count by their selector and place and are passed over inside one
    that has been read, then addresses from scripts that share a folder with them; without any, what the page declares and
    its scripts name. The note tells which, or why there are none.
    """

    def rows_of(page_id: int, url: str | None, html: str | None) -> list[dict]:
        root = parsed(html)
        containers = [{"pre": n.pre, "last": n.last} for _, n in root.ranked(profile.gallery)]
        declared = [{"raw": x, "url": absolute(x, url)} for _, n in root.ranked(profile.declared) if (x := n.attribute(("content", "href")))]
        script = "\n".join("".join(c for c in n.children if isinstance(c, str)) for n in root.walk() if n.tag == "script")
        blocks = [{"selector": profile.description[r], "text": t} for r, n in root.ranked(profile.description) if (t := n.text())]
        return [{"page_id": page_id, "containers": containers, "elements": photographs(root, profile, url) if containers else [], "declared": declared, "script": script, "blocks": blocks}]

    page = _table(pages, rows_of, PAGE)
    # an interval holds another where it holds its first number
    kept = F.filter("containers", lambda c, i: ~F.exists(F.slice("containers", 1, i), lambda v: (v["pre"] <= c["pre"]) & (c["pre"] <= v["last"])))
    inside = F.flatten(F.transform(kept, lambda c: F.filter("elements", lambda e: (e["pre"] > c["pre"]) & (e["pre"] <= c["last"]))))
    read = F.filter(F.transform(inside, lambda e: best_offer(e["offers"])), lambda o: o.isNotNull())
    own = F.transform(read, lambda o: F.struct(o["raw"].alias("raw"), o["url"].alias("url"), o["hint"].alias("hint")))
    scripted = F.transform(U.script_images(F.col("script")), lambda x: F.struct(x.alias("raw"), x.alias("url"), F.lit("").alias("hint")))
    page = page.select("page_id", "containers", "declared", "blocks", own.alias("own"), scripted.alias("scripted"))
    page = page.withColumn("shown", photo_list(F.col("own"))).withColumn("folders", F.transform("shown", U.image_folder))
    siblings = F.filter("scripted", lambda p: F.array_contains("folders", U.image_folder(p["url"])) & (U.image_folder(p["url"]) != ""))
    declared = F.transform("declared", lambda p: F.struct(p["raw"].alias("raw"), p["url"].alias("url"), F.lit("").alias("hint")))
    page = page.withColumn("whole", F.when(F.size("shown") > 0, photo_list(F.concat("own", siblings))).otherwise(photo_list(F.concat(declared, "scripted"))))
    more = F.size("whole") - F.size("shown")
    note = (
        F.when((F.size("shown") > 0) & (more > 0), F.concat(F.lit("the page data supplied "), more, F.lit(" more photograph(s) than the gallery markup held")))
        .when(F.size("shown") > 0, "")
        .when(F.size("whole") > 0, F.concat(F.lit("no gallery container matched — "), F.size("whole"), F.lit(" declared image(s) used instead")))
        .when(F.size("containers") > 0, "the gallery carried no photographs")
        .otherwise("the page carried no gallery markup")
    )
    told = F.transform("blocks", lambda b: F.struct(P.without_heading(b["text"]).alias("text"), b["selector"].alias("selector")))
    first = F.get(F.filter(told, lambda b: b["text"] != ""), F.lit(0))
    empty = F.lit("")
    return page.select("page_id", F.col("whole").alias("images"), note.alias("note"), F.coalesce(first["text"], empty).alias("description"), F.coalesce(first["selector"], empty).alias("description_selector"))


def gallery(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """(page_id, place, url) of lot_pages."""
    return lot_pages(pages, profile).select("page_id", F.posexplode("images").alias("place", "url")).withColumn("place", F.col("place") + 1)


def descriptions(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """(page_id, text, selector) of every page: of the selectors in order, the first element with text beside its heading; both empty without any."""
    return lot_pages(pages, profile).select("page_id", F.col("description").alias("text"), F.col("description_selector").alias("selector"))


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): what a reader of each page sees."""
    return _table(pages, lambda page_id, url, html: [{"page_id": page_id, "text": parsed(html).text()}], "page_id long, text string")


def empty_listings(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """(page_id, cards, present, selector, said): whether a page says that nothing was found.

    A surface made for it says so, visible and with at most 240 characters, whatever the cards; the page's own words only where there are no cards.
    """

    def rows_of(page_id: int, url: str | None, html: str | None) -> list[dict]:
        root = parsed(html)
        hidden = lambda n: any("hidden" in x.attributes or "display:none" in x.attributes.get("style", "").replace(" ", "").lower() for x in (n, *n.ancestors()))
        surfaces = [{"selector": profile.nothing[r], "text": t} for r, n in root.ranked(profile.nothing) if 0 < len(t := n.text()) <= 240 and not hidden(n)]
        n = len(_card_nodes(root, profile)[1])
        return [{"page_id": page_id, "cards": n, "surfaces": surfaces, "text": "" if n else root.text()}]

    page = _table(pages, rows_of, "page_id long, cards int, surfaces array<struct<selector string, text string>>, text string")
    surface = F.get(F.filter("surfaces", lambda s: T.is_empty_listing(s["text"])), F.lit(0))
    words = F.when(F.col("cards") == 0, F.nullif(F.regexp_extract("text", T.NO_RESULTS, 0), F.lit("")))
    return page.select(
        "page_id", "cards", (surface.isNotNull() | words.isNotNull()).alias("present"),
        F.when(surface.isNotNull(), surface["selector"]).when(words.isNotNull(), "body").otherwise("").alias("selector"),
        F.substring(F.coalesce(surface["text"], words, F.lit("")), 1, 120).alias("said"),
    )


LINKS = "page_id long, seq int, href string, url string, label string, rel string, in_pager boolean"
PAGERS = ("[class*='pagination' i]", "[class*='pager' i]", "nav[aria-label*='pagination' i]")


def links(pages: DataFrame) -> DataFrame:
    """LINKS of every page in document order, with the words that name them and whether they are in a pager."""

    def rows_of(page_id: int, url: str | None, html: str | None) -> list[dict]:
        out = []
        for n, a in enumerate(x for x in parsed(html).walk() if x.tag == "a" and "href" in x.attributes):
            named = " ".join(a.attributes.get(k, "") for k in ("aria-label", "title", "rel", "data-testid", "value", "name"))
            out.append({"page_id": page_id, "seq": n, "href": a.attributes["href"], "url": absolute(a.attributes["href"], url), "label": f"{a.text()} {named}".strip(), "rel": a.attributes.get("rel", ""), "in_pager": a.inside(PAGERS)})
        return out

    return _table(pages, rows_of, LINKS)


def page_counts(pages: DataFrame) -> DataFrame:
    """(page_id, pages, parameter, has_next, source): how many pages a listing has, by numbered links in a pager, any numbered links, or its text; null where nothing says so."""
    numbered = links(pages).select("page_id", "in_pager", G.linked_page(F.col("href")).alias("n"), G.linked_parameter(F.col("href")).alias("parameter"), G.is_step(F.col("label"), F.col("rel")).alias("step"), G.looks_like_next(F.col("label"), F.col("rel")).alias("next"), "seq")
    counts = ~F.col("step") & (F.col("n") > 0) & (F.col("n") <= G.CEILING)
    best = lambda where: F.max(F.when(where, F.struct("n", (-F.col("seq")).alias("s"), "parameter")))
    per = numbered.groupBy("page_id").agg(best(counts & F.col("in_pager")).alias("p"), best(counts).alias("a"), F.bool_or("next").alias("has_next"))
    joined = visible_text(pages).join(per, "page_id", "left")
    found = F.when(F.col("p.n") > 1, F.col("p")).when(F.col("a.n") > 1, F.col("a"))
    said = G.pages_in_text(F.col("text"))
    source = F.when(F.col("p.n") > 1, "pager").when(F.col("a.n") > 1, "links").when(said.isNotNull(), "text").when(F.col("has_next"), "next control").otherwise("nothing")
    return joined.select("page_id", F.coalesce(found["n"], said).alias("pages"), found["parameter"].alias("parameter"), F.coalesce("has_next", F.lit(False)).alias("has_next"), source.alias("source"))


def page_link(pages: DataFrame, wanted: int) -> DataFrame:
    """(page_id, link): the first link of each page to page number wanted of the same listing."""
    rows = links(pages).join(pages.select("page_id", F.col("url").alias("page")), "page_id").where((G.linked_page(F.col("href")) == wanted) & ~F.col("href").startswith("#") & G.same_listing(F.col("url"), F.col("page")))
    return rows.groupBy("page_id").agg(F.min_by("url", "seq").alias("link"))


def profiles(pages: DataFrame, profile: Profile = PRESET) -> DataFrame:
    """One row per page: cards, links among them, sold ones, whether it says that nothing was found, and a signature of its first three cards."""
    c = found(pages, profile)
    usable = lambda links: F.exists(links, lambda a: F.coalesce(U.is_page_link(a["href"]), F.lit(False)) & a["url"].isNotNull())
    own = F.transform("cards", lambda x: F.slice(F.filter(F.transform(x["elements"], lambda e: F.get(e["offers"], F.lit(0))["url"]), lambda u: u.isNotNull()), 1, 2))
    head = F.transform(F.slice(F.arrays_zip(F.transform("cards", lambda x: x["text"]).alias("t"), own.alias("i")), 1, 3), lambda x: F.concat(F.substring(x["t"], 1, 140), F.lit("|"), F.array_join(x["i"], ",")))
    per = c.select(
        "page_id", F.size("cards").alias("cards"), F.size(F.filter("cards", lambda x: usable(x["own"]))).alias("linked"), F.size(F.filter("cards", lambda x: T.is_sold(x["text"]))).alias("sold"),
        F.when(F.size("cards") > 0, T.fnv32(F.array_join(head, "~"))).alias("signature"),
    )
    said = empty_listings(pages, profile).select("page_id", F.col("present").alias("nothing_found"))
    return per.join(said, per["page_id"].eqNullSafe(said["page_id"])).select(per["page_id"], "cards", "linked", "sold", "signature", "nothing_found")
