"""Addresses as Column builders: lot numbers, keys, page numbers, image variants."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def lot_number_of(url: Column) -> Column:
    """The last numeric token of path and query, a wrapper undone; null if there is none."""
    tokens = F.concat(F.split(path(url), "/"), F.split(query(url), "[&=]"))
    numbers = F.filter(F.transform(F.reverse(tokens), T.lot_number), lambda t: t.rlike(r"^\p{N}+$"))
    return F.get(numbers, F.lit(0))


def dedupe_key(url: Column, number: Column) -> Column:
    """Host and path of the lot's page, or the number where there is no page."""
    return F.when(host(url) != "", F.concat(host(url), path(url))).otherwise(F.concat(F.lit("number:"), number))


def page_parameter(url: Column) -> Column:
    """The query parameter that numbers pages, in its own spelling; null if there is none."""
    return F.nullif(F.regexp_extract(query(url), r"(?i)(?:^|&)(page|paged|pg)(?:=|&|$)", 1), F.lit(""))


def page_number(url: Column) -> Column:
    """The page that an address asks for: a parameter, else `/page/4` or `/page-4`; null if there is none."""
    asked = [F.nullif(F.regexp_extract(query(url), rf"(?i)(?:^|&){name}=\+*0*([1-9]\d*)(?:&|$)", 1), F.lit("")) for name in ("page", "paged", "pg")]
    folder = F.nullif(F.regexp_extract(path(url), r"(?i)/page(?:/+|-)0*([1-9]\d*)(?:/|$)", 1), F.lit(""))
    return F.coalesce(*asked, folder).try_cast("int")


def page_address(url: Column, page: Column) -> Column:
    """The address of another page: the number replaced, or the parameter added before the fragment."""
    number = page.cast("string")
    base, fragment = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    replaced = F.regexp_replace(base, F.lit(r"(?i)([?&](?:page|paged|pg))(?:=[^&]*)?(?=&|$)"), F.concat(F.lit("$1="), number))
    gap = F.when(base.rlike(r"\?.+"), "&").when(base.endswith("?"), "").otherwise("?")
    return F.concat(F.when(page_parameter(url).isNotNull(), replaced).otherwise(F.concat(base, gap, F.lit("page="), number)), fragment)


#: Addresses that are no page of the web, files that no browser shows as a page, and images.
NO_PAGE = r"(?i)^(?:#|javascript:|mailto:|tel:|data:|blob:)"
ASSET = r"(?i)\.(?:jpe?g|png|gif|webp|heic|avif|bmp|svg|ico|css|js|mjs|json|xml|pdf|zip|mp4|webm|mp3|wav|ogg|woff2?)(?:$|[?#])"
IMAGE = r"(?i)\.(?:jpe?g|png|gif|webp|heic|avif|bmp|tiff?)(?:$|[?#])"
SCRIPT_IMAGE = r"(?i)[\"'](https?://[^\"'\s\\]+\.(?:jpe?g|png|webp|heic|gif)(?:\?[^\"'\s\\]*)?)[\"']"


def is_page_link(href: Column) -> Column:
    """Whether a link may lead to a lot's page: no jump, handler, file or furniture of the site."""
    raw = F.trim(href)
    return (raw != "") & ~raw.rlike(NO_PAGE) & ~raw.rlike(ASSET) & ~raw.rlike(T.NON_LOT_HREF)


def is_image_address(href: str) -> bool:
    """Whether a printed link is an image itself."""
    return re.search(IMAGE, href) is not None


def style_address(style: str) -> str:
    """The address that a style attribute paints with; empty if there is none."""
    found = re.search(r"(?i)url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", style)
    return found[1] if found else ""


def carried(number: Column) -> Column:
    """A lot number as addresses carry it: letters and digits in lower case."""
    return F.lower(F.regexp_replace(number, "[^0-9a-zA-Z]", ""))


def address_tokens(url: Column) -> Column:
    """The runs of letters and digits of an address, in lower case."""
    return F.filter(F.split(F.lower(url), "[^0-9a-z]+"), lambda t: t != "")


def carries_number(url: Column, number: Column) -> Column:
    """Whether one of the address's tokens is the number (3 characters or more), or holds it (5 or more) with no other digit."""
    value = carried(number)
    tokens = address_tokens(url)
    same = F.exists(tokens, lambda t: t == value)
    inside = F.exists(tokens, lambda t: F.contains(t, value) & ~_once(t, value).rlike(r"[0-9]"))
    return (F.length(value) >= 3) & (same | ((F.length(value) >= 5) & inside))


def _once(text: Column, part: Column) -> Column:
    """text without the first occurrence of part."""
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def srcset_weight(descriptor: Column) -> Column:
    """How wide a candidate is: `640w`; density counts a thousand, none 100."""
    width, density = F.regexp_extract(descriptor, r"^(\d+)w$", 1).try_cast("double"), F.regexp_extract(descriptor, r"^(\d+(?:\.\d+)?)x$", 1).try_cast("double")
    return F.coalesce(width, density * 1000, F.lit(100.0))


def best_of_srcset(srcset: Column) -> Column:
    """The candidate of greatest weight; the first of equals, null without any."""
    parts = F.filter(F.transform(F.split(srcset, ","), T.condensed), lambda p: p != "")
    scored = F.transform(parts, lambda p, k: F.struct((-srcset_weight(F.regexp_extract(p, r"^\S+ (\S+)", 1))).alias("w"), k.alias("k"), F.substring_index(p, " ", 1).alias("url")))
    return F.get(F.array_sort(scored), F.lit(0))["url"]


def script_images(text: Column) -> Column:
    """Quoted whole addresses of images in a script, in order."""
    return F.regexp_extract_all(text, F.lit(SCRIPT_IMAGE), F.lit(1))


def image_folder(url: Column) -> Column:
    """What stands before an address's last slash, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"^(.+)/", 1))


def image_mime(declared: Column, url: Column) -> Column:
    """The declared image type (jpg is jpeg), else by the address's ending, else jpeg."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(declared, F.lit("")), ";", 1)))
    ending = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    by_ending = F.when(ending.isin("png", "gif", "webp", "heic", "bmp"), F.concat(F.lit("image/"), ending)).when(ending == "heif", "image/heic").otherwise("image/jpeg")
    return F.when(kind == "image/jpg", "image/jpeg").when(kind.startswith("image/"), kind).otherwise(by_ending)


def page_lot_number_of(url: Column) -> Column:
    """The last token of letters and digits that is a number of at most 12 digits, a wrapper undone; null if there is none."""
    tokens = F.transform(F.reverse(F.split(url, "[^A-Za-z0-9]+")), lambda t: F.coalesce(F.when(t.rlike(r"^[A-Za-z]{1,24}\d{1,12}$"), T.unwrapped(t)), t))
    return F.get(F.filter(tokens, lambda t: t.rlike(r"^\d{1,12}$")), F.lit(0))


def is_auction_address(text: Column) -> Column:
    """Whether a text is an http or https address with a host."""
    return F.coalesce(F.trim(text).rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))
