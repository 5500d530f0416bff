"""Page links and page counts as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import urls as U

#: How addresses number pages, which labels are steps, the highest number that counts.
PARAMETER = r"(?i)[?&](page|paged|pg)(?:\[\])?=(\d{1,7})"
FOLDER = r"(?i)/page[/-](\d{1,7})(?:[/?#]|$)"
BACK = r"(?:prev|previous|back|first|last|start|«|‹|←)"
FORWARD = r"(?:next|more|load|show|view)|[›»→]"
STEP = r"(?:prev|previous|next|first|last|back)"
CEILING = 200


def linked_page(address: Column) -> Column:
    """The page that a link asks for, 0 for none."""
    return F.coalesce(F.regexp_extract(address, PARAMETER, 2).try_cast("int"), F.regexp_extract(address, FOLDER, 1).try_cast("int"), F.lit(0))


def linked_parameter(address: Column) -> Column:
    """The lower-case parameter that numbers pages in a link; null for none."""
    return F.nullif(F.lower(F.regexp_extract(address, PARAMETER, 1)), F.lit(""))


def listing_path(path: Column) -> Column:
    """A path without its page part and a slash at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"/page(?:[/-]\d{1,7})?/?$", ""), "/$", "")


def same_listing(address: Column, page: Column) -> Column:
    """Whether two addresses are pages of one listing."""
    return listing_path(U.path(address)) == listing_path(U.path(page))


def looks_like_next(label: Column, rel: Column) -> Column:
    """Whether a control leads on: by rel, else by its label, in which words that lead back win."""
    low = F.lower(label)
    return (F.lower(rel) == "next") | (~low.rlike(BACK) & low.rlike(FORWARD))


def is_step(label: Column, rel: Column) -> Column:
    """Whether a link steps through pages and does not number one."""
    return F.lower(rel).isin("next", "prev", "previous") | looks_like_next(label, rel) | F.lower(label).rlike(STEP)


def _clamped(pages: Column) -> Column:
    return F.when(pages >= 1, F.least(pages, F.lit(CEILING)))


def pages_in_text(text: Column) -> Column:
    """A page count that the text names, as `page 1 of 7` or `of 7 pages`, else by the range of shown items; null for none."""
    named = F.coalesce(F.regexp_extract(text, r"(?i)\bpage\s+\d{1,4}\s*(?:of|/)\s*(\d{1,4})\b", 1).try_cast("int"), F.regexp_extract(text, r"(?i)\bof\s+(\d{1,4})\s+pages?\b", 1).try_cast("int"))
    item = r"(?i)\b(\d{1,4})\s*[-–]\s*(\d{1,4})\s+of\s+([\d,]{1,9})\b"
    first, last, total = (F.regexp_replace(F.regexp_extract(text, item, k), ",", "").try_cast("int") for k in (1, 2, 3))
    size = last - first + 1
    return F.coalesce(_clamped(named), _clamped(F.when((size > 0) & (total > 0), F.ceil(total / size)).cast("int")))
