"""Image addresses as Column builders: full-size form, identity across variants, score, junk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only size an image; folder and file words of small and large variants; junk.
SIZE_PARAMETERS = ("width", "w", "height", "h", "size", "quality", "q", "fit", "resize", "crop", "dpr", "auto", "format", "thumbnail")
SMALL_FOLDERS = r"/(?:thumb|thumbs|thumbnail|thumbnails|small|mini)/"
FULL_ENDING = r"(?=\.(?:jpe?g|png|webp|gif|heic))"
VARIANT_FOLDERS = r"/(?:thumbnails?|thumbs?|small|sm|mini|medium|md|previews?|resized?|resize|cache|large|big|full|original|orig|zoom|xl|xlarge|hires|highres|display)/"
VARIANT_ENDINGS = (r"@\d+x", r"[_-]\d{2,4}x\d{2,4}", r"[_-](?:thumbnails?|thumbs?|small|sm|mini|medium|md|previews?|large|big|full|orig|original|zoom|xl)")
SIZE_CODES = r"(\d)[_-](?:xxs|xs|sm|md|med|lg|x{1,2}l|[smlt])(?=\.[a-z0-9]+$)"
LARGE_WORDS = r"(?i)(?:^|[/_.-])(?:large|full|original|orig|big|zoom|xl|xlarge|hires|highres|max)(?=[/_.-]|$)"
SMALL_WORDS = r"(?i)(?:^|[/_.-])(?:thumbnails?|thumbs?|small|sm|mini|medium|md|previews?)(?=[/_.-]|$)"
JUNK = r"(?i)placeholder|spacer|blank\.|1x1|pixel\.(?:gif|png)|loading|spinner|no[-_]?image|sprite|watermark|\.svg(?:$|[?#])|(?:^|[/_.-])(?:arrow|chevron|caret|prev|next|close|expand|collapse|magnify|magnifier|icon|nav|button|btn|zoom[-_](?:in|out|icon))(?:[/_.-]|$)"


def _once(text: Column, pattern: str, by: str) -> Column:
    """text with the first match replaced."""
    return F.regexp_replace(text, rf"(?is)^(.*?)(?:{pattern})", "$1" + by)


def full_size(url: Column) -> Column:
    """The address without sizes: parameters, folders of thumbnails and endings of small variants."""
    base, query, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*SIZE_PARAMETERS)), "&")
    out = F.concat(base, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment)
    out = _once(out, SMALL_FOLDERS, "/large/")
    out = _once(out, r"[_-]thumb(?:nail)?(?=\.)", "")
    out = _once(out, r"[_-]\d{2,4}x\d{2,4}" + FULL_ENDING, "")
    return _once(out, "[_-](?:small|sm|md|medium|preview|listing)" + FULL_ENDING, "")


def identity(url: Column) -> Column:
    """What all variants of one photograph have in common."""
    out = F.regexp_replace(F.regexp_extract(F.lower(url), r"^([^?#]*)", 1), VARIANT_FOLDERS, "/")
    for ending in VARIANT_ENDINGS:
        out = F.regexp_replace(out, ending + r"(?=\.[a-z0-9]+$)", "")
    return F.regexp_replace(out, SIZE_CODES, "$1")


def score(printed: Column, whole: Column, hint: Column) -> Column:
    """How large a variant promises to be: where it was found, what its words say, the pixels that it names (4000 at most)."""
    both = F.concat_ws(" ", printed, whole)
    pixels = lambda pattern, k: F.coalesce(F.regexp_extract(whole, pattern, k).try_cast("int"), F.lit(0))
    box = r"(?:/|=|-|_)(\d{2,4})x(\d{2,4})(?:[./?&]|$)"
    found = F.when(hint == "opened", 300).when(hint == "large", 200).when(hint == "srcset", 100).otherwise(0)
    words = F.when(both.rlike(LARGE_WORDS), 150).otherwise(0) - F.when(both.rlike(SMALL_WORDS), 100).otherwise(0)
    named = F.least(F.greatest(pixels(box, 1), pixels(box, 2)), F.lit(4000)) + F.least(pixels(r"(?i)[?&](?:w|width)=(\d{1,5})", 1), F.lit(4000))
    return found + words + named


def is_junk(url: Column) -> Column:
    """Whether an address is of a page's furniture and no photograph."""
    return url.rlike(JUNK)


def validity(url: Column, status: Column, content_type: Column, n_bytes: Column, most: int = 6_000_000) -> Column:
    """Why a downloaded image is of no use; null where it is."""
    return (
        F.when(~F.coalesce(url.rlike(r"(?i)^https?://[^/?#]"), F.lit(False)), "unsupported address")
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(status, F.lit(0)).cast("string")))
        .when(F.coalesce(n_bytes, F.lit(0)) == 0, "empty")
        .when(n_bytes > most, "too large")
        .when(~F.coalesce(F.lower(F.trim(content_type)).startswith("image/"), F.lit(True)), "not an image")
    )
