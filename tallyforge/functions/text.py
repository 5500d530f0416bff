"""Text rules as Column builders: white space, search form, prices, lot numbers, codes, label wording."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An amount, and what stands before or after one.
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def condensed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last space (if there is one after the start) with an ellipsis."""
    head = F.substring(text, 1, max(0, limit - 1))
    cut = F.regexp_replace(head, r"(?s)^(.+) [^ ]*$", "$1")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def search_form(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def merge_form(text: Column) -> Column:
    """Lower-case words: other characters are spaces, runs of spaces one."""
    return condensed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "))


def _amount(digits: Column) -> Column:
    return F.regexp_replace(digits, ",", "").try_cast("double")


def all_amounts(text: Column) -> Column:
    """Every amount in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), _amount)


def first_price(text: Column) -> Column:
    """An amount after a currency mark, else one before a mark, else the largest amount, else null."""
    leading = F.nullif(F.regexp_extract(text, rf"(?:[$€£]|USD|usd|CAD|cad)\s*{AMOUNT}", 1), F.lit(""))
    trailing = F.nullif(F.regexp_extract(text, rf"{AMOUNT}\s*(?:USD|usd|dollars|\$)", 1), F.lit(""))
    return F.coalesce(_amount(leading), _amount(trailing), F.array_max(all_amounts(text)))


#: Words in front of the digits of an element id; labels; words between a label and its number.
WRAPPERS = ("itemmain", "item", "itemrow", "itemcard", "itemlisting", "lot", "lotrow", "lotcard", "lotitem", "lotmain", "auction", "auctionitem", "pallet", "palletcard", "product", "productcard", "listing", "listingcard", "card", "row", "grid", "tile", "main", "wrapper", "container", "sku")
LABELS = ("lot", "item", "sku", "pallet", "auction", "product", "listing", "unit", "stock", "ref")
FILLERS = ("number", "code", "ref", "num", "no", "id")
_GAP = r"[ \t.:#\-_/]"


def without_label(text: Column) -> Column:
    """`Item No. 88` is `88`; a text without a label that stands apart is unchanged."""
    labels, fillers = "|".join(LABELS), "|".join(FILLERS)
    filled = F.regexp_extract(text, rf"(?is)^(?:{labels}){_GAP}*(?:{fillers}){_GAP}+([^ \t.:#\-_/].*)$", 1)
    plain = F.regexp_extract(text, rf"(?is)^(?:{labels}){_GAP}+([^ \t.:#\-_/].*)$", 1)
    return F.coalesce(F.nullif(condensed(filled), F.lit("")), F.nullif(condensed(plain), F.lit("")), text)


def unwrapped(text: Column) -> Column:
    """The digits of a known wrapper word and digits (`ItemMain19002`); null for anything else."""
    word = F.lower(F.regexp_replace(F.regexp_extract(text, r"^([^\p{N}]*)\p{N}+$", 1), _GAP, ""))
    return F.when(word.isin(*WRAPPERS), F.regexp_extract(text, r"(\p{N}+)$", 1))


def lot_number(text: Column) -> Column:
    """A scraped number without its label or wrapper."""
    bare = without_label(condensed(text))
    return F.coalesce(unwrapped(bare), bare)


def page_lot_number(text: Column) -> Column:
    """The page-side form: at most three labels off, at most 40 characters, only short ASCII wrappers undone."""
    out = condensed(text)
    for _ in range(3):
        out = without_label(out)
    out = F.substring(out, 1, 40)
    word = F.lower(F.regexp_replace(F.regexp_extract(out, r"^([A-Za-z]{1,24})[\s\-_.]*\d{1,12}$", 1), r"[\s\-_.]", ""))
    return F.when(word.isin(*WRAPPERS), F.regexp_extract(out, r"(\d{1,12})$", 1)).otherwise(out)


#: A number after a label on a card, words that are none, a label in front of one, a bid in a card's words.
NUMBER_WORDS = r"(?i)(?:lot|item|pallet|sku|auction)\s*#?\s*:?\s*([A-Za-z0-9][A-Za-z0-9\-_.]{1,23})"
NO_NUMBER = r"(?i)^(?:no|num|number|id|code|ref|lot|item|sku|pallet|auction|product|listing)$"
NUMBER_LABEL = r"(?i)^(?:no|num|number|lot|item|sku|pallet|auction|product|listing|id|code|ref)\b[\s:#\-_.]*"
BID_WORDS = r"(?i)(?:current\s*bid|high\s*bid|current\s*price|bid|price)\s*:?\s*[$€£]?\s*[\d.,]+"


def wrapped_digits(text: Column) -> Column:
    """The digits (12 at most) of a text that is a known word and digits; null for anything else."""
    bare = F.trim(text)
    word = F.lower(F.regexp_extract(bare, r"^([A-Za-z]{1,24})[\s\-_.]*\d{1,12}$", 1))
    return F.when(word.isin(*WRAPPERS), F.regexp_extract(bare, r"(\d{1,12})$", 1))


def is_wrapped_id(text: str) -> bool:
    """Whether wrapped_digits() finds any, of a text at hand."""
    found = re.fullmatch(r"([A-Za-z]{1,24})[\s\-_.]*(\d{1,12})", text.strip(), re.ASCII)
    return found is not None and found[1].lower() in WRAPPERS


def read_number(printed: Column, words: Column) -> Column:
    """A card's number: what follows a label in what it prints, else that without labels (three at most) and wrapper, else what follows a label in its words; empty if there is none."""
    labelled = lambda x: F.regexp_extract(x, NUMBER_WORDS, 1)
    fine = lambda x: (x != "") & ~x.rlike(NO_NUMBER)
    raw = condensed(printed)
    bare = raw
    for _ in range(3):
        bare = F.regexp_replace(bare, NUMBER_LABEL, "")
    candidate = F.when(fine(labelled(raw)), labelled(raw)).otherwise(F.regexp_replace(bare, "^[^A-Za-z0-9]+", ""))
    candidate = F.substring(F.coalesce(wrapped_digits(candidate), candidate), 1, 40)
    return F.when(candidate != "", candidate).when(fine(labelled(words)), labelled(words)).otherwise("")


def fnv32(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 units."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    hashed = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(text == "", F.lit(2166136261).cast("long")).otherwise(hashed)


def fnv_low32(text: Column, start: int = 0x84222325) -> Column:
    """The low 32 bits of the 64-bit FNV-1a hash of a text's UTF-8 bytes; multiplying keeps low bits low, so 32 suffice."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    hashed = F.aggregate(octets, F.lit(start).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(435)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(F.octet_length(text) == 0, F.lit(start).cast("long")).otherwise(hashed)


def fallback_number(image_url: Column, text: Column) -> Column:
    """`AUTO-` and eight hex digits of the first image's address, or else of the text."""
    source = F.coalesce(F.nullif(image_url, F.lit("")), F.nullif(condensed(text), F.lit("")), F.lit("unknown-lot"))
    return F.concat(F.lit("AUTO-"), F.lpad(F.hex(fnv_low32(source)), 8, "0"))


def product_code(text: Column) -> Column:
    """A catalogue code in comparable form: 8 to 14 digits, or a mixed code of 5 or more characters; else null."""
    code = search_form(text)
    digits = code.rlike(r"^\p{N}+$")
    return F.when(digits & F.length(code).between(8, 14), code).when(~digits & code.rlike(r"\p{N}") & (F.length(code) >= 5), code)


def barcode(text: Column) -> Column:
    """A barcode's payload in upper case, or null where it is not like a product code."""
    value = F.upper(F.regexp_replace(text, r"\s", ""))
    fine = value.rlike(r"^[\p{L}\p{N}\-_]{6,24}$") & value.rlike(r"\p{N}") & (F.size(F.array_distinct(F.split(value, "(?!^)"))) >= 3)
    return F.when(fine, value)


#: Words that mark a line as one with an identifier.
HINTS = ("sku", "upc", "ean", "gtin", "isbn", "model", "mod.", "part", "p/n", "item", "ref", "no.", "code", "asin")
_EDGE = r".,;:!?()\[\]{}<>\"'`|/\\*+~=·•$#"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once: inside a lambda no subexpression is shared by itself."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def identifier_token(raw: Column, hinted: Column) -> Column:
    """A token that looks like a catalogue identifier, in upper case; else null."""

    def judged(token: Column) -> Column:
        digits = F.regexp_count(token, F.lit(r"\p{N}"))
        fine = token.rlike(r"^[\p{L}\p{N}\-_.]{4,24}$") & (digits > 0) & (F.size(F.array_distinct(F.regexp_extract_all(token, F.lit("."), F.lit(0)))) >= 3)
        kept = F.when(token.rlike(r"\p{L}"), F.length(token) >= 5).when(digits.between(8, 14), True).otherwise(hinted & digits.between(4, 7))
        return F.when(fine & kept, token)

    return let(F.regexp_replace(F.upper(F.regexp_replace(raw, f"^[{_EDGE}]+|[{_EDGE}]+$", "")), r"^[\-_.]+|[\-_.]+$", ""), judged)


def is_hinted(line: Column) -> Column:
    """Whether a line says that it carries an identifier."""
    low = F.lower(line)
    return F.exists(F.array(*map(F.lit, HINTS)), lambda h: F.contains(low, h))


def line_identifiers(line: Column) -> Column:
    """The identifiers of one label line, in order, repeats included."""
    tokens = F.filter(F.split(line, r"[\s:#]+"), lambda t: (F.length(t) >= 4) & t.rlike(r"\p{N}"))  # no other can be one
    return F.filter(F.transform(tokens, lambda t: identifier_token(t, is_hinted(line))), lambda t: t.isNotNull())


#: Fixed value: identifiers of a label at most.
MOST_IDENTIFIERS = 12


def label_identifiers(lines: Column) -> Column:
    """The identifiers of a label's lines, each once in the order in which they come up, at most so many."""
    return F.slice(F.array_distinct(F.flatten(F.transform(lines, line_identifiers))), 1, MOST_IDENTIFIERS)


#: Words of the paperwork that travels with goods.
PAPERWORK = ("tracking", "ship to", "ship from", "sold to", "bill to", "invoice", "purchase order", "order #", "po #", "carrier", "freight", "address", "phone", "fax", "tel:", "fedex", "usps", "ups ", "dhl", "weight", "dimensions", "qty", "quan", "pallet", "lot #", "serial", "fragile", "this side up", "do not", "customer", "returns")


def label_wording(line: Column, longest: int = 60) -> Column:
    """A label line as a product's wording, or null where it is a code, a contact or paperwork."""
    text = condensed(line)
    low = F.lower(text)
    letters, digits = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{N}"))
    foreign = F.contains(low, F.lit("http")) | F.contains(low, F.lit("www.")) | F.contains(low, F.lit("@"))
    paper = F.exists(F.array(*map(F.lit, PAPERWORK)), lambda w: F.contains(low, w))
    fine = F.length(text).between(4, longest) & (letters >= 4) & (letters >= 2 * digits) & ~((digits >= 7) & (letters <= 2))
    return F.when(fine & ~foreign & ~paper, text)


#: Status and empty-listing wording.
SOLD = r"(?i)\bsold\b(?!\s*(?:as|in|by|per|with|separately|individually|together|at|on|for|from|off|singly))"
NO_RESULTS = r"(?i)(?:no|zero)\s+(?:items|results|lots|listings|products|auction items)\s*(?:were\s+)?(?:found|available|listed|to show)?|(?:0|zero)\s+(?:items|results|lots|listings|products)\b"
NON_LOT_HREF = r"(?i)\b(?:log-?in|log-?out|sign-?in|sign-?up|sign-?out|register|cart|basket|checkout|account|profile|my-?account|watch-?list|favorite|favourite|wishlist|share|print|privacy|terms|legal|cookie|help|support|contact|faq|about|facebook|twitter|instagram|pinterest|linkedin|youtube|whatsapp|tiktok)\b"


def is_sold(text: Column) -> Column:
    """Whether a status text says sold, and not how the lot is sold."""
    return text.rlike(SOLD)


def is_empty_listing(text: Column) -> Column:
    """Whether a text says that nothing was found."""
    return text.rlike(NO_RESULTS)


def singular(word: Column) -> Column:
    """A word's singular, crudely."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("ss"), word)
        .when(word.rlike("(?:ches|shes|sses|xes|zes)$"), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s") & (n > 3), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def _led(numeral: Column) -> Column:
    return F.concat(F.lpad(F.length(numeral).cast("string"), 3, "0"), numeral)


def natural_key(text: Column) -> Column:
    """A sort key that orders numerals (of up to 999 digits) by value and letters without case: a numeral is led by its length."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), _led(F.regexp_replace(r, "^0+(?=.)", ""))).otherwise(r)), "")


def file_stem(text: Column) -> Column:
    """A file name for a lot number: other characters are dashes, at most 60, `unknown` if nothing is left."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\-]", "-"), "^-+|-+$", ""), 1, 60)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def run_phrase(numbers: Column) -> Column:
    """`7-12` for a run (`7-7` for one), else `1, 3 and 4`; numbers is sorted and distinct."""
    n = F.size(numbers)
    first, last = F.get(numbers, F.lit(0)), F.try_element_at(numbers, F.lit(-1))
    words = F.transform(numbers, lambda x: x.cast("string"))
    listed = F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), last.cast("string"))
    return F.when(n == 0, "").when(last - first + 1 == n, F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise(listed)


def counts_phrase(counts: Column) -> Column:
    """`4, 6 and 9`."""
    words = F.transform(counts, lambda x: x.cast("string"))
    n = F.size(counts)
    listed = F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(words, F.lit(-1)))
    return F.when(n == 0, "").when(n == 1, F.get(words, F.lit(0))).otherwise(listed)
