"""Queries over pages and texts: addresses, first-wins, prices, label wording, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import urls as U
from tallyforge.operators import sequences as S
from tallyforge.sources.bindings import table


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's address says: key, lot number, page number, the address of page 3."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.dedupe_key(url, F.lit("")).alias("dedupe_key"),
        U.lot_number_of(url).alias("lot_number"),
        U.page_parameter(url).alias("parameter"),
        U.page_number(url).alias("page_number"),
        U.page_address(url, F.lit(3)).alias("third_page"),
        U.image_folder(url).alias("folder"),
    )


_PAGES = """
    WITH cut AS (
        SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query
        FROM pages
    )
"""


def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each dedupe key."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return S.first_wins(pages, U.dedupe_key(F.col("url"), F.lit("")), F.col("page_id"))


def page_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: pages, first sightings and repeats."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.dedupe_key(F.col("url"), F.lit("")).alias("key"))
    return pages.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("new"), (F.sum("n") - F.count(F.lit(1))).alias("repeats"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as label lines (doc_id, line_no, line)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def label_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("wording", T.label_wording(F.col("line")))
    return lines.where("wording IS NOT NULL").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "wording")


def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of label lines in any script; the SQL knows those of ASCII alone, which is all that the generated tables hold."""
    lines = _lines(spark, sf_dir).select("doc_id", F.explode(T.line_identifiers(F.col("line"))).alias("identifier"))
    return lines.groupBy("doc_id", "identifier").agg(F.count(F.lit(1)).alias("n"))


def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("price", T.first_price(F.col("line")))
    return lines.where("price IS NOT NULL").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "price")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condensed, truncated, search and merge forms of whole texts, the long ones as digests."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(T.condensed(text)).alias("condensed"),
        T.truncated(T.condensed(text), 60).alias("short"),
        F.md5(T.search_form(text)).alias("search_form"),
        F.md5(T.merge_form(text)).alias("merge_form"),
        T.is_sold(text).alias("sold"),
        T.is_empty_listing(text).alias("nothing"),
    )


def lot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers in several dresses, undressed; codes and file stems."""
    key = F.col("o_orderkey").cast("string")
    dressed = F.element_at(F.array(F.concat(F.lit("Lot #"), key), F.concat(F.lit("ItemMain"), key), F.concat(F.lit("Item  No. "), key), F.concat(F.lit("L-"), key)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), dressed.alias("raw"))
    return o.select("o_orderkey", "raw", T.lot_number(F.col("raw")).alias("number"), T.product_code(F.col("raw")).alias("code"), T.file_stem(F.col("raw")).alias("stem"), T.natural_key(F.col("raw")).alias("key"))


def fallback_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number made up from a page's address."""
    return table(spark, sf_dir, "pages").select("page_id", T.fallback_number(F.col("url"), F.lit("")).alias("number"))


QUERIES = {
    "page_addresses": page_addresses,
    "dedupe_first_wins": dedupe_first_wins,
    "page_accounting": page_accounting,
    "label_wording": label_wording,
    "identifier_tokens": identifier_tokens,
    "price_parse": price_parse,
    "text_forms": text_forms,
    "lot_numbers": lot_numbers,
    "fallback_numbers": fallback_numbers,
}

_AMOUNT = "([0-9][0-9,]*(?:\\.[0-9]{1,2})?)"
_PAPER = ", ".join(f"'{w}'" for w in T.PAPERWORK)
_HINTS = ", ".join(f"'{w}'" for w in T.HINTS)

ORACLE_SQL = {
    # the low half of the hash, byte by byte
    "fallback_numbers": """SELECT page_id, 'AUTO-' || printf('%08X', list_reduce(list_concat([CAST(2216829733 AS BIGINT)], list_transform(range(1, length(h) + 1, 2), lambda i: CAST((instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1 AS BIGINT))),
        lambda a, b: (xor(a, b) * 435) & 4294967295)) AS number FROM (SELECT page_id, hex(coalesce(nullif(url, ''), 'unknown-lot')) AS h FROM pages)""",
    "page_addresses": _PAGES
    + """SELECT page_id, host || path AS dedupe_key,
        list_filter(list_reverse(list_concat(string_split(path, '/'), regexp_split_to_array(query, '[&=]'))), lambda t: regexp_full_match(t, '[0-9]+'))[1] AS lot_number,
        nullif(regexp_extract(query, '(?i)(?:^|&)(page|paged|pg)(?:=|&|$)', 1), '') AS parameter,
        TRY_CAST(coalesce(nullif(regexp_extract(query, '(?i)(?:^|&)page=[+]*0*([1-9][0-9]*)(?:&|$)', 1), ''), nullif(regexp_extract(path, '(?i)/page(?:/+|-)0*([1-9][0-9]*)(?:/|$)', 1), '')) AS INTEGER) AS page_number,
        CASE WHEN regexp_matches(query, '(?i)(?:^|&)(page|paged|pg)(?:=|&|$)') THEN regexp_replace(url, '(?i)([?&](?:page|paged|pg))=[^&#]*', '\\1=3')
             ELSE regexp_extract(url, '^([^#]*)', 1) || CASE WHEN query <> '' THEN '&' ELSE '?' END || 'page=3' || regexp_extract(url, '(#.*)$', 1) END AS third_page,
        regexp_extract(url, '^(.*)/', 1) AS folder FROM cut""",
    "dedupe_first_wins": _PAGES + "SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host || path ORDER BY page_id) AS n FROM cut) WHERE n = 1",
    "page_accounting": _PAGES + "SELECT host, CAST(count(*) AS BIGINT) AS pages, count(DISTINCT host || path) AS new, CAST(count(*) - count(DISTINCT host || path) AS BIGINT) AS repeats FROM cut GROUP BY host",
    "label_wording": _LINES
    + f""", clean AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS wording FROM lines),
        measured AS (SELECT *, len(regexp_extract_all(wording, '\\p{{L}}')) AS letters, len(regexp_extract_all(wording, '\\p{{N}}')) AS digits, lower(wording) AS low FROM clean)
        SELECT doc_id, line_no, wording FROM measured WHERE length(wording) BETWEEN 4 AND 60 AND letters >= 4 AND letters >= 2 * digits AND NOT (digits >= 7 AND letters <= 2)
        AND NOT contains(low, 'http') AND NOT contains(low, 'www.') AND NOT contains(low, '@') AND len(list_filter([{_PAPER}], lambda w: contains(low, w))) = 0""",
    "identifier_tokens": _LINES
    + f""", split AS (SELECT doc_id, unnest(regexp_split_to_array(line, '[\\s:#]+')) AS raw, len(list_filter([{_HINTS}], lambda w: contains(lower(line), w))) > 0 AS hinted FROM lines),
        cut AS (SELECT doc_id, hinted, regexp_replace(regexp_replace(upper(regexp_replace(regexp_replace(raw, '^[.,;:!?()\\[\\]{{}}<>"''`|/\\\\*+~=·•$#]+', ''), '[.,;:!?()\\[\\]{{}}<>"''`|/\\\\*+~=·•$#]+$', '')), '^[-_.]+', ''), '[-_.]+$', '') AS t FROM split),
        measured AS (SELECT *, len(regexp_extract_all(t, '[0-9]')) AS digits FROM cut WHERE regexp_full_match(t, '[A-Z0-9._-]{{4,24}}'))
        SELECT doc_id, t AS identifier, count(*) AS n FROM measured WHERE digits > 0 AND len(list_distinct(string_split(t, ''))) >= 3
        AND CASE WHEN regexp_matches(t, '[A-Z]') THEN length(t) >= 5 WHEN digits BETWEEN 8 AND 14 THEN true ELSE hinted AND digits BETWEEN 4 AND 7 END GROUP BY 1, 2""",
    "price_parse": _LINES
    + f""", found AS (SELECT doc_id, line_no, coalesce(
            TRY_CAST(replace(nullif(regexp_extract(line, '(?:[$€£]|USD|usd|CAD|cad)\\s*{_AMOUNT}', 1), ''), ',', '') AS DOUBLE),
            TRY_CAST(replace(nullif(regexp_extract(line, '{_AMOUNT}\\s*(?:USD|usd|dollars|\\$)', 1), ''), ',', '') AS DOUBLE),
            list_max(list_transform(regexp_extract_all(line, '{_AMOUNT}', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)))) AS price FROM lines)
        SELECT doc_id, line_no, price FROM found WHERE price IS NOT NULL""",
    "text_forms": """WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents)
        SELECT doc_id, md5(clean) AS condensed, CASE WHEN length(clean) <= 60 THEN clean ELSE regexp_replace(substr(clean, 1, 59), '^(.+) [^ ]*$', '\\1') || '…' END AS short,
        md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS search_form, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS merge_form,
        len(regexp_extract_all(text, '(?i)\\bsold\\b')) > len(regexp_extract_all(text, '(?i)\\bsold\\b\\s*(?:as|in|by|per|with|separately|individually|together|at|on|for|from|off|singly)')) AS sold,
        regexp_matches(text, '(?i)(?:no|zero)\\s+(?:items|results|lots|listings|products|auction items)\\s*(?:were\\s+)?(?:found|available|listed|to show)?|(?:0|zero)\\s+(?:items|results|lots|listings|products)\\b') AS nothing FROM c""",
    "lot_numbers": f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Lot #' || o_orderkey WHEN 1 THEN 'ItemMain' || o_orderkey WHEN 2 THEN 'Item  No. ' || o_orderkey ELSE 'L-' || o_orderkey END AS raw FROM orders),
        c AS (SELECT *, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS code_form FROM o)
        SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 = 3 THEN raw ELSE CAST(o_orderkey AS VARCHAR) END AS number, CASE WHEN length(code_form) >= 5 THEN code_form END AS code,
        trim(regexp_replace(raw, '[^A-Za-z0-9-]', '-', 'g'), '-') AS stem,
        array_to_string(list_transform(regexp_extract_all(lower(raw), '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length(r) AS VARCHAR), 3, '0') || r ELSE r END), '') AS key FROM c""",
}
