"""URL filters with dated lists: which entry of which list held at the time a page was captured.

Dated list changes (add or remove of a value on a day) become validity intervals. Each capture gives its keys (its host,
every domain above it, the path prefixes as deep as any entry) and an as-of join finds the entries of those keys that
were valid at the capture's time. Key and time bucket are joined for equality, so a host with a third of all captures
spreads over its buckets, and few intervals meet a capture. Before that a capture drops the keys that no entry has, by a
table of the entries' key hashes of at most SLOTS rows, so that a top-level domain without an entry is never sent. The most specific entry decides: a longer prefix, then the
host, then a longer domain; at the same place, allow before block.

A null or relative URL has no host, matches nothing and is allowed; a null time matches nothing; repeated captures each
keep their row; entries with nulls are left out; two changes of a value on the same day: the later action in the order
remove, add holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 28
SLOTS = 1 << 20  # hashes of keys, which bounds what is broadcast
#: What an entry's kind adds to its specificity.
KIND_RANK = {"domain": 0, "host": 1, "prefix": 2}


def intervals(changes: DataFrame) -> DataFrame:
    """changes (kind, value, verdict, action, day) as (kind, value, verdict, since, until); until is null while an entry still holds."""
    rows = changes.dropna(subset=["kind", "value", "verdict", "action", "day"]).select("kind", "value", "verdict", "day", (F.col("action") == "add").alias("on")).distinct()
    day = rows.groupBy("kind", "value", "verdict", "day").agg(F.max("on").alias("on"))
    order = Window.partitionBy("kind", "value", "verdict").orderBy("day")
    return day.withColumn("until", F.lead("day").over(order)).where("on").select("kind", "value", "verdict", F.col("day").alias("since"), "until")


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; null if there is none."""
    authority = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:\d*)?$", "")), F.lit(""))


def path_of(url: Column) -> Column:
    """The path, at least a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def keys_of(host: Column, path: Column, depth: int) -> Column:
    """All (kind, value) under which an entry can name the address; prefixes end with a slash."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.split(path, "/")  # '' before the first slash; the part after the last slash is no folder
    folders = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(max(1, depth)))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")).alias("value")),
    )
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, folders)


def judge(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """captures (id, url, date) with host, verdict, and kind, value, since of the entry that decided."""
    valid = intervals(changes)
    depth = valid.where("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1)).first()[0] or 0
    rows = captures.groupBy(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).cast("date").alias("fetched_on")).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    number = F.floor(F.datediff("fetched_on", F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)
    low, high = captures.agg(F.min(F.col(time_col).cast("date")), F.max(F.col(time_col).cast("date"))).first()
    asked = rows.where("host is not null and fetched_on is not null").select(
        "page_id", "url", "fetched_on", F.explode(keys_of(F.col("host"), path_of(F.col("url")), depth)).alias("key"), number.alias("bucket")
    )
    slot = lambda kind, value: F.pmod(F.xxhash64(kind, value), F.lit(SLOTS))
    listed = valid.select(slot("kind", "value").alias("slot")).distinct()
    asked = asked.withColumn("slot", slot("key.kind", "key.value")).join(F.broadcast(listed), "slot", "left_semi")
    asked = asked.select("page_id", "url", "fetched_on", "bucket", F.col("key.kind").alias("kind"), F.col("key.value").alias("value"))
    since, until = F.greatest("since", F.lit(low)), F.least(F.coalesce(F.date_sub("until", 1), F.lit(high)), F.lit(high))
    span = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)
    dealt = valid.where(since <= until).withColumn("bucket", F.explode(F.sequence(span(since), span(until))))
    rank = F.col("kind")
    for kind, n in KIND_RANK.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    hits = (
        asked.join(dealt, ["kind", "value", "bucket"])
        .where((F.col("since") <= F.col("fetched_on")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until"))))
        .groupBy("page_id", "url", "fetched_on")
        .agg(F.max(F.struct(rank.cast("int").alias("rank"), F.length("value").alias("n"), (F.col("verdict") == "allow").alias("allowed"), "kind", "value", "verdict", "since")).alias("best"))
    )
    same = F.col("r.page_id").eqNullSafe(F.col("h.page_id")) & (F.col("r.url") == F.col("h.url")) & (F.col("r.fetched_on") == F.col("h.fetched_on"))
    return (
        rows.alias("r")
        .join(hits.alias("h"), same, "left")
        .select(
            "r.page_id",
            "r.url",
            "r.fetched_on",
            "r.host",
            F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
            F.col("best.kind").alias("entry_kind"),
            F.col("best.value").alias("entry"),
            F.col("best.since").alias("entry_since"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.copies"))).alias("copy"),
        )
        .drop("copy")
    )
