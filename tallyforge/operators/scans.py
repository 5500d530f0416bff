"""Scans of a lot's photographs: galleries, labels, evidence, text budgets, envelopes, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import arrays as A
from tallyforge.functions import images as I
from tallyforge.functions import phrases as P
from tallyforge.functions import text as T


def image_list(candidates: DataFrame) -> DataFrame:
    """(page_id, place, url): one image for each identity among candidates (page_id, seq, url, hint), at its first place, by its best variant.

    Junk and null addresses give none; of variants with one score the first stays.
    """
    whole = I.full_size(F.col("url"))
    rows = candidates.select("page_id", "seq", whole.alias("whole"), I.score(F.col("url"), whole, F.col("hint")).alias("score")).where(F.col("whole").isNotNull() & ~I.is_junk(F.col("whole")))
    best = rows.groupBy("page_id", I.identity(F.col("whole")).alias("identity")).agg(F.min("seq").alias("seq"), F.max_by("whole", F.struct("score", -F.col("seq"))).alias("url"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("seq", "identity"))).select("page_id", "place", "url")


def labelled(photos: DataFrame, labels: DataFrame) -> DataFrame:
    """photos (lot, position, any more) with the codes and wording of labels (lot, position, codes, wording) at their position; none: empty."""
    empty = F.expr("cast(array() as array<string>)")
    there = labels.select(F.col("lot").alias("l_lot"), F.col("position").alias("l_position"), "codes", "wording")
    joined = photos.join(there, F.col("lot").eqNullSafe(F.col("l_lot")) & (F.col("position") == F.col("l_position")), "left")
    return joined.select(*photos.columns, F.coalesce("codes", empty).alias("codes"), F.coalesce("wording", empty).alias("wording"))


def with_local_codes(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """lines (lot, line, identifiers, label, views) with the codes that labels (lot, position, codes, wording) of their views show.

    Codes come in order of view, each once without regard to case; a blank label takes the first wording of the views.
    """
    seen = lines.select("lot", "line", F.posexplode("views").alias("at", "view"))
    there = labels.select(F.col("lot").alias("l_lot"), F.col("position").alias("view"), "codes", "wording")
    met = seen.join(there, F.col("lot").eqNullSafe(F.col("l_lot")) & (seen["view"] == there["view"])).select("lot", "line", "at", "codes", "wording")
    ordered = F.sort_array(F.collect_list(F.struct("at", "codes", "wording")))
    empty = F.expr("cast(array() as array<string>)")
    found = met.groupBy("lot", "line").agg(ordered.alias("o")).select(
        F.col("lot").alias("f_lot"), F.col("line").alias("f_line"),
        F.flatten(F.transform("o", lambda x: F.coalesce(x["codes"], empty))).alias("more"), F.get(F.flatten(F.transform("o", lambda x: F.slice(F.coalesce(x["wording"], empty), 1, 1))), F.lit(0)).alias("said"),
    )
    joined = lines.join(found, F.col("lot").eqNullSafe(F.col("f_lot")) & (F.col("line") == F.col("f_line")), "left")
    own = F.coalesce("identifiers", empty)
    have = F.transform(own, F.lower)
    more = F.filter(A.first_spellings(F.coalesce("more", empty)), lambda c: ~F.array_contains(have, F.lower(c)))
    changed = {"identifiers": F.concat(own, more), "label": F.coalesce(F.nullif("label", F.lit("")), "said", F.lit(""))}
    return joined.select(*(changed[c].alias(c) if c in changed else c for c in lines.columns))


def with_codes_of(lines: DataFrame, labels: Column, label: str = "label") -> DataFrame:
    """lines (identifiers, label) with what the labels (position, codes, wording) of their views say, which are in order in the line's row; as with_local_codes."""
    empty = F.expr("cast(array() as array<string>)")
    with_labels = lines.select("*", F.inline(F.array(F.struct(labels.alias("__labels"), F.coalesce("identifiers", empty).alias("__own")))))
    with_more = with_labels.select("*", F.inline(F.array(F.struct(
        A.first_spellings(F.flatten(F.transform("__labels", lambda x: F.coalesce(x["codes"], empty)))).alias("__more"), F.transform("__own", F.lower).alias("__have"),
        F.get(F.flatten(F.transform("__labels", lambda x: F.slice(F.coalesce(x["wording"], empty), 1, 1))), F.lit(0)).alias("__said"),
    ))))
    changed = {"identifiers": F.concat("__own", F.filter("__more", lambda c: ~F.array_contains("__have", F.lower(c)))), label: F.coalesce(F.nullif(label, F.lit("")), "__said", F.lit(""))}
    return with_more.select(*(changed[c].alias(c) if c in changed else c for c in lines.columns))


def merged_evidence(readings: DataFrame, key: str = "lot", limits: tuple[int, int, int] = (8, 12, 6)) -> DataFrame:
    """One row of evidence a key from readings (key, seq, images_read, barcodes, identifiers, wording): in order, each once without regard to case, at most so many of each."""
    empty = F.expr("cast(array() as array<string>)")
    names = ("barcodes", "identifiers", "wording")
    ordered = readings.groupBy(key).agg(F.sum("images_read").alias("images_read"), F.sort_array(F.collect_list(F.struct("seq", *names))).alias("o"))
    listed = lambda n, limit: A.first_spellings(F.flatten(F.transform(F.col(f"o.{n}"), lambda x: F.coalesce(x, empty))), limit).alias(n)
    return ordered.select(key, "images_read", *map(listed, names, limits))


def within_text_budget(pieces: Column, limit: int = 16_000) -> Column:
    """(text, omitted): the pieces as a JSON array that fits the limit; what does not fit is passed over, the first always travels."""
    start = F.struct(F.lit(2).alias("used"), F.slice(pieces, 1, 0).alias("kept"), F.lit(0).alias("omitted"))
    step = lambda a, p: F.when(
        (F.size(a["kept"]) == 0) | (a["used"] + F.length(p) + 1 <= limit), F.struct((a["used"] + F.length(p) + 1).alias("used"), F.concat(a["kept"], F.array(p)).alias("kept"), a["omitted"].alias("omitted"))
    ).otherwise(F.struct(a["used"].alias("used"), a["kept"].alias("kept"), (a["omitted"] + 1).alias("omitted")))
    return F.aggregate(pieces, start, step, lambda a: F.struct(F.concat(F.lit("["), F.array_join(a["kept"], ","), F.lit("]")).alias("text"), a["omitted"].alias("omitted")))


CANDIDATES = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string,finish_reason:string>>,promptFeedback:struct<blockReason:string,block_reason:string>,choices:array<struct<message:struct<content:string>,finish_reason:string>>,error:struct<message:string>>"


def unwrapped(responses: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """responses with what their envelope holds: answer, finish, kind of error (null: none), message of an error (300 characters at most without an envelope).

    Both forms of envelope are read, candidates with parts and choices with a message. A refused prompt or answer is
    blocked; an answer without candidates is malformed.
    """
    e = F.from_json(F.col(body), CANDIDATES)
    first, choice = F.get(e["candidates"], F.lit(0)), F.get(e["choices"], F.lit(0))
    parts = F.array_join(F.transform(F.coalesce(first["content"]["parts"], F.expr("cast(array() as array<struct<text:string>>)")), lambda p: p["text"]), "")
    answer = F.when(first.isNotNull(), parts).otherwise(choice["message"]["content"])
    finish = F.coalesce(first["finishReason"], first["finish_reason"], choice["finish_reason"])
    refused = F.coalesce(e["promptFeedback"]["blockReason"], e["promptFeedback"]["block_reason"])
    bad = ~F.col(status).between(200, 299)
    kind = F.when(bad, P.error_kind(F.col(status), finish, answer)).when(refused.isNotNull(), "blocked").when(first.isNull() & choice.isNull(), "malformed").otherwise(P.error_kind(F.lit(200), finish, answer))
    plain = F.coalesce(F.nullif(F.substring(T.condensed(F.col(body)), 1, 300), F.lit("")), F.lit("no details"))
    message = F.when(bad, F.coalesce(F.nullif(e["error"]["message"], F.lit("")), plain))
    return responses.select(*responses.columns, F.when(kind.isNull(), answer).alias("answer"), finish.alias("finish"), kind.alias("error"), message.alias("message"))


def frame_signal(fingerprint: Column, codes: Column) -> Column:
    """What tells that two frames show the same: the picture, else the codes; null without either."""
    return F.when(fingerprint.isNotNull(), F.concat(F.lit("picture:"), fingerprint)).when(F.size(codes) > 0, F.concat(F.lit("barcode:"), F.array_join(F.array_sort(codes), "+")))


def grouped_frames(frames: DataFrame, limit: int | None = None) -> DataFrame:
    """frames (lot, position, fingerprint, codes) as (lot, position, owner, reason): the first frame with a signal owns later ones; reason is null where a frame owns itself.

    Frames past the limit are compared with none and own themselves.
    """
    signal = F.when(F.lit(True) if limit is None else F.col("position") <= limit, frame_signal(F.col("fingerprint"), F.col("codes")))
    rows = frames.select("lot", "position", signal.alias("signal"))
    owners = rows.where("signal is not null").groupBy("lot", "signal").agg(F.min("position").alias("owner"))
    joined = rows.join(owners.toDF("o_lot", "o_signal", "owner"), F.col("lot").eqNullSafe(F.col("o_lot")) & (F.col("signal") == F.col("o_signal")), "left")
    owner = F.coalesce("owner", "position")
    reason = F.when(owner != F.col("position"), F.when(F.col("signal").startswith("picture:"), "same picture").otherwise("same barcode"))
    return joined.select("lot", "position", owner.alias("owner"), reason.alias("reason"))


def folds_by_reason(groups: DataFrame) -> DataFrame:
    """(lot, place, reason, frames) of grouped_frames: the folded frames of each reason, reasons in the order they come up."""
    folds = groups.where("reason is not null").groupBy("lot", "reason").agg(F.min("position").alias("first"), F.sort_array(F.collect_list("position")).alias("frames"))
    return folds.withColumn("place", F.row_number().over(Window.partitionBy("lot").orderBy("first"))).select("lot", "place", "reason", "frames")


def chosen_route(outcomes: DataFrame) -> DataFrame:
    """(lot, route, items) of outcomes (lot, route, items: how many lines it priced): the first of manifest, thorough, two pass and single that priced any; none where all failed."""
    rank = F.when(F.col("route") == "manifest", 0).when(F.col("route") == "thorough", 1).when(F.col("route") == "two pass", 2).otherwise(3)
    best = outcomes.groupBy("lot").agg(F.min(F.when(F.col("items") > 0, F.struct(rank.alias("rank"), "route", "items"))).alias("b"))
    return best.select("lot", F.coalesce("b.route", F.lit("none")).alias("route"), F.coalesce("b.items", F.lit(0)).alias("items"))


def pending(photos: DataFrame, readings: DataFrame, groups: DataFrame) -> DataFrame:
    """photos (lot, position, url) that still have to be read: neither read before (lot, url) nor folded into a frame before them (grouped_frames)."""
    folded = groups.where("owner <> position").select(F.col("lot").alias("g_lot"), F.col("position").alias("g_position"))
    unread = photos.join(readings.select(F.col("lot").alias("r_lot"), F.col("url").alias("r_url")), F.col("lot").eqNullSafe(F.col("r_lot")) & (F.col("url") == F.col("r_url")), "left_anti")
    return unread.join(folded, F.col("lot").eqNullSafe(F.col("g_lot")) & (F.col("position") == F.col("g_position")), "left_anti")


def reading_summary(objects: DataFrame) -> DataFrame:
    """(lot, photographs, objects, unpriced, identifiers) of objects (lot, position, seq, unit_retail, unit_resale, identifiers), identifiers each once without regard to case in order."""
    empty = F.expr("cast(array() as array<string>)")
    ordered = F.sort_array(F.collect_list(F.struct("position", "seq", F.coalesce("identifiers", empty).alias("ids"))))
    # photographs are counted in the row that holds the objects: counting them apart would shuffle all objects once more
    rows = objects.groupBy("lot").agg(ordered.alias("o"), F.count(F.lit(1)).alias("objects"), F.count_if(~P.is_priced(F.col("unit_retail"), F.col("unit_resale"))).alias("unpriced"))
    photographs = F.size(F.array_distinct(F.filter("o.position", lambda p: p.isNotNull()))).cast("long")
    return rows.select("lot", photographs.alias("photographs"), "objects", "unpriced", A.first_spellings(F.flatten(F.transform("o", lambda x: x["ids"]))).alias("identifiers"))


def leftovers(groups: DataFrame, limit: int, filled: DataFrame) -> DataFrame:
    """(lot, position) that are still to be sent: frames past the limit, then frames folded into an owner that filled (lot, position) does not hold."""
    read = filled.select(F.col("lot").alias("f_lot"), F.col("position").alias("f_position"))
    lost = groups.where("owner <> position").join(read, F.col("lot").eqNullSafe(F.col("f_lot")) & (F.col("owner") == F.col("f_position")), "left_anti")
    return groups.where(F.col("position") > limit).select("lot", "position").unionByName(lost.where(F.col("position") <= limit).select("lot", "position"))


def covered_views(groups: DataFrame, filled: DataFrame) -> DataFrame:
    """(lot, owner, reason, frames): the folds of groups (lot, position, owner, reason) that a reading covers and that are not read themselves.

    A fold stands only while its owner is among filled (lot, position); frames that are filled, too, explain themselves.
    Views without a frame left give no row. Reasons come by their first frame.
    """
    folds = groups.where("reason is not null")
    have = filled.select(F.col("lot").alias("f_lot"), F.col("position").alias("f_position")).distinct()
    there = lambda c: F.col("lot").eqNullSafe(F.col("f_lot")) & (F.col(c) == F.col("f_position"))
    left = folds.join(have, there("owner"), "left_semi").join(have, there("position"), "left_anti")
    return left.groupBy("lot", "owner", "reason").agg(F.sort_array(F.collect_list("position")).alias("frames"))


def routed(reports: DataFrame, lots: DataFrame) -> DataFrame:
    """reports (lot_number, any more) with the lot_id of the first lot (seq) that has their number; null where none has."""
    first = lots.groupBy("lot_number").agg(F.min_by("lot_id", "seq").alias("lot_id"))
    return reports.join(first, "lot_number", "left")
