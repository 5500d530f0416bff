"""What rows, jobs and scans say, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import money as M
from tallyforge.functions import text as T


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _n(c: Column) -> Column:
    return c.cast("string")


def display_name(title: Column, description: Column) -> Column:
    """The title, or the description where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), description)


def title_and_description(title: Column, description: Column) -> Column:
    """Both, if there is a title that is not the description; else the description."""
    a, b = T.condensed(_text(title)), T.condensed(_text(description))
    return F.when((a != "") & (a != b), F.concat_ws(" — ", a, b)).when(a == "", b).otherwise(a)


def replaced_description(old: Column, found: Column) -> Column:
    """The description that a lot's page gives, condensed; the old one where that is blank."""
    return F.coalesce(F.nullif(T.condensed(_text(found)), F.lit("")), old)


def replaced_images(old: Column, found: Column) -> Column:
    """The photographs that a lot's page gives; the old ones where it gives none."""
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(old)


def quantity_text(quantity: Column) -> Column:
    """`12 unit(s)`; null for one or none."""
    return F.when(quantity > 1, F.concat(_n(quantity), F.lit(" unit(s)")))


def unit_price_phrase(quantity: Column, retail: Column, resale: Column) -> Column:
    """`$35.00 ea retail · $18.00 ea resale`: what one of several goes for; null where nothing is known."""
    each = lambda value, word: F.when((quantity > 1) & (value > 0), F.concat(M.currency(value / quantity), F.lit(f" ea {word}")))
    return F.nullif(F.concat_ws(" · ", each(retail, "retail"), each(resale, "resale")), F.lit(""))


def photo_source(photos: Column) -> Column:
    """`photographs 3, 7`, in order; null without any."""
    listed = F.array_join(F.transform(F.array_sort(photos), _n), ", ")
    return F.when(F.size(photos) == 1, F.concat(F.lit("photograph "), listed)).when(F.size(photos) > 1, F.concat(F.lit("photographs "), listed))


def without_heading(text: Column) -> Column:
    """A description without the heading in front of it."""
    bare = F.regexp_replace(_text(text), r"(?i)^(?:lot|item|auction|product)\s+description\s*[:\-–]?\s*", "")
    return F.trim(F.regexp_replace(bare, r"(?i)^description\s*[:\-–]?\s*", ""))


def bid_text(card: Column) -> Column:
    """The words of a bid in a card's text; null for none."""
    return F.nullif(F.regexp_extract(card, T.BID_WORDS, 0), F.lit(""))


def is_filler(token: Column) -> Column:
    """Whether a token stands for a number and is none."""
    return F.trim(token).rlike(T.NO_NUMBER)


def is_priced(retail: Column, resale: Column) -> Column:
    return (F.coalesce(retail, F.lit(0)) > 0) | (F.coalesce(resale, F.lit(0)) > 0)


def state_label(state: Column, reason: Column) -> Column:
    """A row's state in words."""
    word = F.when(state == "pending", "Pending").when(state == "analyzing", "Analyzing").when(state == "completed", "Valuated")
    return F.when(state == "failed", F.concat(F.lit("Failed — "), _text(reason))).when(state == "skipped", F.concat(F.lit("Skipped — "), _text(reason))).otherwise(word)


def item_name(name: Column, brand: Column, model: Column) -> Column:
    """A manifest line's name, its brand unless the name has it, its model number."""
    own = F.when((_text(brand) != "") & ~F.contains(F.lower(name), F.lower(brand)), brand)
    return F.concat_ws(" · ", name, own, F.nullif(model, F.lit("")))


def object_details(quantity: Column, unit_retail: Column, unit_resale: Column, packaging: Column, condition: Column, location: Column) -> Column:
    """What is known of an object, the parts that there are."""
    return F.concat_ws(
        " · ", F.when(quantity > 1, F.concat(_n(quantity), F.lit(" visible"))), F.when(unit_retail > 0, F.concat(M.currency(unit_retail), F.lit(" ea retail"))), F.when(unit_resale > 0, F.concat(M.currency(unit_resale), F.lit(" ea resale"))),
        *(F.nullif(c, F.lit("")) for c in (packaging, condition, location)),
    )


def views_phrase(views: Column) -> Column:
    """`photograph 3`, `photographs 1, 2`; null for none."""
    listed = F.array_join(F.transform(F.array_sort(views), _n), ", ")
    return F.when(F.size(views) == 1, F.concat(F.lit("photograph "), listed)).when(F.size(views) > 1, F.concat(F.lit("photographs "), listed))


def images_phrase(sent: Column, available: Column, skipped: Column) -> Column:
    """`6 image(s)`, `40 of 46 image(s), 6 over the inline budget`."""
    over = F.when(skipped > 0, F.concat(F.lit(", "), _n(skipped), F.lit(" over the inline budget"))).otherwise("")
    return F.when(sent >= available, F.concat(_n(sent), F.lit(" image(s)"))).otherwise(F.concat(_n(sent), F.lit(" of "), _n(available), F.lit(" image(s)"), over))


def job_text(verb: Column, lot_number: Column, index: Column, answered: Column, count: Column, batch: Column) -> Column:
    """What a job shows: the lot of a job on rows, the place of a batch job held to 1 to count."""
    place = F.least(F.greatest(F.coalesce(index, F.greatest(answered, F.lit(1))), F.lit(1)), F.greatest(count, F.lit(1)))
    single = F.when(lot_number.isNull(), F.concat(verb, F.lit(" "), _n(answered), F.lit(" of "), _n(count))).otherwise(F.concat(verb, F.lit(" Lot #"), lot_number))
    return F.when(batch, F.concat(verb, F.lit(" Lot #"), _n(place), F.lit(" of "), _n(count))).otherwise(single)


def page_limit(limit: Column, most: int = 100) -> Column:
    """How many pages a walk may read: all that are allowed for 0 and below."""
    return F.when(limit > 0, F.least(limit, F.lit(most))).otherwise(F.lit(most))


#: An error's kind in few words (http takes its status), and the finish reasons of a refused answer.
SHORT_REASONS = {
    "missing_key": "missing API key", "no_images": "no readable images", "image_unavailable": "image unavailable", "rate_limited": "rate limited", "blocked": "blocked by safety filter", "no_content": "empty model answer",
    "malformed": "unreadable model answer", "photographs_failed": "no readable photographs", "scan_unsupported": "one-photograph reads unsupported",
}
BLOCKED = ("SAFETY", "RECITATION", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII", "IMAGE_SAFETY")


def error_kind(status: Column, finish: Column, text: Column) -> Column:
    """The kind of failure of a request by HTTP status, finish reason and answer; null where it did not fail."""
    return (
        F.when(status == 429, "rate_limited").when((status < 200) | (status > 299), "http").when(finish.isin(*BLOCKED), "blocked").when(F.trim(_text(text)) == "", "no_content")
    )


def failure_kind(e: Column) -> Column:
    """The kind of failure of an appraisal (has_key, images, unavailable, status, finish, text, decodes, photographs, read, one_by_one), in the order in which it comes up; null where it did not fail.

    images: usable ones, null where none are sent; unavailable: an image that could not be had; decodes: whether the
    answer could be read; photographs and read: how many were asked for one by one and answered; one_by_one: whether the
    provider can be asked so at all.
    """
    each = e["photographs"] > 0
    return (
        F.when(~e["has_key"], "missing_key").when(e["unavailable"].isNotNull(), "image_unavailable").when(e["images"] == 0, "no_images").when(each & ~e["one_by_one"], "scan_unsupported")
        .when(each & (e["read"] == 0), "photographs_failed").otherwise(F.coalesce(error_kind(e["status"], e["finish"], e["text"]), F.when(~e["decodes"], "malformed")))
    )


def short_reason(kind: Column, status: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in SHORT_REASONS.items() for x in pair])
    return F.when(kind == "http", F.concat(F.lit("HTTP "), _n(status))).otherwise(F.try_element_at(words, kind))


def failures_phrase(failures: Column, requested: Column) -> Column:
    """How many of the requested batches failed, with the first failure (failures is a sorted array)."""
    n, first = F.size(failures), F.get(failures, F.lit(0))
    some = F.concat(_n(n), F.lit(" of "), _n(requested), F.lit(" batch(es) could not be read ("), first, F.lit(")"))
    return F.when(n == 0, "the batches read no goods").when((requested > 1) & (n < requested), some).otherwise(F.concat(F.lit("no batch could be read ("), first, F.lit(")")))


def event_text(e: Column) -> Column:
    """A scan event (event, index, of, answered, total, count, frames, reason) in words."""
    index, of, count, reason = _n(e["index"]), _n(e["of"]), _n(e["count"]), _text(e["reason"])
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    many = e["of"] > 1
    share = say(_n(e["answered"]), " of ", _n(e["total"]), " photograph(s) answered")
    frames = F.when(F.size(e["frames"]) == 1, say("photograph ", _n(F.get(e["frames"], F.lit(0))))).otherwise(say("photographs ", T.run_phrase(e["frames"])))
    texts = {
        "reading": say("reading photograph ", index, " of ", of),
        "reused": say("photograph ", index, " of ", of, ": already read on this machine — reusing it, no request"),
        "read": say("photograph ", index, " of ", of, " read: ", count, " product group(s)"),
        "failed": say("photograph ", index, " of ", of, " could not be read (", reason, ") — carrying on with the rest"),
        "aggregating": say("reconciling ", index, " reading(s)", F.when(e["count"] > 0, say(" plus ", count, " unread photograph(s)")).otherwise(""), " into the pallet's line items"),
        "aggregated": say("reconciled into ", count, " line item(s)"),
        "aggregatedLocally": say("the reconciliation request failed (", reason, ") — merging the readings on this machine instead"),
        "fallingBack": say("nothing could be read photograph by photograph (", reason, ") — falling back to one pass over the whole gallery"),
        "manifesting": F.when(many, say("manifest batch ", index, " of ", of, ": reading ", count, " photograph(s) in one request")).otherwise(say("reading ", count, " photograph(s) into the pallet's manifest")),
        "manifested": say(F.when(many, say("manifest batch ", index, " of ", of, " read")).otherwise("manifest read"), ": ", count, " item(s), ", share),
        "manifestFailed": say("manifest batch ", index, " of ", of, " could not be read (", reason, ") — carrying on with the rest, ", share),
        "manifestGap": say(F.when(many, say("manifest batch ", index, " of ", of)).otherwise("the manifest batch"), " did not account for ", frames, " — it is in no item's views and was not declared empty, so the inventory may be short of what it showed"),
        "fallingBackFromManifest": say("nothing priceable came back from the batches (", reason, ") — falling back to one pass over the whole gallery"),
        "pricing": say("pricing ", count, " manifest item(s) in one request, with no photographs attached"),
        "priced": say("the manifest priced into ", count, " line item(s)"),
    }
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(e["event"] == name, text).otherwise(out)
    return out


def event_step(event: Column) -> Column:
    """The step of a row that a scan event stands for; null for events that only close something."""
    return (
        F.when(event.isin("reading", "reused", "read", "failed", "manifesting", "manifested", "manifestFailed"), "photograph")
        .when(event == "aggregating", "reconciling").when(event == "pricing", "pricingManifest").when(event.isin("fallingBack", "fallingBackFromManifest"), "wholeGallery")
    )
