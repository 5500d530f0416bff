"""What scans tell of counts, readings, evidence and repeated views, as Column builders. The wordings are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _list(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)


def conflict_note(counts: Column, kept: Column, reason: Column) -> Column:
    """That counts (a phrase) disagreed, which was kept and why."""
    return _say("counts ", counts, " disagreed; kept ", kept, " — ", reason)


def manifest_phrase(items: Column, units: Column, photographs: Column, empty: Column, disputed: Column) -> Column:
    """A manifest in a log line: frames declared empty and disputed counts only where there are any."""
    return F.concat_ws(
        " — ", _say(items, " distinct item(s)"), _say(units, " unit(s)"), _say("read from ", photographs, " photograph(s)"),
        F.when(empty > 0, _say(empty, " of the rest declared empty")), F.when(disputed > 0, _say(disputed, " count(s) in dispute")),
    )


def manifest_brief(items: Column, units: Column) -> Column:
    return _say(items, " item(s) · ", units, " unit(s)")


def reading_phrase(photographs: Column, objects: Column, identifiers: Column, unpriced: Column) -> Column:
    """Readings in a log line."""
    return F.concat_ws(" — ", _say(photographs, " photograph(s) read one by one"), _say(objects, " product group(s)"), F.when(identifiers > 0, _say(identifiers, " identifier(s)")), F.when(unpriced > 0, _say(unpriced, " unpriced")))


def reading_brief(photographs: Column, objects: Column, identifiers: Column) -> Column:
    return F.concat_ws(" · ", _say(photographs, " photo(s)"), _say(objects, " group(s)"), F.when(identifiers > 0, _say(identifiers, " id(s)")))


def evidence_phrase(images_read: Column, barcodes: Column, identifiers: Column, wording: Column) -> Column:
    """What was legible, the first two wordings of those there are; null arrays are empty."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rest = F.when(F.size(wording) > 2, _say(" (+", F.size(wording) - 2, " more)")).otherwise("")
    parts = F.concat_ws(
        " · ", F.when(some(barcodes), _say("barcode(s) ", _list(barcodes))), F.when(some(identifiers), _say("identifier(s) ", _list(identifiers))),
        F.when(some(wording), _say("label wording ", F.array_join(F.slice(wording, 1, 2), " · "), rest)),
    )
    return F.when(parts == "", _say("nothing legible on ", images_read, " photograph(s) — priced from what is visible")).otherwise(parts)


def claim(reason: Column, owner: Column, codes: Column) -> Column:
    """What frames have in common with the photograph that was read for them."""
    coded = _say("carry the same decoded barcode as photograph ", owner, " (", _list(codes), ")")
    return F.when(reason == "same picture", _say("are the same picture as photograph ", owner)).otherwise(coded)


def view_phrase(frames: Column, reason: Column, owner: Column, codes: Column) -> Column:
    return _say("photograph(s) ", _list(frames), " ", claim(reason, owner, codes))


def prompt_note(frames: Column, reason: Column, owner: Column, codes: Column) -> Column:
    """What a reconciliation is told of frames that were not read: a picture's reading is whole, a barcode's covers one product."""
    start = _say("Photograph(s) ", _list(frames), " — ", claim(reason, owner, codes))
    picture = _say(start, ", to the pixel — were not read on their own: photograph ", owner, "'s reading already covers everything in them, and they are attached below for completeness.")
    barcode = _say(
        start, ", so the same goods — were not read on their own: photograph ", owner,
        "'s reading covers that product. They are attached below; check them for units of it that the reading's count missed rather than counting the same stack twice.",
    )
    return F.when(reason == "same picture", picture).otherwise(barcode)
