"""Removal of repeated byte strings in rounds of doubled length, by hashed ranks and anchors.

A byte goes when it is covered by a string of LENGTH bytes that also starts earlier (in a document of smaller id, or
earlier in its own). Rounds rank positions by the 25, 50 and 100 bytes that follow them; positions whose rank is unique
drop out, and in the last round all but the least position of a rank repeat. This is not the prefix doubling that sorts
pairs of ranks over the whole corpus and ranks them again: a rank is a hash of the bytes, computed from the text in each
round (two hashes of half the length make one), and no round takes over the ranks of the round before. Sorting all
positions took 24 times the text in its first round (README).

In the rounds before the last not every position is shuffled. A string is represented by its anchor, the position of
least hash among those whose ranked bytes lie inside it, so neighbours mostly share one; equal strings have equal anchors.
Strings next to each other with one anchor are a segment. In the task of an anchor's rank, segments of equal bytes keep
their first (the strings of the others repeat), segments alone with their anchor's rank are unique, and only the rest
goes on to the next length, at most two ends for each repeated passage.

Ranks that are frequent within a batch go on directly, so no rank gathers more than some positions of each batch.
A task also remembers leads that it has sent and settles later strings that equal one, so that a string of very many
documents is sent about once a task. Positions meet by 64-bit hashes, which only decide what goes on; strings count as
equal, and bytes are removed, by 128 bits of two independent hashes. Texts and what is known of them are joined by
document; equal strings in one batch are settled there.

A null text is empty; texts shorter than LENGTH keep all bytes; rows that share id and text are one document, each row
with its result; rows that share only the id are ordered by a hash of the text; a null id comes after all others.
Texts are cut into overlapping pieces of PIECE bytes for memory only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bucketed, by_bucket, saved, slices, small_batches, utf8_bytes
from tallyforge.llm.jaccard_join import ROWS, _batch, _packed, _split, _unpacked
from tallyforge.llm.shingles import BASE, BASE_INVERSE, U64, mixed, powers

LENGTH = 100  # bytes of a string
ROUNDS = (25, 50, 100)  # ranked bytes
PIECE = 1 << 20
HOT = 16  # segments of a batch with one rank
NO_ID = np.iinfo(np.int64).max
PLACE_BITS = 23
SEGMENTS, FREQUENT, REPEATED, CONTESTED = range(4)

_BYTES = mixed(np.arange(1, 257, dtype=U64) * BASE)
#: A second hash, of another base and other values of the bytes.
SECOND_BASE = U64(0xD6E8FEB86659FD93)
SECOND_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SECOND = mixed(np.arange(1001, 1257, dtype=U64) * SECOND_BASE)


class Ranks:
    """Names of the bytes a to b of a batch: by prefix sums, and by pairs of names at doubled lengths."""

    def __init__(self, raw: np.ndarray):
        self.total = np.empty(len(raw) + 1, dtype=U64)
        self.total[0] = 0
        np.cumsum(_BYTES[raw] * powers(BASE, len(raw)), out=self.total[1:])
        self.shift = powers(BASE_INVERSE, len(raw) + 1)
        self.raw = raw

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.total[b] - self.total[a]) * self.shift[a] + (b - a).astype(U64))

    def seconds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The second hash of the bytes a to b."""
        total = np.empty(len(self.raw) + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_SECOND[self.raw] * powers(SECOND_BASE, len(self.raw)), out=total[1:])
        return mixed((total[b] - total[a]) * powers(SECOND_INVERSE, len(self.raw) + 1)[a] + (b - a).astype(U64))

    def doubled(self, length: int) -> np.ndarray:
        """The rank of each position by the next length bytes: pairs of ranks of half the length, down to the first round's."""
        if length == ROUNDS[0]:
            at = np.arange(len(self.total) - length)
            return self.of(at, at + length)
        half = self.doubled(length // 2)
        return mixed(half[: len(half) - length // 2] * BASE + half[length // 2 :])


def segments(ranks: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of each run of strings with one anchor; ranks are those of length bytes."""
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none
    places = U64((1 << PLACE_BITS) - 1)
    low = (ranks & ~places) | np.arange(len(ranks)).astype(U64)  # the leftmost of equal ranks
    span, width = LENGTH - length + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    m = n - LENGTH + 1
    low = np.minimum(low[:m], low[span - width : span - width + m])
    anchor = (low & places).astype(np.int64)
    inside = np.zeros(n + 1, dtype=np.int32)
    fits = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - LENGTH + 1, -1)
    ok = np.cumsum(inside)[:m] > 0
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    new = ok & begins[:m]
    new[0] |= ok[0]
    new[1:] |= ok[1:] & (~ok[:-1] | (anchor[1:] != anchor[:-1]))
    last = ok.copy()
    last[:-1] &= ~ok[1:] | new[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last), anchor[first]


def _pieces(batches: Iterator[pa.RecordBatch], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document id, text hash, place in the document) of batches; huge texts come in overlapping pieces."""
    for batch in slices(batches, "text", piece):
        raw, offsets = utf8_bytes(batch.column("text"))
        doc, tie, at = (batch.column(c).to_numpy() for c in ("doc_id", "tie", "at"))
        if len(raw) <= piece + LENGTH:
            yield raw, offsets, doc, tie, at
            continue
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            for a in range(0, max(1, len(text) - LENGTH + 1), piece):
                part = text[a : a + piece + LENGTH - 1]
                yield part, np.array([0, len(part)]), doc[i : i + 1], tie[i : i + 1], at[i : i + 1] + a


def _same(*columns: np.ndarray) -> np.ndarray:
    """Which rows equal the row before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


class Seen:
    """Leads that a task has sent, the last of each slot of a small table."""

    def __init__(self, bits: int = 15):
        self.bits = bits
        self.name, self.second = np.zeros(1 << bits, U64), np.zeros(1 << bits, U64)
        self.at = np.full((3, 1 << bits), np.iinfo(np.int64).max)  # document, tie, start

    def later(self, name: np.ndarray, second: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which strings equal one here that starts earlier; the others are entered."""
        slot = (name >> U64(64 - self.bits)).astype(np.int64)
        d, t, s = self.at[:, slot]
        out = (self.name[slot] == name) & (self.second[slot] == second) & ((doc > d) | (doc == d) & ((tie > t) | (tie == t) & (start > s)))
        slot, last = np.unique(slot[~out][::-1], return_index=True)
        new = np.flatnonzero(~out)[::-1][last]
        self.name[slot], self.second[slot] = name[new], second[new]
        self.at[:, slot] = doc[new], tie[new], start[new]
        return out


def _settled(name: np.ndarray, second: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, leads, repeats): rows sorted by name and position; the first of each name; those that start later than it."""
    order = np.lexsort((start, tie, doc, second, name))
    lead = ~_same(name[order], second[order])
    head = order[lead][np.cumsum(lead) - 1]
    own = (doc[order] == doc[head]) & (tie[order] == tie[head]) & (start[order] == start[head])
    return order, order[lead], order[~own]


def _ranked(length: int, buckets: int, most: int, piece: int):
    """A round beside the bytes: segments by the bucket of their anchor's rank, and what is settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for raw, offsets, doc, tie, at in _pieces(batches, piece):
            if len(raw) < LENGTH:
                continue
            ranks = Ranks(raw)
            names = ranks.doubled(length)
            first, last, anchor = segments(names, offsets, length)
            if not len(first):
                continue
            rank, whole = names[anchor], ranks.of(first, last + LENGTH) if length < LENGTH else names[first]
            owner = np.searchsorted(offsets, first, side="right") - 1
            width = (last - first).astype(np.uint8)
            doc_of, tie_of, start = doc[owner], tie[owner], first - offsets[owner] + at[owner]
            second = ranks.seconds(first, last + LENGTH)
            _, leads, repeats = _settled(whole, second, doc_of, tie_of, start)
            known = seen.later(whole[leads], second[leads], doc_of[leads], tie_of[leads], start[leads])
            leads, repeats = leads[~known], np.concatenate((repeats, leads[known]))
            rows = _returned(REPEATED, buckets, doc_of[repeats], tie_of[repeats], start[repeats], width[repeats])
            rank, whole, second, owner, start, width = rank[leads], whole[leads], second[leads], owner[leads], start[leads], width[leads]
            if length < LENGTH:
                value, back, count = np.unique(rank, return_inverse=True, return_counts=True)
                hot = count >= most
                for b, (v,) in _split((value[hot] % U64(buckets)).astype(np.int64), buckets, value[hot]):
                    rows.append((FREQUENT, b, _packed(v)))
                hot = hot[back]
                rows += _returned(CONTESTED, buckets, doc[owner[hot]], tie[owner[hot]], start[hot], width[hot])
                rank, whole, second, owner, start, width = rank[~hot], whole[~hot], second[~hot], owner[~hot], start[~hot], width[~hot]
            key = [rank, second, whole] if length < LENGTH else [rank, second]
            for b, (o, s, w, *k) in _split((rank % U64(buckets)).astype(np.int64), buckets, owner, start, width, *key):
                docs, o = np.unique(o, return_inverse=True)
                rows.append((SEGMENTS, b, _packed(doc[docs], tie[docs], o.astype(np.uint32 if len(docs) > 65535 else np.uint16), s.astype(np.uint64 if s.max() >> 32 else np.uint32), w, *k)))
            if rows:
                yield _batch(rows)

    return run


def _returned(kind: int, buckets: int, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, width: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows that go to the documents' buckets, with neighbouring segments joined."""
    if not len(doc):
        return []
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order].astype(np.int64), start[order].astype(np.int64) + width[order]
    joined = _same(doc, tie)
    joined[1:] &= start[1:] <= end[:-1] + 1
    at = np.flatnonzero(~joined)
    doc, tie, start, end = doc[at], tie[at], start[at], np.maximum.reduceat(end, at)
    where = (mixed(tie.astype(np.int64).view(U64) ^ doc.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int64)
    return [(kind, b, _packed(*x)) for b, x in _split(where, buckets, doc.astype(np.int64), tie.astype(np.int64), start, end)]


def _judged(length: int, buckets: int):
    """A round at the ranks: which segments repeat, which are unique, which go on."""

    def flush(blobs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(b) for b in blobs.get(SEGMENTS, [])]
        if not parts:
            return
        doc, tie = (np.concatenate([p[i][p[2]] for p in parts]) for i in (0, 1))
        start, width, rank, second, *whole = (np.concatenate([p[i].astype(U64) if i == 3 else p[i] for p in parts]) for i in range(3, len(parts[0])))
        start = start.astype(np.int64)
        whole = whole[0] if whole else rank
        doc, tie = doc.view(np.int64), tie.view(np.int64)
        _, leads, repeats = _settled(whole, second, doc, tie, start)
        rows = _returned(REPEATED, buckets, doc[repeats], tie[repeats], start[repeats], width[repeats])
        if length < LENGTH:
            value, back, count = np.unique(rank[leads], return_inverse=True, return_counts=True)
            if FREQUENT in blobs:
                count[np.isin(value, np.concatenate([_unpacked(b)[0] for b in blobs[FREQUENT]]))] = 2
            on = leads[count[back] > 1]
            rows += _returned(CONTESTED, buckets, doc[on], tie[on], start[on], width[on])
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, {}
        for batch in batches:
            others = []
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
                if kind in (REPEATED, CONTESTED):
                    others.append((kind, bucket, blob))
                    continue
                if bucket != now and now is not None:
                    yield from flush(blobs)
                    blobs = {}
                now = bucket
                blobs.setdefault(kind, []).append(blob)
            if others:
                yield _batch(others)
        yield from flush(blobs)

    return run


RANGES = "kind int, doc_id long, tie long, ranges binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of string starts by document: one row per document and kind that a bucket has."""

    def flush(kind: int, blobs: list[bytes]) -> pa.RecordBatch:
        doc, tie, start, end = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
        doc, tie, start, end = doc.view(np.int64), tie.view(np.int64), start.view(np.int64), end.view(np.int64)
        order = np.lexsort((start, tie, doc))
        doc, tie, start, end = doc[order], tie[order], start[order], end[order]
        at = np.flatnonzero(~_same(doc, tie)).tolist()
        stop = [*at[1:], len(doc)]
        ranges = [np.stack((start[a:b], end[a:b]), axis=1).tobytes() for a, b in zip(at, stop, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(doc[at]), pa.array(tie[at]), pa.array(ranges, pa.binary())], names=["kind", "doc_id", "tie", "ranges"])

    now, blobs = None, {}
    for batch in batches:
        for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            if bucket != now and now is not None:
                for k, b in blobs.items():
                    yield flush(k, b)
                blobs = {}
            now = bucket
            blobs.setdefault(kind, []).append(blob)
    for k, b in blobs.items():
        yield flush(k, b)


def _round(rows: DataFrame, length: int, hot: int, piece: int) -> DataFrame:
    """One round over rows (doc_id, tie, at, text): RANGES of repeated and of contested string starts."""
    buckets, partitions = bucketed(rows)
    dealt = by_bucket(rows.mapInArrow(_ranked(length, buckets, hot, piece), ROWS), partitions)
    judged = by_bucket(dealt.mapInArrow(_judged(length, buckets), ROWS), partitions)
    return saved(judged.mapInArrow(_gathered, RANGES), f"ranges-{length}")


def _starts(ranges: bytes) -> np.ndarray:
    """Sorted, joined (first, last) starts."""
    r = np.frombuffer(ranges, "<i8").reshape(-1, 2)
    r = r[np.argsort(r[:, 0], kind="stable")]
    end = np.maximum.accumulate(r[:, 1])
    new = np.concatenate(([True], r[1:, 0] > end[:-1] + 1))
    at = np.flatnonzero(new)
    return np.stack((r[at, 0], np.maximum.reduceat(r[:, 1], at)), axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contested strings: rows (doc_id, tie, at, text) of rows with ranges."""
    for batch in slices(batches, "text"):
        out = []
        for doc, tie, at, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "at", "text", "ranges")), strict=True):
            for a, b in _starts(ranges).tolist():
                a, b = max(a - at, 0), min(b - at + LENGTH, len(text))
                if b - a >= LENGTH:
                    out.append((doc, tie, a + at, text[a:b]))
        if out:
            doc, tie, at, text = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.binary())], names=["doc_id", "tie", "at", "text"])


PIECES = "doc_id long, tie long, at long, text binary"


def _contested(rows: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    known = ranges.where(F.col("kind") == CONTESTED).groupBy("doc_id", "tie").agg(F.array_join(F.collect_list(F.hex("ranges")), "").alias("ranges"))
    known = saved(known.select("doc_id", "tie", F.unhex("ranges").alias("ranges")), "contested")
    return saved(rows.join(known.hint("shuffle_hash"), ["doc_id", "tie"]).mapInArrow(_cut, PIECES), name)


def repeated_ranges(docs: DataFrame, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """(doc_id, tie, ranges) of the documents (doc_id, tie, at, text) that hold strings which also start earlier."""
    found, rows = [], docs
    for length in ROUNDS:
        ranges = _round(rows, length, hot, piece)
        found.append(ranges.where(F.col("kind") == REPEATED).select("doc_id", "tie", "ranges"))
        if length < LENGTH:
            rows = _contested(rows, ranges, f"strings-{length}")
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    joined = both.groupBy("doc_id", "tie").agg(F.array_join(F.collect_list(F.hex("ranges")), "").alias("ranges"))
    return saved(joined.select("doc_id", "tie", F.unhex("ranges").alias("ranges")), "repeated")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
            spans: list[list[int]] = []
            if ranges:
                for a, b in _starts(ranges).tolist():
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b + LENGTH
                    else:
                        spans.append([a, b + LENGTH])
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((None if doc == NO_ID else doc, len(text), b"".join(kept), [x for s in spans for x in s]))
        doc, n, kept, spans = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "kept", "spans"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _removed(batches):
        spans = batch.column("spans").to_pylist()
        n = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        digest = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame, digests: bool = False, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """Each row of docs (doc_id, text) as (doc_id, n_bytes, kept, spans): kept bytes, and first and end of each removed run in turn; or counts and the digest of what is kept.

    hot: segments of one batch from which a rank is frequent; piece: bytes that are ranked at a time.
    """
    rows = small_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
        F.lit(0).cast("long").alias("at"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    ranges = repeated_ranges(rows, hot, piece)
    joined = rows.drop("at").join(ranges.hint("shuffle_hash"), ["doc_id", "tie"], "left")
    if digests:
        return joined.mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, kept binary, spans array<long>")
