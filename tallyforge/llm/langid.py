"""Language identification with a language-bitmask n-gram filter.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each slot has one bit a language, in as many words
of 64 bits as the languages need, and
the AND of an n-gram's slots is the set of languages that contain it (or seem to). A text's language is decided by the
popcount of each bit over the text's n-grams, corrected for the false positives that the filter's fill predicts.

An n-gram counts as contained in a language when it occurs at least MIN_COUNT times in the language's sample and its
share there is at least a quarter of its highest share in any language. The filter is fitted on a bounded, hashed sample
of labelled rows (PER_LANGUAGE documents of each language, expected) and holds all languages and n-grams of it: it takes
8 MB for every 64 languages, more where one has over some 240,000 n-grams, so that no language fills half the slots.
Predictions read every whole text, and neither labels nor sources nor ids.

N-grams are runs of N bytes of the text with A-Z lowered and runs of digits, marks and blanks as spaces. A null text and
a text without a letter give `und` and score 0; a text with letters but without a known n-gram gives the commonest
language and score 0; ties go to the language first in order; repeated rows are judged each. Without labels all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import slices, small_batches, utf8_bytes
from tallyforge.llm.shingles import U64, mixed

N = 4
SLOT_BITS = 20  # at least
HASHES = 3
PER_LANGUAGE = 4000
MIN_COUNT = 3
WORD_BITS = 64
UNKNOWN = "und"

#: Bytes as the n-grams see them: letters and parts of non-ASCII characters stay, A-Z are lowered, all others are spaces.
SEEN = np.array([c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)], dtype=np.uint8)
SPACES = np.uint32(0x20202020)


@dataclass
class Model:
    """slots[l // 64, i] holds bit l % 64 where language l claims slot i; false_rate is by language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    common: int


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram starting at each byte, whether it is whole: inside its document and more than spaces)."""
    seen = np.concatenate((SEEN[raw], np.full(N - 1, 0x20, np.uint8))).astype(np.uint32)
    n = len(raw)
    out = seen[:n].copy()
    for j in range(1, N):
        out |= seen[j : n + j] << np.uint32(8 * j)
    whole = out != SPACES
    ends = offsets[1:]
    for j in range(1, N):
        at = ends - j
        whole[at[at >= 0]] = False
    return out, whole


def _slots(gram: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of n-grams in a filter of n slots, a power of two."""
    h = mixed(gram.astype(U64) + U64(0x1234567))
    first, step = (h >> U64(32)).astype(np.uint32), h.astype(np.uint32) | np.uint32(1)
    return [((first + np.uint32(i) * step) & np.uint32(n - 1)).astype(np.int32) for i in range(HASHES)]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from docs (doc_id, text, lang) that are labelled and not held out."""
    rows = small_batches(docs).select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1 << SLOT_BITS), U64), np.zeros(0), 0)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 52)) < F.try_element_at(share, F.col("lang")) * float(1 << 52))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = utf8_bytes(batch.column("text"))
            gram, whole = grams(raw, offsets)
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.uint64)
            key = np.repeat(lang, np.diff(offsets))[whole] << U64(32) | gram[whole].astype(U64)
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)), pa.array((keys >> U64(32)).astype(np.int32)), pa.array(n)], names=["gram", "lang", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = np.zeros(len(languages))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # the sample is bounded, and so are its n-grams
    table = counted.where(F.col("n") >= MIN_COUNT).toPandas()
    for i in range(len(languages)):
        own = table[table["lang"] == i]
        totals[i] = max(1, own["n"].sum())
        found.append((own["gram"].to_numpy(np.uint32), own["n"].to_numpy(np.float64) / totals[i]))
    everything = np.unique(np.concatenate([g for g, _ in found])) if found else np.zeros(0, np.uint32)
    highest = np.zeros(len(everything))
    for g, share in found:
        at = np.searchsorted(everything, g)
        highest[at] = np.maximum(highest[at], share)
    most = max((len(g) for g, _ in found), default=0)
    n_slots = 1 << max(SLOT_BITS, int(np.ceil(np.log2(max(1, HASHES * most / np.log(2))))))
    slots = np.zeros((-(-len(languages) // WORD_BITS), n_slots), dtype=U64)
    fill = np.zeros(len(languages))
    for i, (g, share) in enumerate(found):
        word, bit = slots[i // WORD_BITS], U64(1 << (i % WORD_BITS))
        for at in _slots(g[share >= highest[np.searchsorted(everything, g)] / 4], n_slots):
            word[at] |= bit  # the same bit for all, so repeated slots do no harm
        fill[i] = np.count_nonzero(word & bit) / len(word)
    return Model(languages, slots, fill**HASHES, languages.index(max(counts, key=lambda x: (counts[x], x))))


def scores(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x languages: n-grams of the language in the document, corrected for false positives."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, len(model.languages)))
    if not len(raw) or not model.languages:
        return out
    gram, whole = grams(raw, offsets)
    places = _slots(gram, model.slots.shape[1])
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    total = sums(whole)
    for k, word in enumerate(model.slots):
        rates = model.false_rate[k * WORD_BITS : (k + 1) * WORD_BITS]
        small = word.astype(np.uint8) if len(rates) <= 8 else word
        mask = small[places[0]]
        for at in places[1:]:
            mask &= small[at]
        mask[~whole] = 0
        for i, rate in enumerate(rates):
            hits = sums((mask >> mask.dtype.type(i)) & mask.dtype.type(1))
            out[:, k * WORD_BITS + i] = np.clip((hits - total * rate) / max(1e-9, 1 - rate), 0, None)
    return out


def lettered(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letter = (SEEN[raw] >= 0x61) & (SEEN[raw] <= 0x7A)
    out = np.diff(np.concatenate(([0], np.cumsum(ascii_letter)))[offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Language and score of each row of docs (text), by names that keep does not have, after the columns to keep (doc_id, if none are named)."""
    keep = ["doc_id"] if keep is None else keep
    rows = small_batches(docs).select(*(F.col(f"`{c}`") for c in (keep if "text" in keep else [*keep, "text"])))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in slices(batches, "text"):
            text = batch.column("text")
            raw, offsets = utf8_bytes(text)
            points = scores(m, raw, offsets)
            if not m.languages:
                best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            else:
                best, total = points.argmax(axis=1), points.sum(axis=1)
                best[total == 0] = m.common
                score = np.where(total > 0, points.max(axis=1) / np.where(total > 0, total, 1), 0.0)
            silent = ~lettered(text, raw, offsets)
            best[silent], score[silent] = -1, 0.0
            columns = [batch.column(c) for c in keep] + [pa.array(known[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    fields = [f for f in rows.schema if f.name in keep]
    return rows.mapInArrow(predict, T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
