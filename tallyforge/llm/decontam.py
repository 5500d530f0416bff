"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

For every word length that an item has, each window of so many words of a document is a possible leak (a shorter
document is one window; windows and items of fewer than five words are one shingle). A window's fingerprint is the SimHash of its five-word shingles with their counts as weights.
The index cuts fingerprints into BLOCKS blocks: two fingerprints within RADIUS bits agree in at least one block up to
RADIUS // BLOCKS bits, so probing each block's table of near values finds every item within the radius. Candidates are
verified by the exact weighted similarity of the shingles: the sum of the smaller counts over the sum of the larger.

Only windows that hold enough shingles of any item at all to reach the similarity are fingerprinted, which loses none.
A true pair at exactly 0.8 is some 10 bits apart, three standard deviations inside RADIUS.

Items come in parts of some ITEMS_AT_ONCE / 2 different ones and ITEM_BYTES / 2 of text, so what is broadcast is bounded
however many items there are, but for a single huge one; each part is a pass over the documents, which never leave their
task. Null and empty texts, and items without words, match nothing; texts of 1 to 4 words are one
shingle; repeated items each report; repeated rows report each; of windows with the same similarity the first counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import id_text, slices, small_batches, utf8_bytes
from tallyforge.llm.shingles import U64, mixed, run_hashes, window_hashes, word_hashes

WIDTH = 5
SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
ITEMS_AT_ONCE, ITEM_BYTES = 4096, 16 << 20
LEAKS = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """SimHash of shingle hashes, each as often as it occurs."""
    bits = np.unpackbits(mixed(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).view(U64)[0]


def fingerprints(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """SimHash of hashes[first:first + size] for each first, some at a time."""
    out = np.zeros(len(first), dtype=U64)
    step = max(1, (1 << 24) // (64 * size))
    for a in range(0, len(first), step):
        windows = mixed(hashes[first[a : a + step, None] + np.arange(size)])
        bits = np.unpackbits(windows.view(np.uint8).reshape(len(windows), size, 8), axis=2)
        out[a : a + step] = np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > size, axis=1).view(U64).ravel()
    return out


class Index:
    """Items with their fingerprints and the block tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw, offsets = utf8_bytes(pa.array(texts, pa.string()))
        words, doc, _, _ = word_hashes(raw, offsets)
        hashes, owner, _ = window_hashes(words, doc, len(texts), WIDTH)
        n_words = np.bincount(doc, minlength=len(texts))
        order = np.argsort(owner, kind="stable")
        parts = np.split(hashes[order], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if len(texts) else []
        kept = [i for i in range(len(texts)) if n_words[i]]
        self.ids = np.array([ids[i] for i in kept], dtype=np.int64)
        self.n_words = n_words[kept].astype(np.int64)
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(parts[i], return_counts=True)), strict=True)) for i in kept]
        self.prints = np.array([fingerprint(parts[i]) for i in kept], dtype=U64)
        self.known = np.unique(hashes)
        # open addressing is not needed: a bitmap of hash prefixes rejects nearly all foreign shingles before the search
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.known >> U64(44)).astype(np.int64)] = True
        self.lengths = np.unique(self.n_words)
        self.short = np.array([next(iter(c)) if n < WIDTH else 0 for c, n in zip(self.counts, self.n_words.tolist(), strict=True)], dtype=U64)
        near = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(BLOCK_BITS), n)]
        near = np.array(near, dtype=np.int64)
        self.tables = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-max(1, len(kept)) // 64)), dtype=U64)
        for i, print_ in enumerate(self.prints):
            for b in range(BLOCKS):
                value = int(print_ >> U64(BLOCK_BITS * b)) & ((1 << BLOCK_BITS) - 1)
                self.tables[b, near ^ value, i // 64] |= U64(1 << (i % 64))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles are of any item."""
        out = self.maybe[(hashes >> U64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.searchsorted(self.known, hashes[at]).clip(max=max(0, len(self.known) - 1))
        out[at] = self.known[place] == hashes[at] if len(self.known) else False
        return out

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs whose fingerprints are within RADIUS bits."""
        near = np.zeros((len(prints), self.tables.shape[2]), dtype=U64)
        for b in range(BLOCKS):
            near |= self.tables[b, ((prints >> U64(BLOCK_BITS * b)) & U64((1 << BLOCK_BITS) - 1)).astype(np.int64)]
        window, item = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)])
        keep = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[keep], item[keep]

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        """Exact weighted similarity of an item and a window's shingles."""
        mine, own = self.counts[item], {}
        for h in hashes.tolist():
            own[h] = own.get(h, 0) + 1
        low = sum(min(n, mine.get(h, 0)) for h, n in own.items())
        return low / (len(hashes) + sum(mine.values()) - low)

    def leaks(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, words) of the best window of each pair that reaches SIMILARITY."""
        n_docs = len(offsets) - 1
        words, doc, _, _ = word_hashes(raw, offsets)
        best = self._short_leaks(words, doc, n_docs)
        hashes, owner, place = window_hashes(words, doc, n_docs, WIDTH)
        order = np.argsort(place, kind="stable")
        hashes, owner, place = hashes[order], owner[order], place[order]
        hit = self.contains(hashes)
        if not hit.any():
            return self._listed(best)
        # from here on only documents with a known shingle
        keep = np.zeros(n_docs, dtype=bool)
        keep[owner[hit]] = True
        keep = keep[owner]
        hashes, owner, place, hit = hashes[keep], owner[keep], place[keep], hit[keep]
        counts = np.bincount(owner, minlength=n_docs)
        start = np.concatenate(([0], np.cumsum(counts)))
        n_words = np.bincount(doc, minlength=n_docs)
        first_word = np.concatenate(([0], np.cumsum(n_words)))
        hits = np.concatenate(([0], np.cumsum(hit)))
        for length in self.lengths[self.lengths >= WIDTH].tolist():
            for size, first in self._windows(length, counts, n_words, start, owner):
                first = first[hits[first + size] - hits[first] >= SIMILARITY * size - 1e-9]
                if not len(first):
                    continue
                for part in np.array_split(first, -(-len(first) // 4096)):
                    window, item = self.within_radius(fingerprints(hashes, part, size))
                    same = self.n_words[item] == length
                    for w, i in zip(window[same].tolist(), item[same].tolist(), strict=True):
                        f = int(part[w])
                        s = self.similarity(i, hashes[f : f + size])
                        key = (int(owner[f]), i)
                        if s >= SIMILARITY and s > best.get(key, (0.0, 0, 0))[0]:
                            d = key[0]
                            best[key] = (s, int(place[f] - first_word[d]), min(length, int(n_words[d])))
        return self._listed(best)

    def _listed(self, best: dict[tuple[int, int], tuple[float, int, int]]) -> list[tuple[int, int, float, int, int]]:
        return [(d, int(self.ids[i]), s, p, n) for (d, i), (s, p, n) in sorted(best.items())]

    def _short_leaks(self, words: np.ndarray, doc: np.ndarray, n_docs: int) -> dict[tuple[int, int], tuple[float, int, int]]:
        """The first window of each document and item of fewer than WIDTH words that are alike: such windows are one shingle, so they are equal."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        first_word = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs))))
        for length in self.lengths[self.lengths < WIDTH].tolist():
            hashes, place = run_hashes(words, doc, length)
            hit = np.flatnonzero(np.isin(hashes, self.short[self.n_words == length]))
            for part in np.array_split(hit, -(-len(hit) // 4096)) if len(hit) else []:
                window, item = self.within_radius(fingerprints(hashes, part, 1))
                same = self.n_words[item] == length
                for w, i in zip(window[same].tolist(), item[same].tolist(), strict=True):
                    f = int(part[w])
                    d = int(doc[place[f]])
                    if (d, i) not in best and self.similarity(i, hashes[f : f + 1]) >= SIMILARITY:
                        best[d, i] = (1.0, int(place[f] - first_word[d]), length)
        return best

    @staticmethod
    def _windows(length: int, counts: np.ndarray, n_words: np.ndarray, start: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shingles a window, its first shingle) for the windows of so many words, and for shorter documents as one window."""
        size = length - WIDTH + 1
        at = np.arange(len(owner))
        yield size, at[(at + size <= start[owner + 1]) & (n_words[owner] >= length)]
        short = np.flatnonzero((counts > 0) & (n_words < length))
        for n in np.unique(counts[short]).tolist():
            yield n, start[short[counts[short] == n]]


def _parts(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items in parts of bounded size; each part is read by itself, and so is each copy of a repeated item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    copies = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = copies.select("item_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(-(-size["n"] // (ITEMS_AT_ONCE // 2)), -(-size["bytes"] // (ITEM_BYTES // 2)))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text", "copy"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in part], [r["text"] for r in part]


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """LEAKS: the best window of each document and item (item_id, text) that are alike."""
    rows = id_text(docs)
    out = None
    for ids, texts in _parts(items):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in slices(batches, "text"):
                found = index.leaks(*utf8_bytes(batch.column("text")))
                if found:
                    d, i, s, p, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array(i, pa.int64()), pa.array(s), pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=[c.split()[0] for c in LEAKS.split(", ")])

        part = rows.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, with its own columns, less the documents that hold a leak; no document is shuffled."""
    docs = small_batches(docs)
    for ids, texts in _parts(items):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in slices(batches, "text"):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in index.leaks(*utf8_bytes(batch.column("text")))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
