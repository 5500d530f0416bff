"""Word and shingle hashes of whole texts, computed in numpy over the bytes of a batch."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def _symbols(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; A-Z get those of a-z if lower."""
    values = mixed(np.arange(1, 257, dtype=U64) * BASE)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_POWERS = {}
KEPT = 1 << 21  # powers that are kept: enough for a batch, not for a single huge text


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= KEPT:
            _POWERS[int(base)] = have
    return have[:n]


def hashed_spans(raw: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each raw[first:end]: a polynomial over prefix sums, or BLAKE2 for spans so long that polynomials modulo 2**64 have known clashes."""
    terms = _symbols(lower)[raw]
    terms *= powers(BASE, len(raw))
    total = np.empty(len(raw) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    hashes = mixed((total[end] - total[first]) * powers(BASE_INVERSE, len(raw))[first])
    for i in np.flatnonzero(end - first > 512).tolist():
        span = raw[first[i] : end[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(span.lower() if lower else span, digest_size=8).digest(), "little")
    return hashes


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, first byte, end byte) of each word [^\\x20\\x09-\\x0D]+, in order; words end at a document's end."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    white = WHITE[raw]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = white[:-1]
    first = np.flatnonzero(~white & (before | begins[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = white[1:]
    end = np.flatnonzero(~white & (after | begins[1:])) + 1
    return hashed_spans(raw, first, end, lower), np.searchsorted(offsets, first, side="right") - 1, first, end


def window_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, first word) of each run of width words inside a document; a document with 1 to width - 1 words gives its whole sequence as one."""
    counts = np.bincount(doc, minlength=n_docs)
    starts = np.concatenate(([0], np.cumsum(counts)))
    m = len(words)
    out = np.zeros(m, dtype=U64)
    for j in range(width):
        out *= BASE
        out[: max(0, m - j)] += mixed(words[j:] + U64(j + 1))
    at = np.arange(m)
    whole = at + width <= starts[doc + 1]
    short = np.flatnonzero((counts > 0) & (counts < width))
    hashes, owner, place = mixed(out[whole]), doc[whole], at[whole]
    if len(short):
        more = np.zeros(len(short), dtype=U64)
        for i, d in enumerate(short):
            h = int(counts[d])
            for w in words[starts[d] : starts[d + 1]].tolist():
                h = (h * 0x9E3779B97F4A7C15 + w) % (1 << 64)
            more[i] = h
        hashes = np.concatenate((hashes, mixed(more ^ U64(0x5851F42D4C957F2D))))
        owner = np.concatenate((owner, short))
        place = np.concatenate((place, starts[short]))
    return hashes, owner, place


def run_hashes(words: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of so many words inside a document, fewer than a shingle has: that of a document of just these words."""
    m = len(words) - length + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.full(m, length, dtype=U64)
    for j in range(length):
        out = out * BASE + words[j : j + m]
    whole = np.flatnonzero(doc[:m] == doc[length - 1 :])
    return mixed(out[whole] ^ U64(0x5851F42D4C957F2D)), whole


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each document, one after another."""
    n_docs = len(offsets) - 1
    words, doc, _, _ = word_hashes(raw, offsets)
    hashes, owner, _ = window_hashes(words, doc, n_docs, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(n_docs + 1))
