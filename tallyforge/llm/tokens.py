"""Token ids of whole texts inside Spark tasks, with the tokenizers library and a public vocabulary file.

Words repeat far more often than texts. Where a tokenizer never reaches over a blank, the pieces of a batch (runs of
letters, runs of ASCII marks) are found and hashed in numpy, and the library only sees the pieces that a bounded table
of earlier ones does not hold. Two different pieces would be mixed up only if their 64-bit hashes were equal.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa

from tallyforge.llm.common import utf8_bytes
from tallyforge.llm.shingles import U64, WHITE, hashed_spans

#: Kinds of bytes: 1 letter a-z or A-Z, 2 mark after or before which a word may be cut (apostrophe and the signs of special tokens are not).
KIND = np.zeros(256, dtype=np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 2
SLOTS = 20  # bits
POOL = 1 << 22  # ids of pieces that a worker keeps before it starts again


def _splits_at_blanks(config: dict) -> bool:
    """Whether it lowers, no token reaches over a blank and nothing beside a blank changes how a word is cut."""
    kinds = [config.get("normalizer") or {}, config.get("pre_tokenizer") or {}]
    parts = [p for k in kinds for p in k.get("normalizers", k.get("pretokenizers", [k]))]
    split = [p for p in parts if p.get("type") == "Split"]
    return (
        all(p.get("type") in ("NFC", "Replace", "Lowercase", "Split", "ByteLevel") for p in parts)
        and any(p.get("type") == "Lowercase" for p in parts)
        and any("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in p["pattern"].get("Regex", "") and p["behavior"] == "Removed" and p["invert"] for p in split)
        and all(not p.get("add_prefix_space") for p in parts)
        and all(t["content"][:1] == "<" and t["content"][1:2] == "|" and " " not in t["content"] for t in config.get("added_tokens", []))
    )


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) bytes of the pieces: words, cut where letters and marks meet."""
    n = len(raw)
    white, kind = WHITE[raw], KIND[raw]
    accented = np.zeros(n, dtype=bool)  # ends a letter of U+00C0 to U+00FF, all but the two signs there
    if n > 1:
        accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    starts_accented = np.zeros(n, dtype=bool)
    starts_accented[:-1] = accented[1:]
    letter_end, letter_start, mark = (kind == 1) | accented, (kind == 1) | starts_accented, kind == 2
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    cut[[0, n]] = True
    inner = cut[1:n]
    inner |= white[:-1] != white[1:]
    inner |= letter_end[:-1] & mark[1:]
    inner |= mark[:-1] & letter_start[1:]
    at = np.flatnonzero(cut)
    first, end = at[:-1], at[1:]
    keep = ~white[first]
    return first[keep], end[keep]


class Encoder:
    """Encodes texts with the library; see the module's text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_piece = _splits_at_blanks(json.load(f))
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << SLOTS, dtype=U64)
        self.at = np.zeros(1 << SLOTS, dtype=np.int64)
        self.size = np.zeros(1 << SLOTS, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 18, dtype=np.uint32), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text."""
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, found: list[bytes]) -> list[list[int]]:
        """The ids of pieces; plain letters go straight to the library's model, since nothing else changes them."""
        tokenize = self.library.model.tokenize
        out: list = [[t.id for t in tokenize(p.lower().decode())] if p.isalpha() else None for p in found]  # bytes.isalpha: ASCII only
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.whole([found[i].decode() for i in rest]), strict=True):
            out[i] = ids
        return out

    def _store(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, length) of each."""
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        at = self.used + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return at, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, offsets): the ids of row i are ids[offsets[i]:offsets[i + 1]]. A null text has none."""
        raw, offsets = utf8_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        if not self.by_piece or b"<|" in raw.tobytes():  # special tokens: rare, and whole texts for the library
            ids = self.whole([x or "" for x in column.to_pylist()])
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum())), np.concatenate(([0], np.cumsum(size)))
        if self.used > POOL:
            self._clear()
        first, end = pieces(raw, offsets)
        hashes = hashed_spans(raw, first, end, lower=True)
        slot = (hashes >> U64(64 - SLOTS)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != hashes)
        at, size = self.at[slot], self.size[slot]
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            data = raw.tobytes()
            spans = zip(first[miss[where]].tolist(), end[miss[where]].tolist(), strict=True)
            new_at, new_size = self._store(self._new([data[a:b] for a, b in spans]))
            at[miss], size[miss] = new_at[back], new_size[back]
            slot = (new >> U64(64 - SLOTS)).astype(np.int64)
            self.key[slot], self.at[slot], self.size[slot] = new, new_at, new_size
            slot, last = np.unique(slot[::-1], return_index=True)  # where two share a slot, all three arrays hold the same one
            last = len(new) - 1 - last
            self.key[slot], self.at[slot], self.size[slot] = new[last], new_at[last], new_size[last]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        totals = np.concatenate(([0], ends))
        return ids, totals[np.searchsorted(first, offsets)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)
