"""Alignment of two tokenizations of the same texts by an event sweep.

Each text, a space before it, is encoded by a byte-level BPE (A) and a SentencePiece model (B). The ends of their tokens
are events; A's and B's are one table of event blocks, dealt by document and sorted within partitions by offset. A task
streams through them with a state of constant size: the tokens since the last offset where both sides ended (a cut), the
running digest and counts of the document at hand. Cuts divide a text into groups of A and B tokens; an A and a B token are
linked where their byte ranges overlap. An event block holds the token ids whose ends fall into the same WINDOW bytes; the
ends themselves follow from the ids, as an id has one length in bytes.

How often each pair of ids is linked corpus-wide comes back to the documents by parts of about PART links: a part's
distinct pairs are joined with the counts over all parts, so a pair travels once a part however frequent it is, and the
part's documents are met by a dictionary no larger than the part. Parts are as many as the links ask for, not as there are
tasks: what several tasks hold of PART links is one part.

Words repeat far more often than texts, so a task encodes each distinct piece once: no token of A or B reaches over a blank
that stands after another character and before a visible one, which `_cuttable` checks against B's pieces. Pieces meet by
64-bit hashes in a table of bounded size.

Texts that are null, empty or whose joined tokens differ from space + text have no tokens: zeros and an empty digest.
Repeated rows are documents each; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, slices, small_batches, utf8_bytes
from tallyforge.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from tallyforge.llm.shingles import U64, hashed_spans

WINDOW = 1 << 16  # bytes of text whose token ends are one event block
PART = 1 << 23  # links
SLOTS = 20  # bits
POOL = 1 << 22  # ids of pieces that a worker keeps before it starts again
A, B = 1, 2  # sides; 0 marks a document without tokens
BLANK, META = 0x20, "▁"
#: Bytes that surely begin a visible character: ASCII marks, and leads of no character that counts as white.
VISIBLE = np.zeros(256, dtype=bool)
VISIBLE[[*range(0x21, 0x7F), *(c for c in range(0xC3, 0xF5) if c not in (0xE1, 0xE2, 0xE3))]] = True


def _byte_level() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(c): c for c in plain} | {chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}


def _cuttable(pieces: list[str]) -> bool:
    """Whether no piece holds a blank after another character."""
    return not any(META in p.lstrip(META) for p in pieces)


class Pair:
    """Both tokenizers, the bytes of their tokens, and the pieces that have been encoded."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = _byte_level()
        plain = lambda t: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a: list[bytes] = [b""] * (entries[-1][1] + 1)
        for text, i in entries:
            self.bytes_a[i] = plain(text)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        self.width = [np.array([*map(len, x)], dtype=np.int64) for x in (self.bytes_a, self.bytes_b)]
        with open(path_a, encoding="utf-8") as f:
            split = json.load(f).get("pre_tokenizer") or {}
        self.by_piece = _cuttable(pieces) and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << SLOTS, dtype=U64)
        self.good = np.zeros(1 << SLOTS, dtype=bool)
        self.at = np.zeros((2, 1 << SLOTS), dtype=np.int64)
        self.size = np.zeros((2, 1 << SLOTS), dtype=np.int32)
        self.pool, self.used = [np.zeros(1 << 18, dtype=np.uint32) for _ in (A, B)], [0, 0]

    def whole(self, found: list[bytes]) -> tuple[list, list, list[bool]]:
        """(A's ids, B's ids, whether both give the bytes back) of spans that begin with a space."""
        texts = [x.decode() for x in found]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        same = lambda ids, table, want: b"".join([table[i] for i in ids]) == want
        good = [same(x, self.bytes_a, w) and same(y, self.bytes_b, w) for x, y, w in zip(a, b, found, strict=True)]
        return a, b, good

    def _store(self, side: int, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))
        while self.used[side] + len(flat) > len(self.pool[side]):
            self.pool[side] = np.concatenate((self.pool[side], np.zeros_like(self.pool[side])))
        at = self.used[side] + np.cumsum(size, dtype=np.int64) - size
        self.pool[side][self.used[side] : self.used[side] + len(flat)] = flat
        self.used[side] += len(flat)
        return at, size

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """([(ids, place of each text's first id, and their number) of A and of B], whether each text has tokens). Texts begin with a space."""
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[offsets] = True
        if self.by_piece and len(raw) > 2:
            cut[1:-2] |= (raw[1:-1] == BLANK) & (raw[:-2] != BLANK) & VISIBLE[raw[2:]]
        first = np.flatnonzero(cut[:-1])
        end = np.append(first[1:], len(raw))
        if max(self.used) > POOL:
            self._clear()
        hashes = hashed_spans(raw, first, end, lower=False)
        slot = (hashes >> U64(64 - SLOTS)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != hashes)
        at, size, good = self.at[:, slot], self.size[:, slot], self.good[slot]
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            data = raw.tobytes()
            *sides, fine = self.whole([data[a:b] for a, b in zip(first[miss[where]].tolist(), end[miss[where]].tolist(), strict=True)])
            stored = [self._store(side, ids) for side, ids in enumerate(sides)]
            good[miss] = np.array(fine)[back]
            slot, one = np.unique((new >> U64(64 - SLOTS)).astype(np.int64), return_index=True)  # of pieces that share a slot one stays
            self.key[slot], self.good[slot] = new[one], np.array(fine)[one]
            for side, (new_at, new_size) in enumerate(stored):
                at[side, miss], size[side, miss] = new_at[back], new_size[back]
                self.at[side, slot], self.size[side, slot] = new_at[one], new_size[one]
        owner = np.searchsorted(first, offsets)  # a text's first piece
        bad = np.concatenate(([0], np.cumsum(~good)))
        out = []
        for side in (0, 1):
            ends = np.cumsum(size[side], dtype=np.int64)
            ids = self.pool[side][np.repeat(at[side] - (ends - size[side]), size[side]) + np.arange(ends[-1] if len(ends) else 0)]
            out.append((ids, np.concatenate(([0], ends))[owner]))
        return out, bad[owner[1:]] == bad[owner[:-1]]


@functools.lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    return Pair(path_a, path_b)


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each."""
    n = len(offsets) - 1
    place = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out = np.full(len(raw) + n, BLANK, dtype=np.uint8)
    out[place] = raw
    return out, offsets + np.arange(n + 1)


EVENTS = "doc_id long, row long, at long, side int, ids binary"


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, row, at, side, ids): the event blocks of all texts; row tells repeated ids apart, at is the WINDOW."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = pair(path_a, path_b), TaskContext.get().partitionId() << 33
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            raw, offsets = utf8_bytes(batch.column("text"))
            n = batch.num_rows
            filled = np.diff(offsets) > 0
            found, good = both.encode(*spaced(raw, offsets))
            good &= filled
            out: list[tuple] = [(i, 0, 0, b"") for i in np.flatnonzero(~good).tolist()]
            for side, (ids, starts) in enumerate(found):
                doc = np.repeat(np.arange(n), np.diff(starts))
                ends = np.cumsum(both.width[side][ids])
                ends -= np.concatenate(([0], ends))[starts][doc]  # within the text
                window = (ends - 1) // WINDOW
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (window[1:] != window[:-1]))) & good[doc]) if len(doc) else []
                stop = np.minimum(np.append(first[1:], len(ids)), starts[doc[first] + 1]) if len(first) else []
                data = ids.astype("<u4")
                out += [(int(doc[a]), int(window[a]), side + A, zstd.compress(_planes(data[a:b]))) for a, b in zip(first, stop, strict=True)]
            doc_ids = batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([number + o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())], names=["doc_id", "row", "at", "side", "ids"])
            number += n

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(rows, EVENTS)


def _planes(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes()


def _ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Document:
    """The state of the text at hand."""

    def __init__(self, doc_id: int | None, keep: bool):
        self.doc_id, self.sha, self.text = doc_id, hashlib.sha256(), [] if keep else None
        self.n = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.tokens = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # since the last cut
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def wrote(self, text: bytes) -> None:
        self.sha.update(text)
        if self.text is not None:
            self.text.append(text)

    def row(self) -> tuple:
        keys = np.concatenate([k for k, _ in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        if len(self.pairs) > 1:
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in self.pairs])).astype(np.int64)
        else:
            counts = self.pairs[0][1] if self.pairs else keys
        digest = self.sha.hexdigest() if self.n[0] else ""
        return self.doc_id, *self.n.tolist(), digest, pack_sorted(keys) if len(keys) else b"", pack(counts) if len(keys) else b"", None if self.text is None else b"".join(self.text).decode()


class Sweep:
    """Turns event blocks in order into rows of documents."""

    def __init__(self, both: Pair, keep: bool):
        self.width, self.size_b, self.keep = both.width, len(both.bytes_b), keep
        self.open: Document | None = None
        self.open_row: int | None = None
        most = max(map(len, self.width))
        self.most, self.words = most, [b"%s%d" % (mark, i) for mark in (b"", b",", b"|", b";") for i in range(most)]

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """The rows of the documents that end before the batch's last one."""
        unzip = zstandard.ZstdDecompressor()
        row = batch.column("row").to_numpy()
        side = batch.column("side").to_numpy()
        new = np.concatenate(([row[0] != self.open_row], row[1:] != row[:-1]))
        ids = batch.column("doc_id")
        if self.open is not None and new[0]:
            yield self.open.row()
            self.open = None
        docs = [] if self.open is None else [self.open]
        doc = np.cumsum(new) - (self.open is None)
        docs += [Document(ids[i].as_py(), self.keep) for i in np.flatnonzero(new).tolist()]
        flat = [[], []]
        for d, s, data in zip(doc.tolist(), side.tolist(), batch.column("ids").to_pylist(), strict=True):
            if s:
                flat[s - A].append((d, _ids(unzip.decompress(data))))
        tokens, owner = [], []
        for s in (0, 1):
            parts = [(0, docs[0].tokens[s]), *flat[s]]
            tokens.append(np.concatenate([x for _, x in parts]))
            owner.append(np.repeat([d for d, _ in parts], [len(x) for _, x in parts]))
        docs[0].tokens = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self._settle(docs, tokens, owner)
        for d in docs[:-1]:
            yield d.row()
        self.open, self.open_row = docs[-1], int(row[-1])

    def end(self) -> Iterator[tuple]:
        if self.open is not None:
            yield self.open.row()

    def _settle(self, docs: list[Document], tokens: list[np.ndarray], owner: list[np.ndarray]) -> None:
        """Adds all that lies before the last cut; both sides begin at the same offset, as texts end on both at once."""
        (a, b), (doc_a, doc_b) = tokens, owner
        end_a, end_b = np.cumsum(self.width[0][a]), np.cumsum(self.width[1][b])
        if not len(a) or not len(b):
            docs[-1].tokens = [a, b]
            return
        meet = np.searchsorted(end_b, end_a)
        cut_a = end_b[np.minimum(meet, len(b) - 1)] == end_a
        at = np.flatnonzero(cut_a)
        n_a, n_b = (int(at[-1]) + 1, int(meet[at[-1]]) + 1) if len(at) else (0, 0)
        docs[-1].tokens = [a[n_a:], b[n_b:]]
        if not n_a:
            return
        a, b, doc_a, doc_b, end_a, end_b, cut_a = a[:n_a], b[:n_b], doc_a[:n_a], doc_b[:n_b], end_a[:n_a], end_b[:n_b], cut_a[:n_a]
        cut_b = np.zeros(n_b, dtype=bool)
        cut_b[meet[at]] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        # the text of the groups: A's ids, then B's, by group
        last_a, last_b = at + 1, meet[at] + 1  # tokens up to each group's end
        order = np.empty(n_a + n_b, np.int64)
        code = np.empty(n_a + n_b, np.int64)
        first_a, first_b = np.concatenate(([True], cut_a[:-1])), np.concatenate(([True], cut_b[:-1]))
        place_a = np.arange(n_a) + np.concatenate(([0], last_b))[group_a]
        place_b = np.arange(n_b) + last_a[group_b]
        code[place_a] = a + self.most * np.where(first_a, 3, 1)
        code[place_b] = b + self.most * np.where(first_b, 2, 1)
        order[place_a], order[place_b] = doc_a, doc_b
        # links: the B tokens that begin before an A token ends and end after it begins
        low = np.searchsorted(end_b, end_a - self.width[0][a], side="right")
        links = np.searchsorted(end_b - self.width[1][b], end_a) - low
        ends = np.cumsum(links)
        partner = b[np.arange(ends[-1]) + np.repeat(low - (ends - links), links)]
        key = np.repeat(a * self.size_b + doc_a * len(self.width[0]) * self.size_b, links) + partner
        key.sort()
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, count = key[begins], np.diff(np.append(begins, len(key)))
        base = np.arange(len(docs) + 1)
        bounds = np.searchsorted(key, base * (len(self.width[0]) * self.size_b))
        spans = np.searchsorted(order, base)
        counted = np.stack([np.bincount(doc_a, minlength=len(docs)), np.bincount(doc_b, minlength=len(docs)), np.bincount(doc_a[cut_a], minlength=len(docs)), np.bincount(doc_a, links, minlength=len(docs)).astype(np.int64)], axis=1)
        for i, d in enumerate(docs):
            if not counted[i, 0]:
                continue
            if not d.n[0]:
                code[spans[i]] -= 3 * self.most  # nothing stands before a text's first id
            d.wrote(b"".join(map(self.words.__getitem__, code[spans[i] : spans[i + 1]].tolist())))
            d.n += counted[i]
            d.pairs.append((key[bounds[i] : bounds[i + 1]] - i * len(self.width[0]) * self.size_b, count[bounds[i] : bounds[i + 1]]))


SWEPT = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary, groups string"


def swept(found: DataFrame, path_a: str, path_b: str, groups: bool = False, part: int = PART) -> DataFrame:
    """One row per document: counts, digest and, if asked for, text of its groups; its distinct pairs of linked ids (A's * B's vocabulary + B's) and how often each is linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sweep, links, task = Sweep(pair(path_a, path_b), groups), 0, TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.string())
        names = [c.split()[0] for c in SWEPT.split(", ")]

        def out(done: list[tuple]) -> pa.RecordBatch:
            nonlocal links
            full = []
            for d in done:
                full.append((task + links // part, *d))
                links += d[4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*full, strict=True)), kinds, strict=True)], names=names)

        for batch in batches:
            if batch.num_rows and (done := [*sweep.take(batch)]):
                yield out(done)
        if done := [*sweep.end()]:
            yield out(done)

    dealt = small_batches(found).repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "at", "side")
    return dealt.mapInArrow(rows, SWEPT)


def pairs_of(documents: DataFrame) -> DataFrame:
    """(part, pair, n): how often each pair is linked in a part, in one row or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size = None, 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts = summed()
                for a in range(0, len(keys), 1 << 16):
                    k = keys[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), now)), pa.array(k.astype(np.int64)), pa.array(counts[a : a + (1 << 16)])], names=["part", "pair", "n"])
            held.clear()

        for batch in batches:
            for part, keys, counts in zip(batch.column("part").to_pylist(), batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if part != now:
                    yield from close()
                    now, size = part, 0
                held.append((unpack_sorted(keys), unpack(counts).astype(np.int64)))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held[:] = [summed()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from close()
                        size = 0
        yield from close()

    return documents.where("n_links > 0").select("part", "pairs", "counts").mapInArrow(rows, "part long, pair long, n long")


def joint_parts(documents: DataFrame, part: int = PART) -> DataFrame:
    """documents with small parts put together, in order, to parts of about so many links (twice as many, and a document, at most)."""
    sizes = documents.groupBy("part").agg(F.sum("n_links").alias("links"))  # a row a task, or for each PART links
    before = F.coalesce(F.sum("links").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joint = sizes.select(F.col("part").alias("old"), F.floor(before / part).alias("joint"))
    return documents.join(F.broadcast(joint), F.col("part") == F.col("old")).withColumn("part", F.col("joint")).drop("old", "joint")


def pair_counts(told: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): corpus-wide counts of linked ids, and whether no other A id is linked more often with the B id."""
    total = told.groupBy("pair").agg(F.sum("n").alias("count"))
    most = total.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of B at most
    return total.join(F.broadcast(most), F.col("pair") % size_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, part: int = PART) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups (``a1,a2|b1;a3|b2``)."""
    size_b = len(pair(path_a, path_b).bytes_b)
    documents = joint_parts(saved(swept(events(docs, path_a, path_b), path_a, path_b, groups, part), "aligned"), part)
    told = saved(pairs_of(documents).groupBy("part", "pair").agg(F.sum("n").alias("n")), "linked-ids")
    known = told.join(pair_counts(told, size_b), "pair").select("part", F.lit(0).alias("kind"), "pair", "count", "best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts", "groups"]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            part_of, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((part_of[1:] != part_of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(part_of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if part_of[a] != now:
                    now, held, table = part_of[a], [], None
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(tuple(piece.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))
                    continue
                if table is None:
                    keys, count, best = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
                    order = np.argsort(keys, kind="stable")
                    table, held = (keys[order], count[order], best[order].astype(bool)), []
                n_best, count_sum = [], []
                for keys, counts in zip(piece.column("pairs").to_pylist(), piece.column("counts").to_pylist(), strict=True):
                    if not keys:
                        n_best.append(0)
                        count_sum.append(0)
                        continue
                    at, n = np.searchsorted(table[0], unpack_sorted(keys).astype(np.int64)), unpack(counts).astype(np.int64)
                    n_best.append(int(n[table[2][at]].sum()))
                    count_sum.append(int((n * table[1][at]).sum()))
                columns = [piece.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), piece.column("groups_sha256"), piece.column("groups")], names=names)

    sent = documents.select("part", F.lit(1).alias("kind"), *kept).unionByName(known, allowMissingColumns=True)
    met = small_batches(sent).repartition("part").sortWithinPartitions("part", "kind")
    out = met.mapInArrow(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return out if groups else out.drop("groups")
