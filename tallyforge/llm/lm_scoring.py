"""Language-model scores of whole texts by a trigram trie of Elias-Fano levels.

Model: hierarchical Dirichlet smoothing, P(b|a m) = (c(a m b) + K3 P(b|m)) / (c(a m) + K3) over P(b|m) = (c(m b) + K2 P(b)) /
(c(m) + K2) over P(b) = (c(b) + 0.1) / (N + 0.1 (V + 1)), with counts of the training documents alone. It is stored as
back-off tables: the log10 probability of each n-gram seen, and log10 K / (c + K) for each context. Both are quantised to
steps of 1/4096, rounded down, so that no context's probabilities sum to more than one.

Job: texts are tokenised to blocks of about BLOCK tokens, written once. Each block sends its distinct words, pairs and
triples with their training counts, as sorted 64-bit hashes, to shards dealt by the hash; a shard adds up the counts that
blocks have sent and answers each block in the order of its request. A block asks for an n-gram once, however frequent it
is, so no shard sees a frequent word more often than there are blocks, and no part of the corpus has to fit a task but a
shard's hashes. A block's answers then make a trie of the n-grams of the whole corpus' model that its texts can ask for:
words by rank, for each word its successors, for each pair of words the third ones as places among the second one's
successors; monotone pointers and successors are Elias-Fano levels in a memory-mapped file. Texts are scored by walks
through the trie alone: successor search of a word below its context, of the place below the pair, back-off otherwise.

Null texts count as empty (one end token); a null doc_id counts as the empty text where documents are held out;
repeated rows are documents each; other columns are ignored. Without training documents every token has probability one
by the base. Words meet by 64-bit hashes. A text longer than BLOCK tokens is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import let_go, saved, slices, small_batches, utf8_bytes
from tallyforge.llm.elias_fano import EliasFano, mapped
from tallyforge.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from tallyforge.llm.shingles import BASE, U64, mixed, word_hashes

BLOCK = 1 << 19  # tokens
SHARD = 1 << 21  # n-grams of a level that a shard is sent at most, about
K2, K3 = 8.0, 4.0
STEP = 1 / 4096
END = U64(0x5851F42D4C957F2D)  # stands for the end of a text, which is no word
CHUNK = 1 << 15  # tokens scored at a time


def held_out(doc_id: Column) -> Column:
    """Whether a document's text is not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def token_blocks(docs: DataFrame, train: Column, block: int = BLOCK) -> DataFrame:
    """(block, train_docs, train_tokens, tokens, parts) of all texts; parts: ids (and which are null), train flags, token counts, the distinct words' hashes and the tokens as places among them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number
            ids, nulls, train, lengths, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            words, place = np.unique(tokens, return_inverse=True)
            parts = [pack(ids.view(U64)), pack(nulls), pack(train), pack(lengths), pack_sorted(words), pack(place)]
            row = [[number], [int(train.sum())], [int(lengths[train > 0].sum())], [len(tokens)], [parts]]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in row[:-1]), pa.array(row[-1], pa.list_(pa.binary()))], names=["block", "train_docs", "train_tokens", "tokens", "parts"])

        for batch in slices(batches, "text"):
            raw, offsets = utf8_bytes(batch.column("text"))
            hashes, doc, _, _ = word_hashes(raw, offsets)
            lengths = np.bincount(doc, minlength=batch.num_rows) + 1
            tokens = np.insert(hashes, np.cumsum(lengths - 1), END)
            ids = batch.column("doc_id")
            held.append((ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8), lengths, tokens))
            size += len(tokens)
            if size >= block:
                yield close()
                size = 0
        if held:
            yield close()

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    return texts.mapInArrow(rows, "block long, train_docs long, train_tokens long, tokens long, parts array<binary>")


class Block:
    """The texts of a block: tokens as places among its words, their predecessors (len(words): the start of a text), and the distinct n-grams."""

    def __init__(self, parts: list[bytes]):
        ids, nulls, train, lengths = (unpack(p) for p in parts[:4])
        self.ids, self.nulls, self.train, self.lengths = ids.view(np.int64), nulls > 0, train > 0, lengths.astype(np.int64)
        self.words, self.token = unpack_sorted(parts[4]), unpack(parts[5]).astype(np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.start = len(self.words)
        self.before = np.roll(self.token, 1)
        self.before[self.starts] = self.start
        self.before2 = np.roll(self.before, 1)
        self.before2[self.starts] = -1  # no pair stands before the first token

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes, training count in the block, a token that ends it, which of them each token ends) of the level's n-grams."""
        hashes = np.append(self.words, U64(0x2545F4914F6CDD1D))  # the last one: the start of a text
        at = slice(None) if level < 3 else np.flatnonzero(self.before2 >= 0).astype(np.int32)
        key = mixed(hashes[self.token[at]] ^ U64(level))
        if level > 1:
            key = mixed(key * BASE + hashes[self.before[at]])
        if level > 2:
            key = mixed(key * BASE + hashes[self.before2[at]])
        if not len(key):
            none = np.zeros(0, np.int64)
            return key, none, none, none
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        learned = np.repeat(self.train, self.lengths)[at]
        return distinct, np.bincount(back[learned], minlength=len(distinct)), first if level < 3 else at[first], back.astype(np.int32)


def requests(blocks: DataFrame, level: int, shards: int) -> DataFrame:
    """(shard, block, keys, counts): what each block asks each shard about its n-grams of a level; shards hold even ranges of hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _columns(batches, "block", "parts"):
            keys, counts, _, _ = Block(parts).grams(level)
            shard = ((keys >> U64(32)) * U64(shards)) >> U64(32)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
            spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            for k in range(0, len(spans), 16):
                out = [(int(shard[a]), number, pack_sorted(keys[a:b]), pack(counts[a:b])) for a, b in spans[k : k + 16]]
                yield _batch(out, ("shard", "block", "keys", "counts"), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    return blocks.select("block", "parts").mapInArrow(rows, "shard long, block long, keys binary, counts binary")


def answers(asked: DataFrame, level: int) -> DataFrame:
    """(block, level, shard, counts, seen): the corpus' training counts of what was asked, in that order; seen: distinct n-grams with a count, told in one row of each shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = [unpack_sorted(h[2]) for h in held]
            sizes = np.cumsum([0, *map(len, keys)]).tolist()
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            for h, a, b in zip(held, sizes, sizes[1:]):
                total[back[a:b]] += unpack(h[3]).astype(np.int64)
            seen = int(np.count_nonzero(total))
            for k, (h, a, b) in enumerate(zip(held, sizes, sizes[1:])):
                yield _batch([(h[1], level, h[0], pack(total[back[a:b]]), 0 if k else seen)], ("block", "level", "shard", "counts", "seen"), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))

        held: list[tuple] = []
        for row in _columns(batches, "shard", "block", "keys", "counts"):
            if held and held[0][0] != row[0]:
                yield from close(held)
                held = []
            held.append(row)
        yield from close(held)

    dealt = asked.repartition("shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(rows, "block long, level int, shard long, counts binary, seen long")


def _columns(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=list(names))


def quantised(log10: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities, steps below zero, rounded down; one 0 more, so that place -1 can be read."""
    return np.append(np.minimum(np.ceil(-log10 / STEP), (1 << 16) - 1), 0).astype(np.uint16)


class Trie:
    """Seen words, pairs and triples with probabilities and back-offs.

    base: log10 P of each word; of_word: how often a word (the last one: the start) is a context. Pairs are places of words
    (first, second), triples places of pairs (the first two words, the last two); the counts are the corpus' and positive.
    """

    def __init__(self, base: np.ndarray, of_word: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray):
        n = len(base)
        self.n, self.base = n, base
        key = pairs[0] * n + pairs[1]
        order = np.argsort(key)
        (first, second), count, key = pairs[:, order], pair_counts[order], key[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        node, lower = place[triples]
        pointer = np.searchsorted(first, np.arange(n + 2))
        context, p1 = of_word[first], 10.0 ** base[second]
        p2 = (count + K2 * p1) / (context + K2)
        successors = EliasFano.of(key, (n + 1) * n)
        # a pair's third words are places among the second word's successors; bases keep them apart and monotone
        width = np.diff(pointer)[second]
        bases = np.concatenate(([0], np.cumsum(width)))
        value = bases[node] + lower - pointer[second[node]]
        order = np.argsort(value, kind="stable")
        p3 = (triple_counts + K3 * p2[lower]) / (count[node] + K3)
        levels = [successors, EliasFano.of(pointer, len(first) + 1), EliasFano.of(bases, int(bases[-1]) + 1), EliasFano.of(value[order], int(bases[-1]) + 1)]
        codes = [quantised(np.log10(x)) for x in (K2 / (of_word + K2), p2, K3 / (count + K3), p3[order])]
        self.arrays = mapped([a for level in levels for a in level.arrays()] + codes)
        self.successors, self.pointer, self.bases, self.thirds = (EliasFano(*self.arrays[4 * k : 4 * k + 4], level.n, level.width) for k, level in enumerate(levels))
        self.back2, self.p2, self.back3, self.p3 = self.arrays[16:]

    def pairs(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The place of each token below the one before it (n: the start of a text), -1 where the pair was not seen."""
        return self.successors.find(before.astype(np.int64) * self.n + token)

    def score(self, token: np.ndarray, before: np.ndarray, pair: np.ndarray, node: np.ndarray) -> np.ndarray:
        """log10 P of each token; pair: its place below the one before, node: the place of the pair before it, -1 where there is none or it was not seen."""
        out = np.where(pair >= 0, -STEP * self.p2[pair], self.base[token] - STEP * self.back2[before])
        at = np.flatnonzero(node >= 0)
        node, lower = node[at], pair[at]
        found = np.full(len(at), -1, np.int64)
        known = np.flatnonzero(lower >= 0)
        found[known] = self.thirds.find(self.bases[node[known]] + lower[known] - self.pointer[before[at[known]]])
        out[at] = np.where(found >= 0, -STEP * self.p3[found], out[at] - STEP * self.back3[node])
        return out


def block_scores(block: Block, counts: dict[int, np.ndarray], docs: int, tokens: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each document; docs, tokens and words: of the training documents."""
    hashes, _, ends, _ = block.grams(1)
    count = np.zeros(len(hashes), np.int64)
    count[block.token[ends]] = counts.get(1, count[:0])
    base = np.log10((count + 0.1) / (tokens + 0.1 * (words + 1)))
    _, _, ends2, pair_of = block.grams(2)
    _, _, ends3, _ = block.grams(3)
    c2, c3 = counts[2], counts.get(3, np.zeros(0, np.int64))
    seen, ends3 = np.flatnonzero(c2 > 0), ends3[c3 > 0]
    place = np.zeros(len(c2), np.int64)
    place[seen] = np.arange(len(seen))
    pairs = np.stack((block.before[ends2[seen]], block.token[ends2[seen]])).astype(np.int64)
    triples = place[np.stack((pair_of[ends3 - 1], pair_of[ends3]))]
    trie = Trie(base, np.append(count, docs), pairs, c2[seen], triples, c3[c3 > 0])
    spans = [slice(a, a + CHUNK) for a in range(0, len(block.token), CHUNK)]
    pair = np.concatenate([trie.pairs(block.token[s], block.before[s]) for s in spans])
    node = np.where(block.before2 >= 0, np.roll(pair, 1), -1)
    each = np.concatenate([trie.score(block.token[s], block.before[s], pair[s], node[s]) for s in spans])
    sums = lambda x: np.add.reduceat(x, block.starts)
    return sums((count > 0)[block.token].astype(np.int64)), sums(base[block.token]), sums(each)


def scores(docs: DataFrame, train: Column | None = None, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. train says which documents are learned from (null: not)."""
    spark = docs.sparkSession
    train = ~held_out(F.col("doc_id")) if train is None else F.coalesce(train, F.lit(False))
    blocks = saved(token_blocks(docs, train, block), "lm-blocks")
    n_docs, n_tokens, tokens = (x or 0 for x in blocks.agg(F.sum("train_docs"), F.sum("train_tokens"), F.sum("tokens")).first())
    # one level at a time, the largest first, so that what has been shuffled for one is gone before the texts are
    told = {}
    for level in (3, 2, 1):
        told[level] = saved(answers(requests(blocks, level, max(1, -(-tokens // shard))), level), f"lm-counts-{level}")
        let_go(spark)
    n_words = told[1].agg(F.sum("seen")).first()[0] or 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: Block | None, sent: dict[int, list]) -> Iterator[pa.RecordBatch]:
            if held is None:
                return
            known, base, score = block_scores(held, {k: np.concatenate(v) for k, v in sent.items()}, n_docs, n_tokens, n_words)
            columns = [pa.array(held.ids, mask=held.nulls), ~held.train, held.lengths, known, np.full(len(known), n_tokens, np.int64), base, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        held, counts, now = None, {}, None
        for number, level, parts in _columns(batches, "block", "level", "parts"):
            if number != now:
                yield from close(held, counts)
                held, counts, now = Block(parts), {}, number
            else:
                counts.setdefault(level, []).append(unpack(parts[0]).astype(np.int64))
        yield from close(held, counts)

    both = blocks.select("block", F.lit(0).alias("level"), F.lit(0).cast("long").alias("shard"), "parts")
    for counts in told.values():
        both = both.unionByName(counts.select("block", "level", "shard", F.array("counts").alias("parts")))
    met = both.repartition("block").sortWithinPartitions("block", "level", "shard")
    return small_batches(met).mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
