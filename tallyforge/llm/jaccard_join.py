"""Exact n-gram Jaccard join with prefix filters under several global orders.

Documents are sets of five-word shingles. If two sets are alike to SIMILARITY, they share a shingle among the first
n - ceil(SIMILARITY * n) + 1 of each under any global order, so candidates have to share such prefix shingles under
every one of ORDERS orders at once before they are verified. The first order goes by document frequency and the second
by its power of two, rare shingles first, with ties broken by different hashes; the third puts shingles of a single set
first and takes all others in the order of a hash alone.

1. Each document's shingles go, packed by batch, to the task of their hash bucket, where it is counted how many batches'
   sets have them, and come back to the task of the batch only if another set has them. In between a set is its place in
   its batch, and a shingle what its bucket does not tell of its hash, so a shingle takes 8 bytes however many buckets
   there are. Equal sets are one within a batch; of those in several batches one is named to stand for all. A shingle
   that is frequent within a batch is not listed with its sets: it counts as commonest of all, everywhere.
2. A set whose prefix holds only shingles of its own has no partner. The few others keep their shared shingles.
3. Sets that are connected through prefix shingles of the first order form a block; links lie inside blocks.
4. Blocks are verified in tasks of bounded size. A large block is cut: all its sets meet a first part; what that links is
   one component, whose inner pairs need no check. Sets outside of it then meet the sets that share one of their prefix
   shingles, by buckets of those shingles, of which only large ones are cut again. No task lists pairs: it returns for
   each set a set it is linked to, if any, so hot groups of near copies stay linear in what they emit.
5. Connected components of those links give the classes.

A null text or one without words is an empty set and linked with nothing; a text with fewer than five words is one
shingle; equal sets are one set, whose rows are linked; repeated rows are rows each; a null id loses against any other.
Sets, and equality of shingles, are by 64-bit hashes. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bucketed, by_bucket, id_text, saved, slices, utf8_bytes
from tallyforge.llm.shingles import U64, mixed, shingle_sets
from tallyforge.operators.links import components
from tallyforge.operators.lookups import lookup

PERCENT = 80
ORDERS = 3
HOT = 16  # sets of a batch that hold a shingle
COMMON = np.uint32(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).max
#: Kinds of packed rows.
LISTED, FREQUENT, SIZES, COMMON_OF, DOCUMENTS, NODES, REPEATED = range(7)
ROWS = "kind int, bucket int, blob binary"
PART = 100  # sets of a block in one part of a task
BUCKETS_SORTED = 24  # at most in a shuffle partition: what is sorted by bucket stays in memory


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n of which a partner has one, under any order."""
    return n - -(-PERCENT * n // 100) + 1


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], dtype="<i8")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, "<i8", 1)[0])
    head = np.frombuffer(blob, "<i8", 2 * k, 8)
    out, at = [], 8 + 16 * k
    for n, size in zip(head[:k].tolist(), head[k:].tolist(), strict=True):
        out.append(np.frombuffer(blob, f"<u{size}", n, at))
        at += n * size
    return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["kind", "bucket", "blob"])


def _split(by: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' entries by bucket, each bucket that has any."""
    order = np.argsort(by, kind="stable")
    at = np.searchsorted(by[order], np.arange(n + 1))
    arrays = tuple(a[order] for a in arrays)
    for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield b, [a[at[b] : at[b + 1]] for a in arrays]


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in as few bytes as its values need."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _short(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What the bucket does not tell of hashes, as bytes: seven each, or eight where buckets are few."""
    rest = hashes // U64(buckets)
    return rest if buckets < 256 else rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].ravel()


def _whole(short: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The hashes of a bucket that _short was made of."""
    if buckets >= 256:
        wide = np.zeros((len(short) // 7, 8), dtype=np.uint8)
        wide[:, :7] = short.reshape(-1, 7)
        short = wide.ravel().view("<u8")
    return short.astype(U64) * U64(buckets) + U64(bucket)


def _dealt(buckets: int, partitions: int):
    """Step 1, beside the text: shingles of each batch by bucket, and what goes to the tasks of batches.

    A batch is named by a hash of its sets in order, so a task that runs again names it the same; batches of one name are
    one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        for batch in slices(batches, "text"):
            turn += 1
            hashes, at = shingle_sets(*utf8_bytes(batch.column("text")))
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed(hashes), dtype=U64)))
            node = mixed(total[at[1:]] - total[at[:-1]] + size.astype(U64))
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)
            rows = [(DOCUMENTS, turn % buckets, _packed(ids.view(U64), size.astype(np.uint32), node))]
            # equal sets of a batch are sent once
            _, first = np.unique(node, return_index=True)
            once = np.zeros(len(size), dtype=bool)
            once[first] = True
            once &= size > 0
            keep = once[owner]
            place = np.cumsum(once) - 1
            hashes, owner = hashes[keep], place[owner[keep]]
            node, size = node[once], size[once]
            name = np.array([np.sum(mixed(node + mixed(np.arange(1, len(node) + 1, dtype=U64))), dtype=U64)])
            home = int(name[0] % U64(buckets))
            rows.append((SIZES, home, _packed(name, node, size.astype(np.uint32))))
            for b, (n, i) in _split((node % U64(partitions)).astype(np.int64), partitions, node, np.arange(len(node), dtype=np.uint32)):
                rows.append((NODES, b, _packed(name, n, _narrow(i))))
            value, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            hot = count >= HOT
            for b, (v,) in _split((value[hot] % U64(buckets)).astype(np.int64), buckets, value[hot]):
                rows.append((FREQUENT, b, _packed(v)))
            hot = hot[back]
            if hot.any():
                rows.append((COMMON_OF, home, _packed(name, _narrow(owner[hot]), hashes[hot])))
            hashes, owner = hashes[~hot], owner[~hot]
            for b, (o, v) in _split((hashes % U64(buckets)).astype(np.int64), buckets, owner, hashes):
                # stable order: o ascends, so that the steps between are small numbers
                rows.append((LISTED, b, _packed(name, _narrow(np.diff(o, prepend=0)), _short(v, buckets))))
            yield _batch(rows)

    return run


def _groups(batches: Iterator[pa.RecordBatch], through: tuple[int, ...]) -> Iterator[tuple[int, dict[int, list[bytes]], list[tuple]]]:
    """(bucket, blobs by kind, rows to pass on) of rows that come sorted by bucket."""
    now, blobs, others = None, {}, []
    for batch in batches:
        for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            if kind in through:
                others.append((kind, bucket, blob))
                if len(others) > 64:
                    yield -1, {}, others
                    others = []
                continue
            if bucket != now and now is not None:
                yield now, blobs, []
                blobs = {}
            now = bucket
            blobs.setdefault(kind, []).append(blob)
    if now is not None:
        yield now, blobs, []
    if others:
        yield -1, {}, others


def _counted(buckets: int):
    """Step 1, by shingle: document frequencies, sent to the batches whose sets share a shingle; and which sets another batch has, too."""

    def repeated(blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
        """The places of sets that another batch stands for, of all that have one of these nodes."""
        parts = [_unpacked(b) for b in blobs]
        name = np.concatenate([np.repeat(m, len(n)) for m, n, _ in parts])
        node = np.concatenate([n for _, n, _ in parts])
        place = np.concatenate([i.astype(np.uint32) for _, _, i in parts])
        order = np.lexsort((name, node))
        name, node, place = name[order], node[order], place[order]
        again = name != name[np.searchsorted(node, node)]  # a batch that came twice stands for itself
        return [(REPEATED, b, _packed(*x)) for b, x in _split((name[again] % U64(buckets)).astype(np.int64), buckets, name[again], place[again])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs, others in _groups(batches, (SIZES, COMMON_OF, DOCUMENTS)):
            if bucket < 0:
                yield _batch(others)
                continue
            rows = repeated(blobs[NODES]) if NODES in blobs else []
            parts = {int(m[0]): (steps, v) for m, steps, v in map(_unpacked, blobs.get(LISTED, []))}
            if parts:
                names = np.array(list(parts), dtype=U64)
                lengths = [len(steps) for steps, _ in parts.values()]
                name = np.repeat(names, lengths)
                place = np.concatenate([np.cumsum(steps, dtype=np.uint32) for steps, _ in parts.values()])
                short = np.concatenate([v for _, v in parts.values()])
                shingle = _whole(short, bucket, buckets)
                value, back, count = np.unique(shingle, return_inverse=True, return_counts=True)
                count = count.astype(np.uint32)
                if FREQUENT in blobs:
                    count[np.isin(value, np.concatenate([_unpacked(b)[0] for b in blobs[FREQUENT]]))] = COMMON
                count = count[back]
                shared = count > 1
                name, place, shingle, count = name[shared], place[shared], shingle[shared], count[shared]
                for b, (m, i, v, c) in _split((name % U64(buckets)).astype(np.int64), buckets, name, place, shingle, count):
                    begins = np.flatnonzero(np.diff(m, prepend=~m[:1]))
                    rows.append((LISTED, b, _packed(m[begins], np.diff(begins, append=len(m)).astype(np.uint32), _narrow(i), np.array([bucket], U64), _short(v, buckets), _narrow(c))))
            if rows:
                yield _batch(rows)

    return run


SETS = "doc_id long, node long, n long, shingles binary, counts binary"


def _kept(buckets: int):
    """Step 2, by batch: a row for each document, and for each set that may have a partner its shared shingles."""
    names = [c.split()[0] for c in SETS.split(", ")]

    def rows(ids, node, n, shingles=None, counts=None) -> pa.RecordBatch:
        none = pa.nulls(len(node), pa.binary())
        doc = pa.nulls(len(node), pa.int64()) if ids is None else pa.array(ids, pa.int64(), mask=ids == NO_ID)
        return pa.RecordBatch.from_arrays([doc, pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), none if shingles is None else pa.array(shingles, pa.binary()), none if counts is None else pa.array(counts, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs, others in _groups(batches, (DOCUMENTS,)):
            if bucket < 0:
                for _, _, blob in others:
                    ids, n, node = _unpacked(blob)
                    yield rows(ids.view(np.int64), node, n)
                continue
            there = {int(m[0]): (node, size) for m, node, size in map(_unpacked, blobs.get(SIZES, []))}
            known = np.array(sorted(there), dtype=U64)
            start = np.cumsum([0, *(len(there[m][0]) for m in sorted(there))])
            if not start[-1]:
                continue
            node = np.concatenate([there[m][0] for m in sorted(there)])
            size = np.concatenate([there[m][1] for m in sorted(there)]).astype(np.int64)
            at_of = lambda m, i: start[np.searchsorted(known, m)] + i.astype(np.int64)
            # batches of one name send the same, so each is read once
            listed = [(at_of(np.repeat(m, k), i), _whole(v, int(b[0]), buckets), c.astype(np.uint32)) for m, k, i, b, v, c in map(_unpacked, blobs.get(LISTED, []))]
            common = {int(m[0]): (m, i, v) for m, i, v in map(_unpacked, blobs.get(COMMON_OF, []))}
            listed += [(at_of(np.repeat(m, len(v)), i), v, np.full(len(v), COMMON, np.uint32)) for m, i, v in common.values()]
            if not listed:
                continue
            own, shingle, count = (np.concatenate(x) for x in zip(*listed, strict=True))
            order = np.lexsort((shingle, own))
            own, shingle, count = own[order], shingle[order], count[order]
            at = np.searchsorted(own, np.arange(len(node) + 1))
            alive = size - np.diff(at) < prefix_size(size)
            for m, i in map(_unpacked, blobs.get(REPEATED, [])):
                alive[at_of(m, i)] = False
            pick = np.flatnonzero(alive).tolist()
            for i in range(0, len(pick), 500):
                some = pick[i : i + 500]
                yield rows(None, node[some], size[some], [shingle[at[k] : at[k + 1]].tobytes() for k in some], [count[at[k] : at[k + 1]].tobytes() for k in some])

    return run


def _ordered(shingles: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """The permutation that puts a set's shared shingles in a global order."""
    rank = (counts, np.frexp(counts.astype(np.float64))[1], np.zeros(len(counts), np.uint8))[order]
    return np.lexsort((mixed(shingles ^ U64(0x9E37 + order)), rank))


def prefixes(n: int, shingles: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """A set's prefix shingles that other sets have too; those of its own come before all of them."""
    return shingles[_ordered(shingles, counts, order)[: max(0, int(prefix_size(np.int64(n))) - (n - len(shingles)))]]


class Group:
    """Sets of one block in one task: which of them are linked."""

    def __init__(self, n: list[int], shingles: list[bytes], counts: list[bytes]):
        self.n = np.array(n, dtype=np.int64)
        sets = [np.frombuffer(s, U64) for s in shingles]
        weights = [np.frombuffer(c, np.uint32) for c in counts]
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.n_values = len(values)
        self.left = [0] * (ORDERS + 1)
        self.lists = []  # of each order: prefix shingle -> sets, set -> prefix shingles
        for order in range(ORDERS):
            own = [np.searchsorted(values, prefixes(int(k), s, w, order)) for k, s, w in zip(n, sets, weights, strict=True)]
            at = np.concatenate(([0], np.cumsum([len(o) for o in own])))
            flat = np.concatenate(own)
            owner = np.repeat(np.arange(len(own)), np.diff(at))
            sort = np.argsort(flat, kind="stable")
            self.lists.append((own, owner[sort], np.searchsorted(flat[sort], np.arange(self.n_values + 1))))

    def candidates(self, i: int, among: np.ndarray) -> np.ndarray:
        """Sets of among (a mask) that share a prefix shingle with set i under every order and are of a fitting size.

        self.left counts what each step leaves: sizes first, then order by order.
        """
        found = among & (100 * np.minimum(self.n, self.n[i]) >= PERCENT * np.maximum(self.n, self.n[i]))
        self.left[0] += np.count_nonzero(found)
        for order, (own, owner, at) in enumerate(self.lists):
            hit = np.zeros(len(self.n), dtype=bool)
            for p in own[i].tolist():
                hit[owner[at[p] : at[p + 1]]] = True
            found &= hit
            self.left[order + 1] += np.count_nonzero(found)
        return np.flatnonzero(found)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that are alike to SIMILARITY, exactly."""
        if not len(others):
            return others
        mark = np.zeros(self.n_values, dtype=np.int64)
        mark[self.flat[self.start[i] : self.start[i + 1]]] = 1
        size = self.size[others]
        ends = np.cumsum(size)
        at = np.repeat(self.start[others] - (ends - size), size) + np.arange(ends[-1])
        sums = np.concatenate(([0], np.cumsum(mark[self.flat[at]])))
        both = sums[ends] - sums[ends - size]
        return others[100 * both >= PERCENT * (self.n[i] + self.n[others] - both)]

    def forest(self, left: np.ndarray, right: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
        """Links (i, j) that join all components of linked pairs from left x right (masks), beyond what root joins already."""
        root, out = root.copy(), []
        clean = np.argsort(self.n - self.size, kind="stable")
        for i in clean[left[clean]].tolist():
            among = right & (root != root[i])
            for j in self.linked(i, self.candidates(i, among)).tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
        return out


LINKS = "a long, b long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: rows (task, side, node, root, n, shingles, counts) sorted by task, as links.

    side 1: a set on the left, 2: on the right, 3: on both.
    """

    def close(rows: list[dict]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        sides = {}
        for r in rows:  # a set that is sent for both sides comes twice
            if r["node"] in sides:
                sides[r["node"]]["side"] |= r["side"]
            else:
                sides[r["node"]] = r
        rows = list(sides.values())
        group = Group([r["n"] for r in rows], [r["shingles"] for r in rows], [r["counts"] for r in rows])
        side = np.array([r["side"] for r in rows])
        _, root = np.unique([r["root"] for r in rows], return_inverse=True)
        links = group.forest(side & 1 > 0, side & 2 > 0, root)
        if not links:
            return None
        return pa.RecordBatch.from_arrays([pa.array([rows[i]["node"] for i, _ in links], pa.int64()), pa.array([rows[j]["node"] for _, j in links], pa.int64())], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["task"] != now:
                if (out := close(rows)) is not None:
                    yield out
                now, rows = r["task"], []
            rows.append(r)
    if (out := close(rows)) is not None:
        yield out


def _tasks(rows: DataFrame) -> DataFrame:
    """rows dealt by task and verified."""
    columns = ["task", "side", "node", "root", "n", "shingles", "counts"]
    return rows.select(*columns).repartition("task").sortWithinPartitions("task").mapInArrow(_verify, LINKS)


def set_roots(sets: DataFrame, part: int = PART) -> DataFrame:
    """(node, root) of the sets (node, n, shingles, counts) that are alike to another, by class."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, s, c = (batch.column(x).to_pylist() for x in ("node", "n", "shingles", "counts"))
            own = [prefixes(k, np.frombuffer(a, U64), np.frombuffer(b, np.uint32), 0) for k, a, b in zip(n, s, c, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(node, np.int64), [len(o) for o in own])), pa.array(np.concatenate(own).view(np.int64))], names=["node", "shingle"])

    posted = saved(sets.select("node", "n", "shingles", "counts").mapInArrow(postings, "node long, shingle long"), "postings")
    hubs = saved(posted.groupBy("shingle").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1"), "hubs")
    blocks = components(lookup(posted, hubs, "shingle", "k").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("root", "block")
    own = sets.select("node", "n", (F.length("shingles") / 8).cast("long").alias("c"))
    sized = saved(own.join(blocks, "node").select("node", "block", "n", "c"), "sized")
    stats = saved(sized.groupBy("block").agg(F.min("n").alias("least"), F.ceil(F.count(F.lit(1)) / part).alias("parts"), F.count(F.lit(1)).alias("k")), "block-sizes")
    # the smallest set of a block bounds what the others need to share with anything there
    fit = lookup(sized, stats, "block", "k").where(F.col("c") * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("least"))).select("node", "block", "parts")
    members = saved(sets.join(fit, "node").select("node", "n", "shingles", "counts", "block", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "parts"), "members")
    # each set meets part 0 of its block; a block of one part is then done
    first = members.withColumn("root", F.col("node")).withColumn("to", F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))))
    first = first.withColumn("task", F.struct("block", F.col("to").alias("x"), F.lit(0).cast("long").alias("y")))
    first = first.withColumn("side", F.when(F.col("part") > 0, 2).when(F.col("to") > 0, 1).otherwise(3))
    roots = components(_tasks(_packed_task(first)))
    if members.where("parts > 1").isEmpty():
        return roots
    large = members.where("parts > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    large = saved(large, "large-blocks")
    more = saved(_tasks(_packed_task(_second_meetings(large, members, posted, part))), "second-links")
    if more.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("n"), F.col("root").alias("r"))
    named = more.join(known, F.col("a") == F.col("n"), "left").select(F.coalesce("r", "a").alias("a"), "b")
    named = named.join(known, F.col("b") == F.col("n"), "left").select("a", F.coalesce("r", "b").alias("b"))
    later = saved(components(named), "later-roots").select(F.col("node").alias("old"), F.col("root").alias("new"))
    every = roots.unionByName(later.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    return every.join(later, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def _second_meetings(large: DataFrame, members: DataFrame, posted: DataFrame, part: int) -> DataFrame:
    """Rows for _verify of the large blocks (node, block, parts, root): sets outside the largest component of their block with all that share a prefix shingle of theirs.

    A set is sent once for each bucket of its own prefix shingles, so rows grow with the sets and not with pairs of
    parts of a block; only a bucket that is itself large is cut into parts, each of which meets each part of its rest.
    """
    sizes = large.groupBy("block", "root").count().groupBy("block").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("k"))
    giants = saved(sizes.where("m.count < k").select("block", F.col("m.root").alias("giant"), "k"), "giants")
    sets = saved(lookup(large.select("node", "block", "parts", "root"), giants, "block", "k").withColumn("rest", F.col("root") != F.col("giant")), "second-sets")
    asked = posted.join(sets.where("rest").select("node"), "node", "left_semi").groupBy("shingle").count().select("shingle")
    held = posted.join(asked, "shingle", "left_semi").join(sets, "node").withColumn("bucket", F.pmod(F.xxhash64("shingle"), F.col("parts")))
    held = saved(held.select("node", "root", "rest", F.struct("block", "bucket").alias("bucket")).distinct(), "second-buckets")
    stats = saved(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.count_if("rest").alias("r")).where("r > 0"), "second-sizes")
    stats = stats.select("bucket", "k", F.ceil(F.col("k") / part).alias("xs"), F.ceil(F.col("r") / part).alias("ys"))
    placed = lookup(held, stats, "bucket", "k").withColumn("x", F.pmod(F.xxhash64("node"), F.col("xs"))).withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ys")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.select("node", "root", "bucket", "x", every("ys").alias("y"), F.lit(1).alias("side"))
    right = placed.where("rest").select("node", "root", "bucket", every("xs").alias("x"), "y", F.lit(2).alias("side"))
    met = left.unionByName(right).withColumn("task", F.struct(F.concat_ws("-", F.col("bucket.block").cast("string"), F.col("bucket.bucket").cast("string")).alias("block"), "x", "y"))
    return met.join(members.select("node", "n", "shingles", "counts"), "node")


def _packed_task(rows: DataFrame) -> DataFrame:
    """The task's name as text, which Arrow compares fast."""
    return rows.withColumn("task", F.concat_ws(":", *(F.col(f"task.{c}").cast("string") for c in ("block", "x", "y"))))


def jaccard_join(docs: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    texts = id_text(docs)
    buckets, partitions = bucketed(texts)
    partitions = max(partitions, -(-buckets // BUCKETS_SORTED))
    dealt = by_bucket(texts.mapInArrow(_dealt(buckets, partitions), ROWS), partitions)
    counted = by_bucket(dealt.mapInArrow(_counted(buckets), ROWS), partitions)
    sets = saved(counted.mapInArrow(_kept(buckets), SETS), "shingle-sets")
    rows = sets.where("shingles is null").select("doc_id", "node", F.col("n").alias("n_shingles"))
    roots = set_roots(sets.where("shingles is not null"), part)
    # equal sets share a node and a class its root, so both are met as keys that may hold a large share of the rows
    weights = saved(rows.groupBy("node").agg(F.count(F.lit(1)).alias("w")).join(roots, "node", "left").select("node", "w", F.coalesce("root", "node").alias("root")), "nodes")
    placed = saved(lookup(rows, weights, "node", "w").select("doc_id", "n_shingles", "root"), "placed")
    filled = placed.where("n_shingles > 0")
    least = saved(filled.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("w")), "classes")
    linked = lookup(filled, least, "root", "w").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, with its own columns, less all but the least id of each class; of repeated rows one stays."""
    classes = saved(jaccard_join(docs), "classes")
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id"))
    kept = saved(first.distinct(), "kept-ids")
    out = docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
    return out if kept.count() == first.count() else out.dropDuplicates(["doc_id", "text"])
