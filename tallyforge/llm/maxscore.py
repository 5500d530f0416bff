"""Exact top-k inner products of integer vectors by MaxScore.

Each dimension is a query term with postings (the components of all vectors) in every part of a shard; a part holds
vectors near one of the shard's pivots, so that its least and largest component bound a term's score well. Each query
visits the parts by their bound, the best first, until no part can lift a vector to the query's current k-th score. In a
part the query's own terms are put in the order of their bounds there and split: terms that together cannot reach the
k-th score are non-essential. The postings of essential terms are traversed for all vectors of the part; the other terms
are probed, most powerful first, only for vectors that are still competitive. Shards' best k are merged per query.

Vectors are dealt to shards of at most BLOCK by the nearest of a bounded sample of vectors, so that a shard has bounds that
say something; equal ranges of them are partitions, which bound their shards in turn. A query first meets the shard of
highest bound in the partition of highest bound. Its k-th score there is its floor from then on: a block of queries is
sent only to the partitions, and there only to the shards, whose bound reaches the floor of one of its queries, and meets
them with that floor. Hence neither every block goes to every shard nor does a shard start from nothing.

Null vectors and vectors with null or non-finite components take no part; missing trailing dimensions count as zero;
ties go to the smaller id; rows that share the query's id are not candidates; repeated other rows are candidates each; a
query id that comes several times is asked once, with the least of its vectors. Scores that may not fit 63 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import saved

BLOCK = 1 << 15  # vectors
QUERIES = 256  # queries a block
PART = 512  # vectors with bounds of their own
STEP = 8  # terms probed at a time
PIVOTS = 64  # vectors of least hash, by which vectors are dealt to shards
NONE = -(1 << 63)  # no floor
BLOCKS = "part int, block long, ids binary, dims int, vectors binary, high array<long>, low array<long>"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, of the rows that take part."""
    x = F.col("v")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    large = F.raise_error(F.lit("a component is too large for scores of 63 bits")).cast("long")
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("v", lambda e: F.when(F.abs(e * scale) < float(1 << 62), F.floor(e * scale)).otherwise(large)).alias("q"))


def _dense(column: pa.Array, dims: int = 0) -> np.ndarray:
    """A list column as a matrix, short rows filled with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(dims, int(size.max(initial=0)))), dtype=np.int64)
    at = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at, size)] = flat
    return out


def near(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (vec_id, q) with pivot, the nearest row of pivots."""
    pivots = pivots.astype(np.float64)
    size = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _dense(batch.column("q"), pivots.shape[1])[:, : pivots.shape[1]].astype(np.float64)
            found = np.argmax(m @ pivots.T - size, axis=1) if len(pivots) else np.zeros(len(m), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(found.astype(np.int32))], names=["vec_id", "q", "pivot"])

    return rows.mapInArrow(run, "vec_id long, q array<long>, pivot int")


def blocks(rows: DataFrame, size: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """rows (part, vec_id, q, any of pivot, floor and home) packed to blocks of at most size vectors of one part: their ids, vectors, least and largest components, and what is kept of the other columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        number, held, now = 0, [], None

        def close() -> pa.RecordBatch:
            nonlocal number
            dims = max(m.shape[1] for _, m, _ in held)
            m = np.concatenate([np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for _, m, _ in held])
            high, low = m.max(axis=0, initial=-(1 << 62)), m.min(axis=0, initial=1 << 62)
            small = m.astype("<i2") if np.abs(m).max(initial=0) < 1 << 15 else m.astype("<i8")
            others = [np.concatenate([o[k] for _, _, o in held]) for k in range(len(kept))]
            row = [[task if now is None else now], [(task << 32) + number], [np.concatenate([i for i, _, _ in held]).astype("<i8").tobytes()], [dims], [small.tobytes()], [high.tolist()], [low.tolist()], *([o.astype("<i8").tobytes()] for o in others)]
            number += 1
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * len(kept)]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "block", "ids", "dims", "vectors", "high", "low", *kept])

        for batch in batches:
            part = batch.column("part")
            parts = np.full(batch.num_rows, -1) if part.null_count else part.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    mine = None if parts[a] < 0 else int(parts[a])
                    if held and mine != now:
                        yield close()
                    now = mine
                    n = min(b - a, size - sum(len(i) for i, _, _ in held))
                    some = batch.slice(a, n)
                    held.append((some.column("vec_id").to_numpy(), _dense(some.column("q")), [some.column(c).to_numpy(zero_copy_only=False) for c in kept]))
                    a += n
                    if sum(len(i) for i, _, _ in held) == size:
                        yield close()
        if held:
            yield close()

    extra = "".join(f", {c} binary" for c in kept)
    return rows.select("part", "vec_id", "q", *kept).mapInArrow(pack, BLOCKS + extra)


def reach(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score within bounds (rows of high and low), query by bound."""
    q = queries.astype(np.float64)
    return np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)


def _matrix(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    kind = "<i2" if len(vectors) == 2 * dims * len(ids) else "<i8"
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), dims)


class Shard:
    """The vectors of a shard in parts, with postings and bounds of every term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int, part: int = PART):
        m = np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))
        largest = float(np.abs(m).max(initial=0))
        self.largest, self.ids, self.parts = largest, [], []
        near = self._pivots(m.astype(np.float32), -(-len(ids) // part))
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], near[order][1:] != near[order][:-1]))).tolist() + [len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, part):
                rows = order[c : min(b, c + part)]
                self.ids.append(ids[rows])
                self.parts.append(np.ascontiguousarray(m[rows].T))
        self.high = np.array([p.max(axis=1) for p in self.parts], dtype=np.int64).reshape(-1, dims)
        self.low = np.array([p.min(axis=1) for p in self.parts], dtype=np.int64).reshape(-1, dims)

    def widen(self, dims: int) -> None:
        """Adds components that are zero throughout."""
        more = dims - self.high.shape[1]
        self.parts = [np.pad(p, ((0, more), (0, 0))) for p in self.parts]
        self.high, self.low = (np.pad(x, ((0, 0), (0, more))) for x in (self.high, self.low))

    @staticmethod
    def _pivots(m: np.ndarray, n: int) -> np.ndarray:
        """The nearest of n evenly dealt vectors, by each vector."""
        pivots = m[:: max(1, len(m) // max(1, n))][:n]
        size = (pivots**2).sum(axis=1) / 2
        return np.concatenate([np.argmax(m[a : a + 4096] @ pivots.T - size, axis=1) for a in range(0, len(m), 4096)]) if len(m) else np.zeros(0, np.int64)

    def postings(self, kind: type) -> list[np.ndarray]:
        """The parts' components by term."""
        return [p.astype(kind) for p in self.parts]


@dataclass
class Work:
    """Products of a query's and a vector's component: for essential terms, for probed ones, and of all there are."""

    essential: int = 0
    probed: int = 0
    dense: int = 0


def search(query_ids: np.ndarray, queries: np.ndarray, shard: Shard, k: int, floors: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], Work]:
    """(ids, scores) of the best k vectors for each query, best first, and what it took. floors: scores that count at least, NONE for any."""
    dims = shard.high.shape[1]
    q = np.pad(queries, ((0, 0), (0, dims - queries.shape[1]))).astype(np.int64)
    most = float(np.abs(q).max(initial=0)) * shard.largest * dims
    if most >= 2.0**63:
        raise OverflowError("scores may not fit 63 bits")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # exact for integers
    postings, found, scores, work = shard.postings(kind), [], [], Work()
    floors = np.full(len(q), NONE) if floors is None else floors
    for own, terms, least in zip(query_ids.tolist(), q, floors.tolist(), strict=True):
        bound = np.where(terms >= 0, terms * shard.high, terms * shard.low)  # part x term
        power = np.argsort(-bound, axis=1, kind="stable")
        rest = np.zeros((len(bound), dims + 1), dtype=np.int64)  # what the terms from here on can add
        rest[:, :dims] = np.cumsum(np.take_along_axis(bound, power, axis=1)[:, ::-1], axis=1)[:, ::-1]
        weights, ids, best, floor = terms.astype(kind), np.zeros(0, np.int64), np.zeros(0, np.int64), None if least == NONE else least
        for p in np.argsort(-rest[:, 0], kind="stable").tolist():
            work.dense += dims * len(shard.ids[p])
            split = dims
            if floor is not None:
                if rest[p, 0] < floor:
                    continue
                split = int(np.count_nonzero(rest[p, :dims] >= floor))
            essential = power[p, :split]
            value = weights[essential] @ postings[p][essential]
            work.essential += split * len(value)
            alive = shard.ids[p] != own
            if floor is not None:
                alive &= value >= floor - rest[p, split]
            at = np.flatnonzero(alive)
            value = value[at]
            for a in range(split, dims, STEP):
                if not len(at):
                    break
                probed = power[p, a : a + STEP]
                value = value + weights[probed] @ postings[p][np.ix_(probed, at)]
                work.probed += len(probed) * len(at)
                keep = value >= floor - rest[p, min(dims, a + STEP)]
                at, value = at[keep], value[keep]
            if not len(at):
                continue
            ids, best = np.concatenate((ids, shard.ids[p][at])), np.concatenate((best, value.astype(np.int64)))
            order = np.lexsort((ids, -best))[:k]
            ids, best = ids[order], best[order]
            if len(best) == k:
                floor = int(best[-1]) if floor is None else max(floor, int(best[-1]))
        found.append(ids)
        scores.append(best)
    return found, scores, work


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, m = _matrix(row["ids"], row["vectors"], row["dims"])
    return ids, m, np.frombuffer(row["floor"], "<i8"), np.frombuffer(row["home"], "<i8")


SENT = "shard long, kind int, ids binary, dims int, vectors binary, floor binary, home binary"


def _send(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SENT.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=names)


def _padded(rows: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def routed(asked: DataFrame, shards: DataFrame, best_only: bool) -> DataFrame:
    """SENT: blocks of queries (part, ids, dims, vectors, floor, home) to the shards of their part whose bound reaches a floor of theirs, or to the best one alone."""
    bounds = shards.select("part", F.lit(0).alias("kind"), "block", "high", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, high, low = None, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    now, names, high, low = row["part"], [], [], []
                if row["kind"] == 0:
                    names.append(row["block"])
                    high.append(row["high"])
                    low.append(row["low"])
                    continue
                ids, m, floor, home = _queries(row)
                dims = max(m.shape[1], *map(len, high)) if high else m.shape[1]
                top = reach(np.pad(m, ((0, 0), (0, dims - m.shape[1]))), _padded(high, dims), _padded(low, dims)) if names else np.zeros((len(m), 0))
                if best_only:
                    wanted = [int(np.argmax(top.sum(axis=0)))] if names else []
                    home = np.full(len(ids), names[wanted[0]] if names else -1)
                else:  # floats may be off by a little for large sums
                    ok = (top * (1 + 1e-9 * np.sign(top)) + 1 >= floor[:, None]) & (home[:, None] != np.array(names)[None, :])
                    wanted = np.flatnonzero(ok.any(axis=0)).tolist()
                for s in wanted:
                    yield _send([(names[s], 1, row["ids"], row["dims"], row["vectors"], row["floor"], home.astype("<i8").tobytes())])

    both = bounds.unionByName(asked.select("part", F.lit(1).alias("kind"), "ids", "dims", "vectors", "floor", "home"), allowMissingColumns=True)
    return both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, SENT)


def met(shards: DataFrame, sent: DataFrame, k: int, home: bool) -> DataFrame:
    """(query_id, vec_id, score, shard): each query's best k in each shard that it is sent to; home: where a query is at home it is asked, else only there not."""
    held_rows = shards.select(F.col("block").alias("shard"), F.lit(0).alias("kind"), "ids", "dims", "vectors")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["kind"] == 0:
                    held, now = row, row["shard"]
                    continue
                ids, m, floor, at_home = _queries(row)
                if isinstance(held, dict):
                    own, vectors = _matrix(held["ids"], held["vectors"], held["dims"])
                    held = Shard(own, vectors, max(held["dims"], m.shape[1]))
                elif held.high.shape[1] < m.shape[1]:
                    held.widen(m.shape[1])
                mine = (at_home == now) == home
                found, scores, _ = search(ids[mine], m[mine], held, k, floor[mine])
                size = [len(x) for x in found]
                if sum(size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[mine], size)), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores)), pa.array(np.full(sum(size), now))], names=["query_id", "vec_id", "score", "shard"])

    rows = held_rows.unionByName(sent, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "kind")
    return rows.mapInArrow(score, "query_id long, vec_id long, score long, shard long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, size: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors. queries has the columns of vectors; block: vectors of a shard, size: queries of a block, at most."""
    rows = quantized(vectors, id_col, vector_col)
    sample = [r.q for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(PIVOTS).select("q").collect()]
    pivots = _padded(sample, max(map(len, sample), default=0))
    placed = near(rows, pivots).withColumn("split", F.spark_partition_id())
    in_order = placed.repartitionByRange("pivot", "vec_id", "split").sortWithinPartitions("pivot", "vec_id")
    shards = saved(blocks(in_order.withColumn("part", F.lit(None).cast("int")), block, ("pivot",)), "shards")
    # what bounds a partition: a row for each of them and component, however many vectors there are
    n_shards = {r.part: r["count"] for r in shards.groupBy("part").count().collect()}
    sides = shards.select("part", F.posexplode(F.arrays_zip("high", "low")).alias("i", "x")).groupBy("part", "i").agg(F.max("x.high").alias("high"), F.min("x.low").alias("low"), F.count(F.lit(1)).alias("n")).collect()
    parts, dims = sorted(n_shards), max((r.i + 1 for r in sides), default=0)
    high, low = np.zeros((2, len(parts), dims), dtype=np.int64)
    for r in sides:
        zero = [0] * (r.n < n_shards[r.part])  # of shards without the component
        high[parts.index(r.part), r.i], low[parts.index(r.part), r.i] = max(r.high, *zero, r.high), min(r.low, *zero, r.low)

    asked = quantized(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("q").alias("q"))
    homes = np.array(parts, dtype=np.int64)

    def first_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _dense(batch.column("q"), dims)[:, :dims]
            best = homes[np.argmax(reach(m, high, low), axis=1)] if len(homes) else np.zeros(len(m), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), batch.column("vec_id"), batch.column("q"), pa.array(np.full(len(m), NONE)), pa.array(np.full(len(m), -1))], names=["part", "vec_id", "q", "floor", "home"])

    kept = ("floor", "home")
    own = saved(asked.mapInArrow(first_part, "part int, vec_id long, q array<long>, floor long, home long"), "queries")
    first = saved(met(shards, routed(blocks(own.repartition("part").sortWithinPartitions("part"), size, kept), shards, True), k, True), "first-meetings")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(NONE)).alias("floor"), F.min("shard").alias("home"))
    again = own.drop("floor", "home").join(floors, F.col("vec_id") == F.col("query_id"), "left")
    again = again.select("part", "vec_id", "q", F.coalesce("floor", F.lit(NONE)).alias("floor"), F.coalesce("home", F.lit(-1).cast("long")).alias("home"))
    packed = blocks(again.repartitionByRange("part", "home", "vec_id").sortWithinPartitions("part", "home", "vec_id"), size, kept)

    def every_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, m, floor, _ = _queries(row)
                top = reach(np.pad(m, ((0, 0), (0, max(0, dims - m.shape[1]))))[:, :dims], high, low)
                for p in np.flatnonzero((top * (1 + 1e-9 * np.sign(top)) + 1 >= floor[:, None]).any(axis=0)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([parts[p]], pa.int32()), pa.array([row["ids"]]), pa.array([row["dims"]], pa.int32()), pa.array([row["vectors"]]), pa.array([row["floor"]]), pa.array([row["home"]])], names=["part", "ids", "dims", "vectors", *kept])

    wide = packed.mapInArrow(every_part, "part int, ids binary, dims int, vectors binary, floor binary, home binary")
    later = met(shards, routed(wide, shards, False), k, False)
    found = first.unionByName(later).withColumn("rank", F.row_number().over(place))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
