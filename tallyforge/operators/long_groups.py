"""Packers whose groups may be larger than a row, a task or a machine.

Items are dealt to partitions by range of group and order, so a group lies in as many partitions as it needs, and are cut
into blocks of rows in order there. What a block does to a pack that is open when it begins is a small function, found in
all blocks at once; a pass over these functions alone, a few numbers for thousands of items, tells each block how it
begins, and every block then places its own items. Order is by `order`; equal items stand as dealt, which for items alike
in all columns makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.scratch import saved

BLOCK = 1 << 14  # items


def blocks(df: DataFrame, group: str, order: Column, size: str, most: int = BLOCK) -> DataFrame:
    """(group, part, block, at, sizes): items in order, packed to blocks of at most so many of one group. at holds the orders."""
    rows = df.select(F.col(group).alias("g"), order.alias("at"), F.col(size).cast("long").alias("n"), F.monotonically_increasing_id().alias("place"))
    rows = saved(rows, "items")
    by = [F.col("g").asc_nulls_first(), F.col("at"), F.col("place")]
    schema = T.StructType([T.StructField("g", rows.schema["g"].dataType), T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("at", T.ArrayType(rows.schema["at"].dataType)), T.StructField("sizes", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, now, started, size = TaskContext.get().partitionId(), 0, [], None, False, 0

        def close() -> pa.RecordBatch:
            nonlocal number
            at = pa.concat_arrays([h.column("at") for h in held])
            n = pa.concat_arrays([h.column("n") for h in held])
            one = pa.array([0, len(at)], pa.int32())
            columns = [pa.array([now], arrow.field("g").type), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.ListArray.from_arrays(one, at), pa.ListArray.from_arrays(one, n)]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys = batch.column("g").to_pylist()
            a = 0
            while a < len(keys):
                if started and (keys[a] != now or size >= most):
                    yield close()
                    size = 0
                started, now = True, keys[a]
                b = a
                while b < len(keys) and keys[b] == now and size + b - a < most:
                    b += 1
                held.append(batch.slice(a, b - a))
                size += b - a
                a = b
        if held:
            yield close()

    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select("g", "at", "n").mapInArrow(pack, schema)


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("g").sortWithinPartitions(F.col("g").asc_nulls_first(), "part", "block")


def successors(sizes: np.ndarray, width: int, budget: int) -> np.ndarray:
    """Where the batch that an item begins ends: width items on, or before the first that would overflow it, one item at least. Ends beyond the last item count as there."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    fits = np.searchsorted(total, total[:-1] + budget, side="right") - 1 if (sizes >= 0).all() else np.array([_reach(sizes, i, width, budget) for i in range(len(sizes))], dtype=np.int64)
    i = np.arange(len(sizes))
    return np.minimum(np.maximum(fits, i + 1), i + max(1, width))


def _reach(sizes: np.ndarray, i: int, width: int, budget: int) -> int:
    """The end of the batch that item i begins, where sizes may be negative."""
    used, j = 0, i
    while j < len(sizes) and (j == i or (used + sizes[j] <= budget and j - i < max(1, width))):
        used += sizes[j]
        j += 1
    return j


def next_fit(df: DataFrame, group: str, order: Column, size: str, width: int, budget: int, most: int = BLOCK) -> DataFrame:
    """(group, at, n, batch) as sequences.next_fit, of groups of any size.

    A batch that is open at a block's end is known by its items, fewer than width. Where a batch begins, only what follows
    counts: each item points to its batch's successor, and following the pointers from an entry gives all batches of a
    block. A block tells, for each of the first width items that may begin a batch, where its last batch begins, and how
    many there are; the pass carries the items of the open batch, at most width, from block to block.
    """
    width = max(1, width)
    packed = saved(blocks(df, group, order, size, most), "blocks")
    g = packed.schema["g"]
    kind = T.StructType([g, *T.StructType.fromDDL("part int, block long, n long, head array<long>, tail array<long>, starts array<long>, counts array<long>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                n, last = len(sizes), np.arange(len(sizes))
                count, jump = np.ones(n, dtype=np.int64), successors(sizes, width, budget)
                # doubling: after k rounds an item has followed 2 ** k pointers; one that leaves the block is not followed
                step = np.append(np.where(jump < n, jump, n), n)
                last, count, hops = np.append(last, n), np.append(count, 0), step
                while (hops[:n] < n).any():
                    inside = hops < n
                    last = np.where(inside, last[np.minimum(hops, n)], last)
                    count = np.where(inside, count + count[np.minimum(hops, n)], count)
                    hops = hops[hops]
                entry = min(width, n)
                out.append({"g": row["g"], "part": row["part"], "block": row["block"], "n": n, "head": sizes[:entry].tolist(), "tail": sizes[-entry:].tolist(), "starts": last[:entry].tolist(), "counts": count[:entry].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    told = "part int, block long, entry long, before long, open boolean"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, held, batch_no = None, False, [], 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not started or row["g"] != now:
                    started, now, held, batch_no = True, row["g"], [], 0
                # what still goes into the open batch
                used, k = sum(held), 0
                while held and k < len(row["head"]) and len(held) + k < width and used + row["head"][k] <= budget:
                    used += row["head"][k]
                    k += 1
                was_open = bool(held)
                out.append((row["part"], row["block"], k, batch_no - was_open, was_open))
                if k >= row["n"]:
                    held = held + row["head"][:k]
                    batch_no += not was_open
                    continue
                if k < len(row["starts"]):
                    start, more = row["starts"][k], row["counts"][k]
                else:  # the open batch took width items, so the block begins anew behind them
                    raise AssertionError("an open batch has fewer than width items")
                batch_no += more
                held = row["tail"][-(row["n"] - start) :]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out, strict=True)), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["part", "block", "entry", "before", "open"])

    entries = _in_order(packed.select("g", "part", "block", "sizes").mapInArrow(pointers, kind)).mapInArrow(walk, told)
    placed = T.StructType([packed.schema["g"], T.StructField("at", packed.schema["at"].dataType.elementType), T.StructField("n", T.LongType()), T.StructField("batch", T.LongType())])
    out_arrow = to_arrow_schema(placed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column("sizes")[i].values.to_numpy()
                entry, number = batch.column("entry")[i].as_py(), batch.column("before")[i].as_py()
                of = np.full(len(sizes), number, dtype=np.int64)
                jump, at = successors(sizes[entry:], width, budget), 0
                number += 1 if batch.column("open")[i].as_py() else 0
                while at < len(sizes) - entry:
                    of[entry + at : entry + int(jump[at])] = number
                    at, number = int(jump[at]), number + 1
                g_value = pa.array([batch.column("g")[i].as_py()] * len(sizes), out_arrow.field(0).type)
                columns = [g_value, batch.column("at")[i].values, batch.column("sizes")[i].values, pa.array(of)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_arrow, strict=True)], schema=out_arrow)

    met = packed.join(entries, ["part", "block"]).select("g", "at", "sizes", "entry", "before", "open")
    return met.mapInArrow(place, placed).withColumnRenamed("g", group)


def greedy_budget(df: DataFrame, group: str, order: Column, size: str, budget: int, most: int = BLOCK) -> DataFrame:
    """(group, at, n, taken) as sequences.greedy_budget, of groups of any size: an item is taken if it fits what is left.

    What is left only shrinks, so a block whose smallest item does not fit is passed over at once; blocks are gone
    through in order, one group by one task, which holds a block at a time.
    """
    packed = blocks(df, group, order, size, most)
    placed = T.StructType([packed.schema["g"], T.StructField("at", packed.schema["at"].dataType.elementType), T.StructField("n", T.LongType()), T.StructField("taken", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, left = None, False, budget
        for batch in batches:
            for i in range(batch.num_rows):
                g = batch.column("g")[i].as_py()
                if not started or g != now:
                    started, now, left = True, g, budget
                sizes = batch.column("sizes")[i].values.to_numpy()
                taken, at = np.zeros(len(sizes), dtype=bool), 0
                while at < len(sizes):
                    # the next run: all that fits what is left, up to where it is used up
                    fit = at + np.flatnonzero(sizes[at:] <= left)
                    if not len(fit):
                        break
                    total = np.cumsum(sizes[fit])
                    k = int(np.argmax(total > left)) if (total > left).any() else len(fit)
                    taken[fit[:k]] = True
                    left -= int(total[k - 1])
                    at = int(fit[k]) if k < len(fit) else len(sizes)
                columns = [pa.array([g] * len(sizes), arrow.field(0).type), batch.column("at")[i].values, batch.column("sizes")[i].values, pa.array(taken)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _in_order(packed).mapInArrow(run, placed).withColumnRenamed("g", group)
