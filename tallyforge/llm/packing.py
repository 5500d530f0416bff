"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; rests are cut again where they are long against a window. Full
windows stand alone. The other pieces are packed in cells of a bounded number of pieces: differencing merges the partial
partitions with the largest spread, opposing sums together, and yields windows of nearly equal length; where one would
exceed the capacity, the cell gets one window more and is packed again. A cell is filled from the pieces that one task
reads, so nothing is shuffled, whatever the corpus's size or its largest source, and a task that runs again gives the
same windows.

A null or empty text still has its end id and so one piece; repeated rows are packed each by itself; a null id stays null.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.common import id_text, slices

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, sum of each bin) of the multiway largest differencing method."""
    n = len(sizes)
    # Slots hold (sum, tree); a partial partition lists only its non-empty slots, largest first. A tree is an item (< n) or a node.
    left, right = [0] * n, [0] * n
    heap = [(-int(s), i, [int(s)], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        # the largest of one meets the smallest of the other; slots beyond a list are empty
        overlap = len(a) + len(b) - n_bins
        if overlap > 0:
            for j in range(overlap):
                i, k = len(a) - 1 - j, len(b) - overlap + j
                a[i] += b[k]
                left.append(ta[i])
                right.append(tb[k])
                ta[i] = len(left) - 1
            b, tb = b[: len(b) - overlap], tb[: len(tb) - overlap]
        sums = np.array(a + b)
        trees = ta + tb
        order = np.argsort(-sums, kind="stable")
        sums = sums[order].tolist()
        trees = [trees[i] for i in order.tolist()]
        spread = sums[0] - (sums[-1] if len(sums) == n_bins else 0)
        heapq.heappush(heap, (-spread, serial, sums, trees))
        serial += 1
    bins, totals = np.zeros(n, dtype=np.int64), np.zeros(n_bins, dtype=np.int64)
    if heap:
        _, _, sums, trees = heap[0]
        for k, tree in enumerate(trees):
            totals[k] = sums[k]
            stack = [tree]
            while stack:
                t = stack.pop()
                if t < n:
                    bins[t] = k
                else:
                    stack += (left[t], right[t])
    return bins, totals


def pack_cell(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; the number of windows rises until none exceeds the capacity."""
    n_bins = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        bins, totals = differencing(sizes, n_bins)
        if totals.max(initial=0) <= capacity:
            return bins
        n_bins += 1


def cut(n: int, capacity: int, part: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then near-equal parts of the rest."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    start = len(out) * capacity
    rest = n - start
    parts = -(-rest // part)
    for i in range(parts):
        a, b = rest * i // parts, rest * (i + 1) // parts
        out.append((start + a, b - a))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, part: int = 1024, cell: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece (COLUMNS, and its ids if asked for): which window it is in and where there.

    part: the most ids of a piece of a rest; cell: the most pieces that are packed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tallyforge.llm.tokens import encoder

        coder, base, used = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0
        waiting: list[tuple] = []
        full: list[tuple] = []

        def emit(rows: list[tuple], sequence: list[int], offset: list[int]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            columns += [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            if with_ids:
                columns.append(pa.array([r[5].tolist() for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal used
            bins = pack_cell(np.array([r[2] for r in rows]), capacity)
            order = np.lexsort((np.arange(len(rows)), bins))
            rows, bins = [rows[i] for i in order.tolist()], bins[order]
            sizes = np.array([r[2] for r in rows])
            ends = np.cumsum(sizes)
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            offset = ends - sizes - (ends - sizes)[first][np.cumsum(first) - 1]
            sequence = base + used + bins
            used += int(bins.max()) + 1
            return emit(rows, sequence.tolist(), offset.tolist())

        for batch in slices(batches, "text"):
            ids, at = coder.encode(batch.column("text"))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                mine = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for start, length in cut(len(mine), capacity, part):
                    piece = mine[start : start + length]
                    row = (doc, start, length, zlib.crc32(piece.tobytes()), len(mine), *([piece] if with_ids else []))
                    (full if length == capacity else waiting).append(row)
                if len(full) >= cell:
                    yield emit(full, list(range(base + used, base + used + len(full))), [0] * len(full))
                    used, full = used + len(full), []
                while len(waiting) >= cell:
                    yield close(waiting[:cell])
                    waiting = waiting[cell:]
        if full:
            yield emit(full, list(range(base + used, base + used + len(full))), [0] * len(full))
            used += len(full)
        if waiting:
            yield close(waiting)

    return id_text(docs).mapInArrow(run, COLUMNS + (", ids array<int>" if with_ids else ""))
