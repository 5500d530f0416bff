"""Conversation structure repair: the cheapest edits that turn rows of one conversation into ``(system? (user assistant)+)?``.

The rows of a conversation, one after another, and the four states of that pattern span a graph: an arc keeps, reroles
or deletes a row, or inserts an empty turn. Backward minimum costs give what is left to pay from every node, forward ones
which nodes an optimal path enters; an arc is tight where the two ends' costs differ by its own. The audit follows the set
of all nodes that tight arcs reach with the letters written so far and takes the least letter (D, I, K, R) at each step.

Costs need no text, just a byte a row, and compose: a block of rows is a matrix of costs between states (least sum as
product). Conversations that lie whole in one block, all but a few, are settled where they lie. Of a conversation that
spans blocks or partitions, every block gives its matrix, a short scan over the matrices gives each block the costs at its
ends, the block finds its letters for each set of states that may enter it, and a last pass in order picks the sets that
do. So no task holds the rows of a large conversation; its digest alone, one chain by nature, is taken by one task that
reads the rows in order and keeps one byte a row, the audit.

Rows count by turn (nulls first), then role, the SHA-256 of the text, and their place in the input; null roles and texts
are one space, and neither that nor an empty role can be kept; a null conversation id is a conversation of its own; repeated rows are rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import saved, small_batches

#: What edits and an undeleted truncated row cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # classes of roles by initial
FINE, CUT, BLANK, DUPLICATE = range(4)  # faults of rows
#: States: nothing yet, after the system turn, after a user's, after an assistant's; the first and the last may end.
START, END = (0, None, None, None), (0, None, None, 0)
INTO = {USER: ((0, 2), (1, 2), (3, 2)), ASSISTANT: ((2, 3),), SYSTEM: ((0, 1),), OTHER: ()}
INSERTS = INTO[USER] + INTO[ASSISTANT]
FAR = 1 << 60
ROWS, BYTES = 1024, 1 << 20  # of a block at most, one row at least

Costs = tuple[int, ...]


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults planted by crc32 of ``conv_id:turn`` (nulls: one space), and `gone` for dropped rows."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def coded(rows: DataFrame) -> DataFrame:
    """rows with code (class of the role * 4 + first fault) and what orders them. Duplicates are found by a least place of role and text, which combines before the shuffle."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    plain = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    placed = saved(rows.select("*", kind.alias("kind"), plain.alias("plain"), F.sha2(text, 256).alias("digest"), key.alias("key"), F.monotonically_increasing_id().alias("place")), "turns")
    at = F.struct("turn", "place")  # of equal role and text: the order of the rows
    firsts = placed.where("not gone").groupBy("key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.coalesce((F.col("first.place") != F.col("place")), F.lit(False))
    fault = F.when(F.col("plain") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("plain"))
    return placed.join(firsts, "key", "left").select("conv_id", "turn", "role", "text", "gone", "digest", "place", (F.col("kind") * 4 + fault).alias("code"))


def order(df: DataFrame) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("place")]


def closed(f: list[int]) -> list[int]:
    """Least costs to reach a state after any insertions."""
    f[2] = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    f[3] = min(f[3], f[2] + INSERT)
    return f


def closed_back(b: list[int]) -> list[int]:
    """Least costs that are left from a state, insertions first."""
    b[2] = min(b[2], b[3] + INSERT)
    for s in (0, 1, 3):
        b[s] = min(b[s], b[2] + INSERT)
    return b


@functools.cache
def arcs(code: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, cost, from, to) of a row's edits, by letter."""
    kind, fault = divmod(code, 4)
    out = [("D", DELETE, s, s) for s in range(4)]
    if fault < BLANK:
        extra = TRUNCATED if fault == CUT else 0
        out += [("K", extra, s, t) for s, t in INTO[kind]]
        out += [("R", extra + REROLE, s, t) for to in (USER, ASSISTANT) if to != kind for s, t in INTO[to]]
    return tuple(out)


def forward(codes: bytes, entry: Iterable[int | None]) -> list[int]:
    """Costs after the rows, from the costs before them."""
    f = [FAR if x is None else x for x in entry]
    for code in codes:
        f, out = closed(f), [FAR] * 4
        for _, cost, s, t in arcs(code):
            out[t] = min(out[t], f[s] + cost)
        f = out
    return f


def backward(codes: bytes, after: Iterable[int | None]) -> list[list[int]]:
    """Costs that are left at each row and behind the last one; after: what is left there."""
    b = closed_back([FAR if x is None else x for x in after])
    layers = [b]
    for code in reversed(codes):
        out = [FAR] * 4
        for _, cost, s, t in arcs(code):
            out[s] = min(out[s], cost + b[t])
        b = closed_back(out)
        layers.append(b)
    return layers[::-1]


def letters(codes: bytes, left: list[list[int]], entry: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """The least letters of tight arcs from the states of entry, and the states behind them."""
    now, out, i, n = entry, [], 0, len(codes)
    while True:
        b = left[i]
        if i == n and (not last or any(b[s] == 0 for s in now)):
            return "".join(out), now
        tight = [] if i == n else [(letter, t) for letter, cost, s, t in arcs(codes[i]) if s in now and b[s] == cost + left[i + 1][t]]
        inserts = [("I", t) for s, t in INSERTS if s in now and b[s] == INSERT + b[t]]
        least = min(tight + inserts)[0]
        now = frozenset(t for letter, t in tight + inserts if letter == least)
        out.append(least)
        i += least != "I"


@functools.lru_cache(maxsize=1 << 16)
def solve(codes: bytes) -> tuple[str, int]:
    """(audit, cost) of a whole conversation."""
    left = backward(codes, END)
    return letters(codes, left, frozenset([0]), True)[0], left[0][0]


class Report:
    """What is said of one conversation, from its blocks in order."""

    def __init__(self) -> None:
        self.audit, self.sha, self.written, self.system, self.cost = [], hashlib.sha256(), 0, 0, 0
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.least = self.most = self.turn = None
        self.turns = 0

    def add(self, codes: bytes, audit: str, roles: list[str], texts: list[str], turns: list[int | None]) -> None:
        self.audit.append(audit)
        row = 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else (roles[row], texts[row])
            if letter == "K" and codes[row] // 4 == SYSTEM:
                self.system = 1
            if letter != "I":
                row += 1
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if (self.written - self.system) % 2 else "user"
            self.sha.update((f"\n{role}:{text}" if self.written else f"{role}:{text}").encode())
            self.written += 1
        for code, turn in zip(codes, turns, strict=True):
            kind = code // 4
            self.faults[code % 4] += 1
            if self.before is not None and (self.before, kind) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                self.illegal += 1
            self.before = kind
            if turn is not None:
                self.turns += turn != self.turn
                self.turn = self.most = turn
                self.least = turn if self.least is None else self.least

    def row(self, conv: object) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def result_type(conv: T.DataType) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in COLUMNS]
    return T.StructType([T.StructField("conv_id", conv), *longs, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, map(list, columns), strict=True)], names=names)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most or len(row[-1] or "") > BYTES // 16:
            yield _batch(held, schema.names, schema)
            held = []
    if held:
        yield _batch(held, schema.names, schema)


def blocks(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Sorted rows packed to blocks (conv_id, part, block, whole, codes, turns, roles, texts), in the order of the rows. whole: no other block can hold rows of the conversation."""
    conv = rows.schema["conv_id"].dataType
    kind = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("part int, block long, whole boolean, codes binary, turns array<long>, roles array<string>, texts array<string>").fields])
    arrow = _arrow(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            number, first, conv_id, codes, turns, roles, texts, size, cut = 0, True, None, bytearray(), [], [], [], 0, False
            started = False
            close = lambda whole: (conv_id, part, number, whole, bytes(codes), list(turns), list(roles), list(texts))
            for row in _rows(batches):
                new = not started or row["conv_id"] != conv_id
                if started and (new or len(codes) >= most or size + len(row["text"]) > BYTES and codes):
                    yield close(new and not first and not cut)
                    number, first, cut = number + 1, first and not new, not new
                    codes, turns, roles, texts, size = bytearray(), [], [], [], 0
                started, conv_id = True, row["conv_id"]
                if not row["gone"]:
                    codes.append(row["code"])
                    turns.append(row["turn"])
                    roles.append(row["role"])
                    texts.append(row["text"])
                    size += len(row["text"])
            if started:
                yield close(False)

        held, size = [], 0
        for row in found():
            held.append(row)
            size += 64 + sum(map(len, row[-1]))
            if size > BYTES:
                yield _batch(held, arrow.names, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow.names, arrow)

    ordered = rows.repartitionByRange(*order(rows)).sortWithinPartitions(*order(rows))
    return ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", F.col("code").cast("int").alias("code")).mapInArrow(pack, kind)


def settled(whole: DataFrame) -> DataFrame:
    """The results of conversations that lie whole in a block."""
    kind = result_type(whole.schema["conv_id"].dataType)
    arrow = _arrow(kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for row in _rows(batches):
                report = Report()
                audit, report.cost = solve(row["codes"])
                report.add(row["codes"], audit, row["roles"], row["texts"], row["turns"])
                yield report.row(row["conv_id"])

        yield from _emit(found(), arrow)

    return whole.mapInArrow(each, kind)


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(first of its conversation, row)."""
    before, first = None, True
    for row in _rows(batches):
        yield first or row["conv_id"] != before, row
        before, first = row["conv_id"], False


def entered(cut: DataFrame) -> DataFrame:
    """(part, block, before, after, last): the costs to reach each state before a block and those left behind it."""
    conv = cut.schema["conv_id"].dataType
    own = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("part int, block long, costs array<long>").fields])
    own_arrow = _arrow(own)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = [[0 if s == t else None for t in range(4)] for s in range(4)]
        rows = ((r["conv_id"], r["part"], r["block"], [x for unit in units for x in forward(r["codes"], unit)]) for r in _rows(batches))
        yield from _emit(rows, own_arrow)

    kind = "part int, block long, before array<long>, after array<long>, last boolean"
    arrow = _arrow(T.StructType.fromDDL(kind))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[tuple]) -> Iterator[tuple]:
            """held: (part, block, matrix) of one conversation, 128 bytes for up to ROWS of its rows."""
            f, before = list(closed([FAR if x is None else x for x in START])), []
            for _, _, m in held:
                before.append(f)
                f = closed([min(min(f[s] + m[4 * s + t] for s in range(4)), FAR) for t in range(4)])
            b, after = closed_back([FAR if x is None else x for x in END]), []
            for _, _, m in reversed(held):
                after.append(b)
                b = closed_back([min(min(m[4 * s + t] + b[t] for t in range(4)), FAR) for s in range(4)])
            for k, (part, block, _) in enumerate(held):
                yield part, block, before[k], after[len(held) - 1 - k], k == len(held) - 1

        def found() -> Iterator[tuple]:
            held: list[tuple] = []
            for first, row in _conversations(batches):
                if first:
                    yield from close(held)
                    held = []
                held.append((row["part"], row["block"], row["costs"]))
            yield from close(held)

        held = []
        for row in found():
            held.append(row)
            if len(held) == 4096:
                yield _batch(held, arrow.names, arrow)
                held = []
        yield _batch(held, arrow.names, arrow)

    return _in_order(cut.select("conv_id", "part", "block", "codes").mapInArrow(matrices, own)).mapInArrow(scan, kind)


def joined(cut: DataFrame) -> DataFrame:
    """The results of conversations that span blocks or may do so."""
    ends = saved(entered(cut), "chat-costs")
    conv = cut.schema["conv_id"].dataType
    kind = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("part int, block long, cost long, sets array<int>, left array<int>, audits array<string>, codes binary, turns array<long>, roles array<string>, texts array<string>").fields])
    arrow, result = _arrow(kind), result_type(conv)
    result_arrow = _arrow(result)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            left = backward(r["codes"], r["after"])
            total = min(f + b for f, b in zip(r["before"], left[0], strict=True))
            on_path = [s for s in range(4) if r["before"][s] + left[0][s] == total]
            sets = [x for x in range(1, 16) if all(s in on_path for s in range(4) if x >> s & 1)]
            ends = [letters(r["codes"], left, frozenset(s for s in range(4) if x >> s & 1), r["last"]) for x in sets]
            row = (r["conv_id"], r["part"], r["block"], total, sets, [sum(1 << s for s in out) for _, out in ends], [audit for audit, _ in ends], r["codes"], r["turns"], r["roles"], r["texts"])
            yield _batch([row], arrow.names, arrow)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            report, conv_id, now = None, None, 1
            for first, r in _conversations(batches):
                if first:
                    if report:
                        yield report.row(conv_id)
                    report, conv_id, now = Report(), r["conv_id"], 1
                    report.cost = r["cost"]
                k = r["sets"].index(now)
                report.add(r["codes"], r["audits"][k], r["roles"], r["texts"], r["turns"])
                now = r["left"][k]
            if report:
                yield report.row(conv_id)

        yield from _emit(found(), result_arrow)

    return _in_order(cut.join(ends, ["part", "block"]).mapInArrow(written, kind)).mapInArrow(last, result)


def repair(turns: DataFrame, gone: str | None = None, most: int = ROWS) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): counts of faults, cost, audit and the digest of the repaired turns.

    gone names a boolean column of rows that do not count, so that conversations without a row still get a result:
    zeros, no audit, the digest of nothing. most: rows of a block.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    left_out = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    rows = small_batches(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), left_out.alias("gone"))
    packed = saved(blocks(coded(rows), most), "chat-blocks")
    return settled(packed.where("whole")).unionByName(joined(packed.where("not whole")))
