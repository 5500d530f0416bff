"""Chat formatting with Spark expressions only: turns are collected, sorted, merged and concatenated in the JVM.

Template: each run of adjacent turns of one role is a block ``### role`` newline, the escaped texts with ``<part>``
between them, ``</turn>`` newline. Texts and roles are escaped so that a control string can only come from the
template: a backslash becomes ``\\s``, ``###`` ``\\h``, ``</turn>`` ``\\e``, ``<part>`` ``\\p`` and, in roles, a
newline ``\\n``. Since every backslash in escaped text is followed by its code letter, undoing the codes in reverse
order gives the text back.

A null text or role counts as empty; a null conversation id is a conversation of its own; repeated rows are turns of
their own; turns with equal numbers are ordered by role, then text (null turn numbers first). One conversation becomes
one output string, so a conversation has to fit a row, as in any formatter; different conversations never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control string and its code letter, in the order of escaping.
CODES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), ("<part>", "\\p"))
HEADER, PART, END = "### ", "<part>", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    """text without control strings."""
    for plain, code in CODES + ((("\n", "\\n"),) if role else ()):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    """Undoes escaped()."""
    for plain, code in reversed(CODES + ((("\n", "\\n"),) if role else ())):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points of each part to train on)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a block starts where the role changes; its turns are merged to one array of parts
    starts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 or turns[i].role != turns[i - 1].role)")
    merged = collected.withColumn("starts", starts).withColumn(
        "blocks",
        F.expr("transform(starts, (s, k) -> named_struct('role', turns[s].role, 'parts', transform(sequence(s, coalesce(get(starts, k + 1), size(turns)) - 1), i -> turns[i].text)))"),
    )
    # what is written, piece by piece; only pieces know their lengths, so offsets are one running sum
    piece = lambda text, trained=F.lit(False): F.struct(text.alias("text"), trained.alias("trained"))
    written = F.transform(
        "blocks",
        lambda b: F.concat(
            F.array(piece(F.concat(F.lit(HEADER), escaped(b["role"], role=True), F.lit("\n")))),
            F.flatten(F.transform(b["parts"], lambda t, j: F.concat(F.when(j > 0, F.array(piece(F.lit(PART)))).otherwise(F.array().cast("array<struct<text:string,trained:boolean>>")), F.array(piece(escaped(t), b["role"] == train_on))))),
            F.array(piece(F.lit(END))),
        ),
    )
    pieces = merged.select("conv_id", F.posexplode(F.flatten(written)).alias("i", "p")).select("conv_id", "i", "p.text", "p.trained")
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    in_order = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "text"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("i", "start", F.length("text").alias("length"))))).alias("spans"),
    )
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return in_order.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def spanned(text: str, spans: str, width: int = 4096) -> Column:
    """The texts of spans (start, length in code points), read from chunks of the text, so that each costs what it is long and not where it lies."""
    chunks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))

    def cut(c: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / width).cast("int"), F.floor((s["start"] + s["length"]) / width).cast("int")
        around = F.array_join(F.transform(F.sequence(first, last), lambda k: F.coalesce(F.get(c, k), F.lit(""))), "")
        return F.substring(around, s["start"] - first * width + 1, s["length"])

    return F.get(F.transform(F.array(F.struct(chunks.alias("c"), F.col(spans).alias("s"))), lambda x: F.transform(x["s"], lambda s: cut(x["c"], s))), F.lit(0))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the trained text, read back from formatted and loss_spans."""
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    read = F.transform(
        blocks,
        lambda b: F.struct(
            unescaped(F.substring(F.substring_index(b, "\n", 1), F.lit(len(HEADER) + 1), F.length(b)), role=True).alias("role"),
            F.split(F.substring(b, F.instr(b, "\n") + F.lit(1), F.length(b)), PART).alias("parts"),
        ),
    )
    known = formatted.select("conv_id", "formatted", read.alias("blocks"), spanned("formatted", "loss_spans").alias("cut"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["parts"], lambda p: F.struct(b["role"].alias("role"), unescaped(p).alias("text")))))
    return known.select("conv_id", "formatted", turns.alias("turns"), F.array_join(F.transform("cut", lambda c: unescaped(c)), "").alias("trained"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what read_chats() gives back."""
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
