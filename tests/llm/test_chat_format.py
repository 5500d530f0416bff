import hashlib
import random
import time

from pyspark.sql import functions as F

from tallyforge.llm import chat_format
from tallyforge.llm.queries import CLASH, op6_chat_format

TURNS = "conv_id long, turn int, role string, text string"


def brute(rows):
    """{conversation: (n_turns, turns_sha256, loss_chars, loss_sha256)} without any template."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read_back(spark, rows):
    df = spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit("clash")).withColumn("formatted", F.lit(1)).repartition(3)
    return {r[0]: tuple(r)[1:5] for r in chat_format.digests(chat_format.read_chats(chat_format.format_chats(df))).collect()}


def test_texts_full_of_control_strings_are_read_back(spark):
    rng = random.Random(8)
    parts = ["###", "#", "### ", "\\", "\\h", "\\s", "\\e", "\\p", "\\n", "</turn>", "</turn>\n", "</turn", "<part>", "<par", "t>", "\n", "assistant", " ok", "é", "𝄞", "", CLASH]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem", "### x", "</turn>", "a\\nb", ""]), "".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for c in range(150) for t in range(rng.randrange(1, 9))]
    assert read_back(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, None, "assistant", "first"), (3, 1, None, "no role"), (None, 0, "user", "x"), (None, 1, "assistant", "y" * 200_000), (4, 0, "assistant", "")]
    assert read_back(spark, rows) == brute(rows)
    assert read_back(spark, []) == {}


def test_adjacent_turns_merge_and_spans_leave_the_template_out(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c</turn>"), (1, 3, "assistant", "d")]
    got = chat_format.format_chats(spark.createDataFrame(rows, TURNS)).first()
    assert got.formatted == "### user\na<part>b</turn>\n### assistant\nc\\e<part>d</turn>\n"
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss_spans] == ["c\\e", "d"]


def test_no_python_worker_in_the_plan(spark):
    plan = op6_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_work_follows_the_turns(spark):
    """Sixteen times the turns take no more than ten times as long, however they are merged."""
    for role in (F.lit("assistant"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")):
        seconds = []
        for n in (2_000, 2_000, 32_000):
            turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.repeat(F.lit("wörd. "), 20).alias("text"))
            began = time.perf_counter()
            got = chat_format.digests(chat_format.read_chats(chat_format.format_chats(turns))).first()
            seconds.append(time.perf_counter() - began)
            assert got.n_turns == n
        assert seconds[2] < 10 * max(seconds[1], 1)


def test_spans_over_chunks(spark):
    text = "".join(chr(0x1D4B6 + i % 26) if i % 3 else "é" for i in range(100))
    spans = [(a, n) for a in (0, 1, 7, 8, 9, 15, 16, 50, 92, 100) for n in (0, 1, 7, 8, 9, 17, 40) if a + n <= 100]
    df = spark.createDataFrame([(text, [{"start": a, "length": n} for a, n in spans])], "text string, spans array<struct<start:int,length:int>>")
    assert df.select(chat_format.spanned("text", "spans", 8)).first()[0] == [text[a : a + n] for a, n in spans]
