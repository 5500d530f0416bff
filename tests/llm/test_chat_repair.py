"""Conversation repair against a search through all edit sequences."""

import hashlib
import random
import re
import zlib

import pytest

from tallyforge.llm import chat_repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def cheapest(rows):
    """(cost, audit, turns) of the least of all edit sequences; rows: (role, text, fault)."""
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and (cost > best[0]) or len(out) > len(rows) + 4:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out))
        ahead = "".join(r[:1] or "-" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", ahead):
            return
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                go(i + 1, cost + extra, audit + "K", [*out, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, cost + extra + 1, audit + "R", [*out, (to, text)])
        if audit[-3:] != "III":
            for to in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (to, "")])

    go(0, 0, "", [])
    return best


def by_hand(rows):
    """The result for the rows (turn, role, text) of one conversation, none of which ties with another text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, out = cheapest([(role, text, f) for (_, role, text), f in zip(rows, faults, strict=True)])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def told(df):
    found = {r[0]: tuple(r[1:]) for r in df.collect()}
    return found


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_random_conversations_match_search(spark, most):
    rng = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "user", "assistant", ""]), rng.choice(["Yes.", "No!", "cut", " \t", "", "ünd?", "x. "])))
    got = told(chat_repair.repair(spark.createDataFrame(rows, SCHEMA), most=most))
    want = {conv: by_hand([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert got == want


def test_one_long_conversation_over_many_blocks(spark):
    """A conversation that holds nearly all rows is cut into blocks; the result is that of one block."""
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.choice(['a.', 'b', '', 'c!'])}{i // 2 if i % 5 else ''}") for i in range(700)] + [(8, 0, "user", "Hm?")]
    turns = spark.createDataFrame(rows, SCHEMA)
    whole, cut = told(chat_repair.repair(turns, most=10_000)), told(chat_repair.repair(turns, most=16))
    assert whole == cut and len(whole[7][6]) >= 700
    assert chat_repair.solve(bytes([chat_repair.USER * 4, chat_repair.ASSISTANT * 4] * 400))[1] == 0


def test_damage_follows_the_key(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in [0, 1, 2, None] for t in [*range(30), None]]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as kind", "1 as gone", "'y' as code")
    kinds = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    want = []
    for c, t, role, text in rows:
        k = kinds[c, t]
        row = (c, t, "user" if k == 4 else role, "" if k in (0, 1) else "One Two" if k == 2 else text, k == 0)
        want += [row] * (2 if k == 3 else 1)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, chat_repair.damaged(turns).collect()), key=key) == sorted(want, key=key)
    assert {0, 1, 2, 3, 4} <= set(kinds.values())


def test_dropped_empty_and_null(spark):
    assert chat_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, None, None, None, False), (2, None, None, None, None)], SCHEMA + ", gone boolean")
    got = told(chat_repair.repair(rows, gone="gone"))
    assert got[1] == EMPTY
    assert got[2] == (0, 2, 0, 0, 1, 4, "DD", EMPTY[-1])
