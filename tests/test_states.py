"""States projected from streams against a replay of all events in order, over files in any order, restarts and repeats."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.scratch import scratch_path
from tallyforge.streaming import states as S

BEGAN = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def by_hand(kind, events):
    """The state after events of one key, rule by rule."""
    if kind is S.RowStates:
        s = {"state": "pending", "detail": "", "retail": 0.0, "resale": 0.0, "pre_retail": 0.0, "pre_resale": 0.0, "pre_pricing": False}
        for e in events:
            if e["kind"] in ("valued", "stopped"):
                s |= {"pre_retail": 0.0, "pre_resale": 0.0, "pre_pricing": False, "detail": ""}
                s |= {"state": "completed", "retail": e["retail"], "resale": e["resale"]} if e["kind"] == "valued" else {"state": "pending", "retail": 0.0, "resale": 0.0}
            elif e["kind"] == "analyzing":
                s |= {"state": "analyzing", "detail": ""}
            elif e["kind"] in ("failed", "skipped"):
                s |= {"state": e["kind"], "detail": e["message"]}
            elif e["kind"] == "estimated":
                s |= {"pre_retail": e["retail"], "pre_resale": e["resale"], "pre_pricing": False}
            else:
                s["pre_pricing"] = e["kind"] == "estimating"
        return tuple(s.values())
    status, limit, landed, on_page, read, listing, lots = "", 0, 0, 0, 0, None, set()
    for e in events:
        if e["kind"] == "status":
            status = e["message"]
        elif e["kind"] == "page started":
            limit, landed, on_page, status = e["of"], 0, 0, f"Scanning page {e['page']} of {min(e['of'], listing or e['of'])}"
        elif e["kind"] == "lot":
            landed, on_page = e["at"], e["of"]
            if e["lot"] not in lots:
                lots.add(e["lot"])
                status = f"Page {e['page']} — card {e['at']} of {e['of']} on it, {len(lots)} lot(s) on the board" if e["of"] > 1 else f"Page {e['page']} — {len(lots)} lot(s) on the board"
        elif e["kind"] == "page read":
            read, landed, on_page, status = max(read, e["page"]), 0, 0, f"Page {e['page']} — {len(lots)} lot(s) on the board"
        elif e["kind"] == "pages known":
            listing = e["of"]
        else:
            status = f"Scraping done — {e['message']}"
    return status, limit, landed, on_page, read, listing, len(lots)


def some_events(kind, n):
    rng, out = random.Random(3), []
    for seq in range(n):
        e = {"who": rng.choice(["a", "b", "c", "d"]), "seq": seq, "ts": BEGAN + datetime.timedelta(minutes=seq // 3)}
        if kind is S.RowStates:
            e |= {"kind": rng.choice(["analyzing", "valued", "failed", "skipped", "stopped", "estimating", "estimated", "not estimated"]), "retail": float(rng.randint(1, 99)), "resale": float(rng.randint(1, 99)), "message": f"m{seq}"}
        else:
            e |= {"kind": rng.choice(["status", "page started", "lot", "lot", "lot", "page read", "pages known", "walk ended"]), "page": rng.randint(1, 9), "at": rng.randint(1, 5), "of": rng.randint(1, 6), "lot": f"lot {rng.randint(1, 40)}", "message": f"m{seq}"}
        out.append(e)
    return out


@pytest.mark.parametrize("kind", [S.RowStates, S.BoardStates])
def test_stream_equals_a_replay_whatever_the_order_of_files(spark, tmp_path, kind):
    events = some_events(kind, 300)
    want = {who: by_hand(kind, [e for e in events if e["who"] == who]) for who in "abcd"}
    types = {"who": pa.string(), "seq": pa.int64(), "ts": pa.timestamp("us", "UTC"), "kind": pa.string(), "retail": pa.float64(), "resale": pa.float64(), "message": pa.string(), "page": pa.int32(), "at": pa.int32(), "of": pa.int32(), "lot": pa.string()}
    schema = pa.schema([(n, types[n]) for n in events[0]])
    parts = [events[k::7] for k in range(7)]
    parts.append(events[10:20])  # twice
    random.Random(1).shuffle(parts)
    (tmp_path / "in").mkdir()
    folder = scratch_path(spark, "states")

    def run():
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = S.latest(S.projected(stream, kind, "who", "10 days"), "who", folder)
        return {r[0]: tuple(r[1:]) for r in got.collect()}

    for k, part in enumerate(parts[:4]):
        pq.write_table(pa.Table.from_pylist(part, schema), tmp_path / f"in/{k}.parquet")
    run()
    for k, part in enumerate(parts[4:]):
        pq.write_table(pa.Table.from_pylist(part, schema), tmp_path / f"in/x{k}.parquet")
    assert run() == want  # from the checkpoint
    assert run() == want  # nothing new
    table = spark.read.parquet(str(tmp_path / "in"))
    assert {r[0]: tuple(r[1:]) for r in S.replayed(table, kind, "who").collect()} == want


def test_settled_events_are_folded_and_late_ones_left_out(spark, tmp_path):
    """With files in order of time and little lateness, states come out the same from what is kept of older events."""
    events = some_events(S.BoardStates, 200)
    (tmp_path / "in").mkdir()
    schema = pa.Table.from_pylist(events).schema
    for k in range(10):
        pq.write_table(pa.Table.from_pylist(events[20 * k : 20 * k + 20], schema), tmp_path / f"in/{k}.parquet")
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        if not k:
            folder = scratch_path(spark, "states")
        if k in (0, 4, 9):
            got = S.latest(S.projected(stream, S.BoardStates, "who", "1 minute"), "who", folder)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {who: by_hand(S.BoardStates, [e for e in events if e["who"] == who]) for who in "abcd"}
