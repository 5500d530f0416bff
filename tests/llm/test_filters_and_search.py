import datetime
import hashlib
import math
import random

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm import maxscore, secrets, url_filter
from tallyforge.llm.common import scratch_path, utf8_bytes
from tallyforge.llm.queries import op5_secrets, op8_maxscore

SF = "/root/testdata/sf0.01"


WORD, KEYS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), ("password", "passwd", "secret", "token", "api_key", "apikey")


def _assigned(text, at):
    """End of group 2 of an assignment that starts at a place, and its length; by hand, one character after another."""
    low = "".join(c.lower() if c.isascii() else c for c in text[at : at + 8])
    for key in KEYS:
        if not low.startswith(key):
            continue
        for quote in ((1, 0) if text[at + len(key) : at + len(key) + 1] in ("'", '"') else (0,)):
            i = at + len(key) + quote
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] not in (":", "="):
                continue
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            i += text[i : i + 1] in ("'", '"')
            end = i
            while text[end : end + 1] in WORD and end < len(text):
                end += 1
            if end > i:
                return end, end - i
    return None


def _by_hand(text):
    """All base spans without a regular expression."""
    found, i = [], 0
    while i < len(text):
        hit = _assigned(text, i) if text[i] in "pPsStTaA" else None
        if hit and hit[1] >= 6:
            found.append((i, 0, "assign", hit[0]))
        i = hit[0] if hit else i + 1
    for rank, kind, lead, body, least in ((1, "access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            if not text.startswith(lead, i) or text[i + len(lead) : i + len(lead) + 1] not in tuple(body):
                i += 1
                continue
            end = i + len(lead)
            while end < len(text) and text[end] in body:
                end += 1
            if end - i >= least:
                found.append((i, rank, kind, end))
            i = end
    return [(k, a, b) for a, _, k, b in sorted(found)]


def _summary(text):
    base = _by_hand(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
    return (*(sum(k == x for k, _, _ in base) for x in secrets.BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest())


def test_rules_match_a_scan_by_hand():
    rng = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "abc", "abcdef", "0123456789ab", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "é", "ſecret", "\n", "+/", "K"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [x for x in secrets.spans_of(text) if x[0] in secrets.BASE_KINDS] == _by_hand(text), text


def test_secret_rules():
    assert secrets.spans_of('é Password = "abcdef" x') == [("assign", 2, 20)]
    assert secrets.spans_of("token: abc token=abcdefg") == [("assign", 11, 24)]
    assert secrets.spans_of("AKIA" + "A" * 15) == [] and secrets.spans_of("AKIA" + "B" * 16) == [("access", 0, 20)]
    assert secrets.spans_of("0" * 23) == [] and secrets.spans_of("g" + "a" * 24) == [("hex", 1, 25)]
    assert secrets.spans_of("toKen=abcdefg") == []


def test_secrets_over_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = op5_secrets(spark, SF).collect()
    got = {r.doc_id: tuple(r)[1:5] for r in found}
    assert all(r.spans.count(f"{k}:") == r[f"n_{k}"] for r in found for k in secrets.BASE_KINDS)
    assert got == {r.doc_id: _summary(r.text) for r in rows}
    assert sum(r[0] + r[1] + r[2] for r in got.values()) > 0


def test_neighbouring_hex_texts_are_all_scanned(spark):
    key = "0123456789ab" * 2
    texts = ["", key, key[::-1], "", "made", f"{key} starts", "a" * 23, "b", "c" * 23 + "g", "x" + "d" * 24, "e" * 24, ""]
    column = pa.array(texts, pa.string())
    assert secrets.suspects(*utf8_bytes(column)).tolist() == [1, 2, 5, 9, 10]
    assert secrets.suspects(*utf8_bytes(column[2:9])).tolist() == [0, 3]
    blobs = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "blob binary, text string").coalesce(1)
    got = {r.blob[0]: [tuple(s) for s in r.spans] for r in secrets.scan_blobs(blobs).collect()}
    assert got == {i: s for i, t in enumerate(texts) if (s := secrets.spans_of(t))}


def test_ledger_scans_only_unseen_blobs(spark, monkeypatch):
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    rows = [(1, "secret=abcdefgh"), (2, "secret=abcdefgh"), (3, None), (None, "token=abcdefgh"), (None, "token=abcdefgh"), (4, "x" * 100_000 + " AKIA" + "Z" * 16)]
    paths = ledger.update(spark.createDataFrame(rows, "path long, text string"))
    ledger.enter(paths)
    found = ledger.findings_of(paths).collect()
    assert sorted((str(r.path), len(r.spans)) for r in found) == [("1", 1), ("2", 1), ("3", 0), ("4", 1), ("None", 1), ("None", 1)]
    scanned = []
    scan = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda b: scanned.append(b.count()) or scan(b))
    more = ledger.update(spark.createDataFrame([(1, "secret=abcdefgh"), (1, "secret=changed1")], "path long, text string"))
    ledger.enter(more)
    assert scanned == [1]
    assert ledger.scanned().count() == 5 and ledger.findings().count() == ledger.findings().select("blob").distinct().count() + 1
    assert sorted(len(r.spans) for r in ledger.findings_of(more).collect()) == [1, 1]
    empty = ledger.update(spark.createDataFrame([], "path long, text string"))
    assert ledger.findings_of(empty).count() == 0


def test_new_rules_scan_old_blobs_again(spark, monkeypatch):
    ledger = secrets.BlobLedger(spark, scratch_path(spark, "ledger"))
    old = ledger.update(spark.createDataFrame([(1, "made"), (2, "0123456789abcdef0123456789abcdef is here"), (3, "a")], "path long, text string").coalesce(1))
    ledger.enter(old)
    monkeypatch.setattr(secrets, "RULES_VERSION", secrets.RULES_VERSION + 1)
    scanned = []
    scan = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda b: scanned.append(sorted(r.text for r in b.select("text").collect())) or scan(b))
    new = ledger.update(spark.createDataFrame([(1, "made"), (1, "token=abcdefgh")], "path long, text string"))
    ledger.enter(new)
    assert scanned == [["made", "token=abcdefgh"]]
    assert {(r.path, len(r.spans)) for r in ledger.findings_of(old.unionByName(new)).collect()} == {(1, 0), (2, 0), (3, 0), (1, 1)}
    ledger.update(spark.createDataFrame([(2, "0123456789abcdef0123456789abcdef is here")], "path long, text string"))
    assert [len(r.spans) for r in ledger.findings_of(old.where("path = 2")).collect()] == [1]


def test_redaction_joins_overlapping_spans(spark):
    text = "é a token=" + "ab12" * 8 + " z"
    df = spark.createDataFrame([(text, secrets.spans_of(text)), ("plain", [])], f"text string, spans {secrets.SPANS}")
    assert [r[0] for r in df.select(secrets.redacted(F.col("text"), F.col("spans"))).collect()] == ["é a [SECRET] z", "plain"]


def test_url_filter_as_of(spark):
    d = datetime.date
    changes = spark.createDataFrame(
        [
            ("domain", "b.com", "block", "add", d(2024, 1, 10)),
            ("domain", "b.com", "block", "remove", d(2024, 3, 1)),
            ("host", "a.b.com", "block", "add", d(2024, 2, 1)),
            ("prefix", "a.b.com/x/", "allow", "add", d(2024, 2, 1)),
            ("prefix", "a.b.com/x/", "allow", "remove", d(2024, 2, 5)),
            ("prefix", "a.b.com/x/", "allow", "add", d(2024, 2, 5)),
            (None, "zzz", "block", "add", d(2024, 1, 1)),
        ],
        "kind string, value string, verdict string, action string, day date",
    )
    rows = [
        (1, "http://u@A.b.com.:80/x/y?q", d(2024, 2, 1)),
        (2, "http://a.b.com/z", d(2024, 2, 1)),
        (3, "http://q.b.com/", d(2024, 2, 29)),
        (4, "http://q.b.com", d(2024, 3, 1)),
        (5, None, d(2024, 3, 1)),
        (6, "/relative", d(2024, 3, 1)),
        (7, "http://b.com/", None),
        (8, "http://xb.com/", d(2024, 2, 1)),
        (3, "http://q.b.com/", d(2024, 2, 29)),
        (None, "http://b.com/" + "p/" * 3000, d(2024, 1, 10)),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").withColumn("verdict", F.lit("clash"))
    got = sorted((str(r.page_id), r.verdict, r.entry) for r in url_filter.judge(captures, changes).collect())
    assert got == sorted([("1", "allow", "a.b.com/x/"), ("2", "block", "a.b.com"), ("3", "block", "b.com"), ("3", "block", "b.com"), ("4", "allow", None), ("5", "allow", None), ("6", "allow", None), ("7", "allow", None), ("8", "allow", None), ("None", "block", "b.com")])
    assert url_filter.judge(captures.limit(0), changes).count() == 0
    assert {r.verdict for r in url_filter.judge(captures, changes.limit(0)).collect()} == {"allow"}


def _brute(ids, m, query_ids, k):
    out = []
    for q in query_ids:
        s = m @ m[ids.index(q)]
        out += [(q, r + 1, i, int(v)) for r, (v, i) in enumerate(sorted(((-v, i) for v, i in zip(s, ids) if i != q))[:k]) for v in [-v]]
    return sorted(out)


def test_maxscore_search_is_exact():
    rng = np.random.default_rng(0)
    for dense, wide in ((1.0, 1), (0.1, 1), (1.0, 1 << 12), (1.0, 1 << 20)):
        m = rng.integers(-40, 200, (3000, 24)) * (rng.random((3000, 24)) < dense) * wide
        m[100:400] = m[7]
        ids = rng.permutation(3000)
        found, best, _ = maxscore.search(ids[:40], m[:40], maxscore.Shard(ids, m, 26), 5)
        scores = m[:40].astype(object) @ m.T.astype(object)
        for i in range(40):
            want = sorted((-s, d) for s, d in zip(scores[i].tolist(), ids.tolist()) if d != ids[i])[:5]
            assert [(-s, d) for s, d in zip(best[i].tolist(), found[i].tolist())] == want


def test_maxscore_leaves_out_most_products_of_clustered_vectors():
    rng = np.random.default_rng(1)
    m = (rng.normal(0, 200, (40, 64))[rng.integers(0, 40, 8000)] + rng.normal(0, 20, (8000, 64))).astype(np.int64)
    found, best, work = maxscore.search(np.arange(50), m[:50], maxscore.Shard(np.arange(8000), m, 64), 5)
    scores = m[:50] @ m.T
    for i in range(50):
        assert list(zip(best[i].tolist(), found[i].tolist())) == [(-s, d) for s, d in sorted((-s, d) for d, s in enumerate(scores[i].tolist()) if d != i)[:5]]
    assert work.dense == 50 * 8000 * 64
    assert 0 < work.probed < work.essential and work.essential + work.probed < work.dense / 2


def test_maxscore_splits_terms_of_plain_vectors():
    """Vectors without clusters: no part can be left out, but each query has terms that are only probed."""
    rng = np.random.default_rng(2)
    m = np.floor(256 * rng.normal(0, 0.12, (6000, 64))).astype(np.int64)
    _, _, work = maxscore.search(np.arange(40), m[:40], maxscore.Shard(np.arange(6000), m, 64), 5)
    assert work.essential + work.probed < 0.8 * work.dense and work.probed > 0


def test_maxscore_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (50, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in maxscore.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    s = 256 * 256 + 128 * 128
    assert got == [(0, 1, 1, s), (0, 2, 7, s), (0, 3, 7, s), (0, 4, 2, 65536), (0, 5, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0), (50, 4, 7, 0), (50, 5, 7, 0)]
    assert maxscore.top_k(df.limit(0), df.limit(0)).count() == 0
    assert maxscore.top_k(df, df.limit(0)).count() == maxscore.top_k(df.limit(0), df).count() == 0


def test_maxscore_repeated_queries_and_large_components(spark):
    """A query id that comes twice is asked once; a score beyond 63 bits is an error."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in maxscore.top_k(df, df.where("vec_id = 0"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3 << 16), (0, 2, 2, 2 << 16)]
    for large in (1e30, 1e10):
        far = df.unionByName(spark.createDataFrame([(9, [large, 0.0])], df.schema))
        with pytest.raises(Exception, match="63 bits"):
            maxscore.top_k(far, far.where("vec_id in (0, 9)")).collect()


def test_maxscore_over_many_shards(spark):
    """Vectors of several lengths in small shards; queries in small blocks; with copies."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(i, (centres[rng.integers(0, 6)] + rng.normal(0, 0.05, 12))[: rng.choice([12, 12, 7])].tolist()) for i in range(900)]
    rows += [(10, rows[10][1])] * 3 + [(1000 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in maxscore.top_k(df, df.where("vec_id % 20 = 10"), block=64, size=7).collect())
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    m = np.array([v + [0] * (12 - len(v)) for _, v in q])
    want = []
    for own in sorted({i for i, _ in rows if i % 20 == 10}):
        scores = m @ m[[i for i, _ in rows].index(own)]
        best = sorted((-s, i) for s, (i, _) in zip(scores.tolist(), rows) if i != own)[:5]
        want += [(own, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_maxscore_floors_keep_blocks_from_shards(spark):
    """A block is not sent to shards that cannot reach its floors, and what is sent with a floor takes less work."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (8, 32))
    m = np.concatenate([c + rng.normal(0, 10, (500, 32)) for c in centres]).astype(np.int64)
    rows = spark.createDataFrame([(i, i // 1000, v.tolist(), i // 500) for i, v in enumerate(m)], "vec_id long, part int, q array<long>, pivot int")
    shards = maxscore.blocks(rows.coalesce(1).sortWithinPartitions("part", "pivot", "vec_id"), 500, ("pivot",)).cache()
    asked = lambda floor: maxscore.blocks(rows.where("vec_id < 5").coalesce(1).withColumn("floor", F.lit(floor)).withColumn("home", F.lit(-1).cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).sortWithinPartitions("part"), 256, ("floor", "home"))
    floor = int(np.sort(m[:5] @ m.T, axis=1)[:, -5].min())
    assert maxscore.routed(asked(maxscore.NONE), shards, False).count() == 8
    assert maxscore.routed(asked(floor), shards, False).count() < 4
    shard = maxscore.Shard(np.arange(500), m[:500], 32)
    _, _, fresh = maxscore.search(np.arange(5), m[:5], shard, 5)
    _, _, known = maxscore.search(np.arange(5), m[:5], shard, 5, np.full(5, floor))
    assert known.essential + known.probed < fresh.essential + fresh.probed


def test_maxscore_query(spark):
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    m = np.array([v for _, v in rows])
    ids = [i for i, _ in rows]
    assert sorted(tuple(r) for r in op8_maxscore(spark, SF).collect()) == _brute(ids, m, [i for i in ids if i % 50 == 0], 5)
