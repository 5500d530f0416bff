import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import suffix_dedup
from tallyforge.llm.queries import op2_suffix_dedup


def brute(rows, n=100):
    """rows (doc_id, text) in their order; rows that are equal are one document."""
    seen, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for k, (d, t) in enumerate(texts):
        where = (d, t)
        for i in range(len(t) - n + 1):
            seen.setdefault(hashlib.blake2b(t[i : i + n], digest_size=12).digest(), (where, i))
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[hashlib.blake2b(t[i : i + n], digest_size=12).digest()] != ((d, t), i):
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in suffix_dedup.deduplicate(df, digests=True, **more).collect()), key=str)


def test_documents_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted((tuple(r) for r in op2_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows) and any(r[2] for r in got)


@pytest.mark.parametrize("more", [{}, {"hot": 2}, {"piece": 130, "hot": 3}])
def test_random_passages(spark, more):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([60, 99, 100, 101, 150, 400]))) for _ in range(12)]
    rows = []
    for i in range(80):
        text = ""
        for _ in range(rng.randrange(6)):
            text += rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(120)))
        rows.append((i, text))
    assert run(spark, rows, **more) == brute(rows)


def test_edge_rows(spark):
    a = "".join(chr(97 + (i * i) % 23) for i in range(250))
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, a), (4, a), (5, a[:99]), (6, a[:100]), (7, "é" * 300 + a), (8, "ab" * 30_000), (9, "a" * 100)]
    assert run(spark, rows) == brute(rows)
    assert [r[2] for r in run(spark, [(None, a), (3, a)])] == [227, 250]  # the text repeats itself, too
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_overlap():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(700)).encode()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "tie": [2], "at": [5], "text": [long]})
    parts = list(suffix_dedup._pieces(iter([batch]), 64))
    starts = [int(p[4][0]) - 5 + i for p in parts for i in range(len(p[0]) - 99)]
    assert starts == list(range(601)) and all(bytes(p[0]) == long[int(p[4][0]) - 5 :][: len(p[0])] for p in parts)


def test_tasks_settle_strings_that_they_have_sent():
    seen = suffix_dedup.Seen(bits=1)
    column = lambda *x: np.array(x, dtype=np.int64)
    ask = lambda name, second, doc, start: seen.later(column(*name).astype(np.uint64), column(*second).astype(np.uint64), column(*doc), column(*[0] * len(doc)), column(*start)).tolist()
    assert ask([7, 8], [1, 1], [5, 5], [0, 9]) == [False, False]
    assert ask([8], [1], [6], [0]) == [True] and ask([8], [2], [6], [0]) == [False]
    assert ask([8], [2], [6], [0]) == [False] and ask([8], [2], [5], [9]) == [False] and ask([8], [2], [5], [10]) == [True]


def test_kept_and_spans(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(250))
    df = spark.createDataFrame([(1, a), (2, "head " + a[50:] + " tail")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.spans) for r in suffix_dedup.deduplicate(df).collect()}
    assert got == {1: (a.encode(), []), 2: (b"head  tail", [5, 205])}


if __name__ == "__main__":
    pytest.main([__file__])
