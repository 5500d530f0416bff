import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in jaccard_join.jaccard_join(df, **more).collect()), key=str)


def test_join_of_documents_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("part", [7, 1000])
def test_hot_groups_of_near_copies(spark, part, monkeypatch):
    rng = random.Random(part)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(9)}" for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    assert run(spark, rows, part=part) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One\ttwo "), (6, "one"), (7, long), (8, long + " tail"), (9, "a b c d e"), (9, "a b c d e"), (9, "z z z z z z"), (None, "a b c d E"), (10, "one two three")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, "q r s t u v")]) == [(None, 2, None)]
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_third_order_is_independent_of_frequency():
    """Each order leaves all links in and takes more of the others out."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(400, 60, p=(w := 1 / np.arange(1, 401)) / w.sum())).astype(np.uint64) for _ in range(300)]
    sets += [np.unique(np.concatenate((x[1:], rng.integers(400, 500, 1).astype(np.uint64)))) for x in sets[:40]]
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = [np.array([v for v in x if count[np.searchsorted(value, v)] > 1], np.uint64) for x in sets]
    counts = [count[np.searchsorted(value, x)].astype(np.uint32) for x in shared]
    group = jaccard_join.Group([len(x) for x in sets], [x.tobytes() for x in shared], [c.tobytes() for c in counts])
    whole = np.ones(len(sets), dtype=bool)
    for i, x in enumerate(sets):
        found = set(group.candidates(i, whole).tolist())
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert 100 * both < 80 * (len(x) + len(y) - both) or j in found
    assert group.left[0] > group.left[1] >= group.left[2] > group.left[3]


def test_rows_of_a_large_block_grow_with_its_sets(spark, monkeypatch):
    """Two sizes of a block of near copies beside a block of many small classes: what is sent is not squared."""
    sent = []
    tasks = jaccard_join._tasks
    monkeypatch.setattr(jaccard_join, "_tasks", lambda rows: sent.append(rows.count()) or tasks(rows))
    base = [f"w{i}" for i in range(40)]
    for n in (1000, 4000):
        near = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(n)]
        small = [(n + i, " ".join([*(f"y{i // 2}-{j}" for j in range(12)), *base[:9]])) for i in range(n)]
        df = spark.createDataFrame(near + small, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df, part=50).collect()}
        assert all(got[n + i] == n + i - i % 2 for i in range(n))
    small, large = sum(sent[: len(sent) // 2]), sum(sent[len(sent) // 2 :])
    assert large < 8 * small


def test_a_shingle_takes_no_more_bytes_where_buckets_are_many(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(60))) for i in range(2400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(1)
    sent = [df.mapInArrow(jaccard_join._dealt(n, 8), jaccard_join.ROWS).where(F.col("kind") == jaccard_join.LISTED).agg(F.sum(F.length("blob") - 56)).first()[0] for n in (64, 1024)]
    assert sent[1] <= sent[0] < 10 * 2400 * 56


def test_equal_sets_of_many_batches_and_buckets(spark, monkeypatch):
    """Copies lie in several batches, of which some are equal as a whole; hashes are sent short."""
    monkeypatch.setattr(jaccard_join, "bucketed", lambda rows: (300, 8))
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))) for _ in range(30)]
    rows = [(i, base[i % 30]) for i in range(90)]  # three partitions of the same texts
    rows += [(90 + i, re.sub(r"w7\d*", "x", base[i % 30])) for i in range(30)] + [(120, None), (121, "")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows[:90], 3).union(spark.sparkContext.parallelize(rows[90:], 2)), "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.jaccard_join(df).collect()), key=str) == brute(rows)
