"""Packers of long groups against a loop, at several block sizes and partition counts."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import long_groups as L
from tallyforge.operators import sequences as S


def next_fit(sizes, width, budget):
    out, batch, n, used = [], -1, 0, 0
    for x in sizes:
        if batch < 0 or n >= width or used + x > budget:
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + x
        out.append(batch)
    return out


def greedy(sizes, budget):
    out, used = [], 0
    for x in sizes:
        out.append(used + x <= budget)
        used += x * out[-1]
    return out


def _groups(rng, sizes):
    lengths = {1: 1, 2: 3, 3: 700, None: 40, 5: 17, 6: 2000}
    return {g: [rng.choice(sizes) for _ in range(n)] for g, n in lengths.items()}


@pytest.mark.parametrize("width,budget,sizes,most", [(3, 10, [1, 2, 5, 9, 30], 4), (5, 100, [0, 1, 99, 40], 64), (1, 5, [1, 9], 7), (24, 1000, [1, 50, 300], 16), (6, 50, [50, 10], 16384), (50, 90, [1, 2], 8)])
def test_next_fit_and_budget_match_a_loop(spark, width, budget, sizes, most):
    rng = random.Random(width)
    groups = _groups(rng, sizes)
    rows = [(g, i, n) for g, items in groups.items() for i, n in enumerate(items)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "lot long, i int, n long").withColumn("batch", F.lit("clash")).repartition(3)
    got = {}
    for r in L.next_fit(df, "lot", F.col("i"), "n", width, budget, most).collect():
        got.setdefault(r.lot, {})[r.at] = r.batch
    assert {g: [x[i] for i in range(len(x))] for g, x in got.items()} == {g: next_fit(x, width, budget) for g, x in groups.items()}
    taken = {}
    for r in L.greedy_budget(df, "lot", F.col("i"), "n", budget, most).collect():
        taken.setdefault(r.lot, {})[r.at] = r.taken
    assert {g: [x[i] for i in range(len(x))] for g, x in taken.items()} == {g: greedy(x, budget) for g, x in groups.items()}


def test_small_groups_as_by_arrays(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randint(0, 9), i, rng.randint(1, 40)) for i in range(300)], "lot long, i int, n long")
    key = lambda rows: sorted(map(tuple, rows))
    assert key(L.next_fit(df, "lot", F.col("i"), "n", 4, 60, 8).collect()) == key(S.next_fit(df, "lot", F.col("i"), "n", 4, 60).collect())
    assert key(L.greedy_budget(df, "lot", F.col("i"), "n", 90, 8).collect()) == key(S.greedy_budget(df, "lot", F.col("i"), "n", 90).collect())
    assert L.next_fit(df.limit(0), "lot", F.col("i"), "n", 4, 60).count() == L.greedy_budget(df.limit(0), "lot", F.col("i"), "n", 4).count() == 0


def test_one_group_of_a_million_rows(spark):
    df = spark.range(1_000_000).selectExpr("7L as lot", "id", "pmod(id * 7919, 97) as n")
    packed = L.next_fit(df, "lot", F.col("id"), "n", 8, 300)
    sizes = [i * 7919 % 97 for i in range(1_000_000)]
    want = next_fit(sizes, 8, 300)
    got = packed.groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("batch").alias("last"), F.sum(F.col("batch") * (F.col("at") % 1009)).alias("s")).first()
    assert tuple(got) == (1_000_000, want[-1], sum(b * (i % 1009) for i, b in enumerate(want)))
