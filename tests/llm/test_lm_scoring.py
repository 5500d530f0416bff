"""Elias-Fano sequences against plain arrays; scores against a model kept in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import lm_scoring
from tallyforge.llm.elias_fano import EliasFano, mapped
from tallyforge.llm.queries import op13_lm_scoring


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 1 << 40), (3000, 3100), (3000, 1 << 33), (700, 50)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)) if universe < n else np.sort(rng.choice(universe, n, replace=False) if universe < 1 << 20 else np.unique(rng.integers(0, universe, n))[:n])
    ef = EliasFano.of(values, universe)
    ef = EliasFano(*mapped(ef.arrays()), ef.n, ef.width)
    at = rng.permutation(len(values))
    assert (ef[at] == values[at]).all()
    asked = np.concatenate((values, rng.integers(0, universe, 2000)))
    found = ef.find(asked)
    assert (np.isin(asked, values) == (found >= 0)).all()
    assert (values[found[found >= 0]] == asked[found >= 0]).all()
    bits = 8 * sum(a.nbytes for a in ef.arrays())
    if n == 3000:
        assert bits < n * (6 + math.log2(universe / n)) + 512


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0D]+", lower), None]


def by_hand(rows):
    """rows: (id, text, learned from) -> id: (n_tokens, n_known, base, score)."""
    START, step = object(), lm_scoring.STEP
    c1, c2, c3 = Counter(), Counter(), Counter()
    for _, text, train in rows:
        if train:
            t = tokens(text)
            c1.update(t)
            c1[START] += 1
            c2.update(zip([START, *t], t))
            c3.update(zip([START, *t], t, t[1:]))
    n, v = sum(c1.values()) - c1[START], len([w for w in c1 if w is not START and c1[w]])
    floor = lambda p: -step * math.ceil(-math.log10(p) / step)
    base = lambda b: (c1[b] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda m, b: (c2[m, b] + lm_scoring.K2 * base(b)) / (c1[m] + lm_scoring.K2)
    out = {}
    for i, text, _ in rows:
        t, score = tokens(text), 0.0
        for k, b in enumerate(t):
            m, a = t[k - 1] if k else START, (t[k - 2] if k > 1 else START) if k else None
            low = floor(p2(m, b)) if c2[m, b] else floor(lm_scoring.K2 / (c1[m] + lm_scoring.K2)) + math.log10(base(b))
            if k and c3[a, m, b]:
                low = floor((c3[a, m, b] + lm_scoring.K3 * p2(m, b)) / (c2[a, m] + lm_scoring.K3))
            elif k and c2[a, m]:
                low += floor(lm_scoring.K3 / (c2[a, m] + lm_scoring.K3))
            score += low
        out.setdefault(i, []).append((len(t), sum(c1[b] > 0 for b in t), sum(math.log10(base(b)) for b in t), score))
    return out, n


@pytest.mark.parametrize("block,shard", [(40, 64), (1 << 20, 1 << 22)])
def test_scores_match_a_model_in_dictionaries(spark, block, shard):
    rng = random.Random(3)
    words = ["a", "B", "b", "c", "dé", "eÉ", "f g", "x" * 600, "X" * 600]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(7, rows[7][1]), (500, None), (501, ""), (502, "only here"), (503, "a b " * 300), (504, "a b " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'y' as train", "0 as score")
    learned = F.col("doc_id") % 3 != 1
    got = defaultdict(list)
    for r in lm_scoring.scores(docs, learned, block, shard).collect():
        got[r.doc_id].append(r)
        assert r.held_out == (r.doc_id % 3 == 1)
    want, n = by_hand([(i, text, i % 3 != 1) for i, text in rows])
    assert got.keys() == want.keys()
    for i in want:
        assert len(got[i]) == len(want[i])
        for r, (size, known, base, score) in zip(got[i], want[i], strict=True):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n)
            assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=2 * lm_scoring.STEP)


def test_probabilities_sum_to_at_most_one():
    """Over all words, the last of which was never seen, after every pair of words and after the start."""
    rng = np.random.default_rng(1)
    n, text = 12, rng.integers(0, 11, 400)
    before, before2 = np.roll(text, 1), np.roll(text, 2)
    before[0], before2[0], before2[1] = n, -1, n
    c1 = np.bincount(text, minlength=n)
    base = np.log10((c1 + 0.1) / (len(text) + 0.1 * n))
    pairs, of, c2 = np.unique(np.stack((before, text)), axis=1, return_inverse=True, return_counts=True)
    triples, c3 = np.unique(np.stack((of[:-1], of[1:])), axis=1, return_counts=True)
    contexts = np.append(np.bincount(text[:-1], minlength=n), 1)  # the last token is no context
    trie = lm_scoring.Trie(base, contexts, pairs, c2, triples, c3)
    for a in range(-1, n + 1):
        for m in range(n + (a < 0)):  # nothing stands before the start
            every, before = np.arange(n), np.full(n, m)
            node = trie.pairs(np.array([m]), np.array([a])) if a >= 0 else np.array([-1])
            total = (10 ** trie.score(every, before, trie.pairs(every, before), np.repeat(node, n))).sum()
            assert (0.9 if (a, m) != tuple(text[-2:]) else 0.8) < total <= 1 + 1e-9


def test_without_training_documents(spark):
    r = lm_scoring.scores(spark.createDataFrame([(0, "x y")], "doc_id long, text string"), F.lit(False)).collect()[0]
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)


def test_empty_and_null(spark):
    assert lm_scoring.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    r = lm_scoring.scores(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_tokens, x.held_out) for x in r) == [(None, 1, zlib.crc32(b"") % 10 == 0), (None, 2, zlib.crc32(b"") % 10 == 0)]


def test_held_out_texts_score_better_than_by_the_base(spark):
    rows = op13_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
