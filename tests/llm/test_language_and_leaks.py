import collections
import random
import re
import zlib

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontam, langid
from tallyforge.llm.common import utf8_bytes
from tallyforge.llm.queries import op1_language_id, op3_decontamination

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97


def test_language_edge_rows(spark):
    docs = [(i, "the house and the tree " * 5 if i % 2 else "das haus und der baum " * 5, "en" if i % 2 else "de", "x") for i in range(200)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"))
    rows = [(1, None), (2, ""), (3, "123 *** \n"), (4, "the tree"), (5, "DER BAUM UND"), (6, "漢字"), (7, "q"), (4, "the tree"), (None, "das haus " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0.5) for r in langid.identify(df, model).collect())
    assert got == sorted([("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "en", True), ("4", "en", True), ("5", "de", True), ("6", model.languages[model.common], False), ("7", model.languages[model.common], False), ("None", "de", True)])
    nothing = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_stage_drops_texts_without_a_known_ngram(spark):
    docs = [(i, "the house and the tree " * 5 if i % 2 else "das haus und der baum " * 5, "en" if i % 2 else "de", "x", 100) for i in range(200)]
    odd = [(1000, "漢字", None, "x", 2), (1001, "zzqx qqxz", None, "x", 9), (1002, "1 2", None, "x", 3), (1003, "the tree", None, "x", 8)]
    rows = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.with_language(spark, rows, SF).collect()) == [*range(200), 1003]


def test_more_than_64_languages_are_all_learned(spark):
    names = [f"l{i:02}" for i in range(70)]
    word = lambda i: "bcdfghjkl"[i // 9] + "aeiouyäöü"[i % 9] * 3 + "mnpqrstvw"[i % 9]
    docs = [(k * 100 + i, f"{word(i)} " * 9, lang) for i, lang in enumerate(names) for k in range(8)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.languages == names
    asked = spark.createDataFrame([(i, f"{word(i)} " * 5) for i in range(70)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == dict(enumerate(names))


def _windows(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _shingles(words):
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def brute_leaks(docs, items):
    out = {}
    prepared = [(i, _windows(t), _shingles(_windows(t))) for i, t in items if t and _windows(t)]
    known = {s for _, _, c in prepared for s in c}
    any_short = any(len(w) < 5 for _, w, _ in prepared)
    for d, text in docs:
        words = _windows(text or "")
        if not words or not (any_short or known & set(_shingles(words))):
            continue
        for i, item, counts in prepared:
            n, best = len(item), None
            for a in range(max(1, len(words) - n + 1)):
                own = _shingles(words[a : a + n])
                low = sum((own & counts).values())
                s = low / (sum(own.values()) + sum(counts.values()) - low)
                if s >= 0.8 and (best is None or s > best[0]):
                    best = (s, a)
            if best:
                out[(d, i)] = best
    return out


def test_leaks_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in op3_decontamination(spark, SF).collect()}
    assert want and set(got) == set(want)
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_leak_edge_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "Three Word item"), (3, None), (4, ""), (5, item.upper())], "item_id long, text string")
    rows = [(1, f"before {item} after"), (2, None), (3, ""), (4, "three  word\nITEM"), (5, "x three word item y z q"), (6, " ".join(item.split()[:18])), (7, "z " * 50_000 + item), (8, item.replace("w9", "other")), (1, f"before {item} after")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id, r.start_word) for r in decontam.find_leaks(df, items).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 5, 1), (1, 5, 1), (4, 2, 0), (5, 2, 1), (6, 1, 0), (6, 5, 0), (7, 1, 50_000), (7, 5, 50_000)]
    assert sorted(r.doc_id for r in decontam.without_leaks(df, items).collect()) == [2, 3, 8]
    assert decontam.find_leaks(df, items.limit(0)).count() == 0 and decontam.find_leaks(df.limit(0), items).count() == 0


def test_index_finds_everything_within_the_radius():
    import numpy as np

    texts = [" ".join(f"{a}{b}" for b in range(20)) for a in range(70)]
    index = decontam.Index(list(range(70)), texts)
    rng = np.random.default_rng(0)
    probes = np.array([int(index.prints[i % 70]) ^ sum(1 << int(b) for b in rng.choice(64, size=i % 25, replace=False)) for i in range(2000)], dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in index.within_radius(probes)), strict=True))
    assert got == {(w, i) for w in range(2000) for i in range(70) if int(probes[w] ^ index.prints[i]).bit_count() <= decontam.RADIUS}
    assert index.leaks(*utf8_bytes(pa.array(["", "a"]))) == []


def test_short_items_in_documents_of_any_length_match_brute_force():
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(1 + i % 7))) for i in range(40)]
    docs = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for d in range(300)]
    index = decontam.Index([i for i, _ in items], [t for _, t in items])
    got = {(d, i): (s, a) for d, i, s, a, _ in index.leaks(*utf8_bytes(pa.array([t for _, t in docs])))}
    want = brute_leaks(docs, items)
    assert {k[1] for k in want if k[1] % 7 < 4} and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_five_thousand_items_in_parts(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(8))
    items = spark.createDataFrame([(i, text(i)) for i in range(5000)] + [(17, text(17))] * 3, "item_id long, text string")
    assert len(list(decontam._parts(items))) == 3
    docs = spark.createDataFrame([(i, f"a b {text(i * 50)} c") for i in range(100)] + [(1000, text(17))], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word) for r in decontam.find_leaks(docs, items).collect())
    assert got == sorted([(i, i * 50, 2) for i in range(100)] + [(1000, 17, 0)] * 4)
    assert decontam.without_leaks(docs, items).count() == 0


def test_many_ngrams_widen_the_filter(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLOT_BITS", 4)
    docs = [(k * 100 + i, " ".join(f"{a}{b}{c}" for a in "abcde" for b in "xyz"[: 2 + i] for c in ("uvw" if i else "rst")), f"l{i}") for i in range(2) for k in range(8)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.slots.shape[1] > 16 and (model.false_rate < 0.2).all()
