"""The bitmask filter, its popcounts and their correction, recomputed one n-gram at a time in plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import langid
from tallyforge.llm.common import utf8_bytes

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def slots_of(gram, n):
    """gram: four bytes. Its places in a filter of n slots."""
    h = mixed(int.from_bytes(gram, "little") + 0x1234567)
    first, step = h >> 32, h & 0xFFFFFFFF | 1
    return [((first + i * step) & 0xFFFFFFFF) % n for i in range(3)]


def grams_of(text):
    seen = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    return [seen[i : i + 4] for i in range(len(seen) - 3) if seen[i : i + 4] != b"    "]


class Plain:
    """A filter whose slots are numbers of any width: bit l is language l."""

    def __init__(self, rows):
        counts = {}
        for text, lang in rows:
            counts.setdefault(lang, Counter()).update(grams_of(text))
        self.languages = sorted(counts)
        kept = [{g: n for g, n in counts[lang].items() if n >= 3} for lang in self.languages]
        shares = [{g: n / max(1, sum(k.values())) for g, n in k.items()} for k in kept]
        claims = [[g for g, x in s.items() if x >= max(o.get(g, 0) for o in shares) / 4] for s in shares]
        self.n, self.slots = 1 << 20, {}
        for bit, grams in enumerate(claims):
            for g in grams:
                for at in slots_of(g, self.n):
                    self.slots[at] = self.slots.get(at, 0) | 1 << bit
        self.rate = [(sum(m >> bit & 1 for m in self.slots.values()) / self.n) ** 3 for bit in range(len(self.languages))]

    def points(self, text):
        """n-grams of each language, less what false positives are expected to add."""
        hits, grams = [0] * len(self.languages), grams_of(text)
        for g in grams:
            mask = -1
            for at in slots_of(g, self.n):
                mask &= self.slots.get(at, 0)
            for bit in range(len(self.languages)):
                hits[bit] += mask >> bit & 1
        return [max(0.0, (h - len(grams) * r) / (1 - r)) for h, r in zip(hits, self.rate)]


def invented(rng, letters, words):
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(60)]
    return lambda: " ".join(rng.choices(vocabulary, k=words))


@pytest.mark.parametrize("n_languages", [3, 70])
def test_scores_match_a_filter_by_hand(spark, n_languages):
    rng = random.Random(n_languages)
    alphabets = ["abcdefg", "efghijk", "éèabxyz", "日本語言文", "KLMnop"]
    speak = [invented(rng, alphabets[k % 5] + chr(0x3B1 + k % 20), 30) for k in range(n_languages)]
    rows = [(i, speak[i % n_languages](), f"l{i % n_languages:02d}") for i in range(5 * n_languages)]
    rows += [(10_000, None, "l00"), (10_001, "unlabelled", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    held = {r.doc_id for r in df.where(langid.held_out(df["doc_id"])).collect()}
    plain = Plain([(t, lang) for i, t, lang in rows if t and lang and i not in held])
    assert model.languages == plain.languages and model.slots.shape == (-(-n_languages // 64), plain.n)
    for at, mask in plain.slots.items():
        assert mask == sum(int(word[at]) << 64 * k for k, word in enumerate(model.slots))
    assert np.allclose(model.false_rate, plain.rate, rtol=1e-12)
    asked = [t or "" for _, t, _ in rows] + ["", "abc", "   1234 ", speak[0]() + "!!" + speak[1](), "zz zz zz"]
    got = langid.scores(model, *utf8_bytes(pa.array(asked, pa.large_string())))
    for text, points in zip(asked, got):
        assert np.allclose(points, plain.points(text), atol=1e-9)
    told = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, text, _ in rows:
        points = plain.points(text or "")
        if text and sum(points) > 0:
            best = max(range(n_languages), key=lambda k: (points[k], -k))
            assert told[i].lang_pred == plain.languages[best] and told[i].score == pytest.approx(points[best] / sum(points))
    assert told[10_000].lang_pred == "und"
