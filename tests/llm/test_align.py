"""Alignment of two tokenizations against whole texts encoded by the libraries and compared token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyforge.llm import align
from tallyforge.llm.queries import op11_token_alignment, vocabulary

PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        # the byte-level alphabet, by its rule
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(plain)))}

    def tokens(self, text):
        """([(id, first, end)] of A, of B) in bytes of the space and text; nothing where the bytes differ."""
        if not text:
            return [], []
        want, sides = (" " + text).encode(), []
        encoded = self.a.encode(" " + text, add_special_tokens=False)
        pieces = [self.b.id_to_piece(i) for i in self.b.encode(text)]
        a = [(i, bytes(self.bytes_of[c] for c in self.a.id_to_token(i))) for i in encoded.ids]
        b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in zip(self.b.encode(text), pieces)]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            sides.append(out)
        return sides

    def aligned(self, texts):
        """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups)] of all texts."""
        each, total = [], Counter()
        for text in texts:
            a, b = self.tokens(text)
            cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups, low = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in (a, b)))
                low = cut
            links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e] if len(a) < 400 else self.links(a, b)
            total.update(links)
            each.append((len(a), len(b), len(cuts), links, ";".join(groups)))
        most = defaultdict(int)
        for (_, y), n in total.items():
            most[y] = max(most[y], n)
        return [(n_a, n_b, n_g, len(ls), sum(total[x] == most[x[1]] for x in ls), sum(total[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if n_a else "", g) for n_a, n_b, n_g, ls, g in each]

    @staticmethod
    def links(a, b):
        out, k = [], 0
        for x, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                out.append((x, b[j][0]))
                j += 1
        return out


def random_texts():
    rng = random.Random(4)
    parts = ["the ", "Hello", " wörld", "\n", "\n ", "  ", "   x", "\t", " ", "  a", "　", "’s", "'s", " 're", "日本語", " 日本", "é", "é", "\x00", "\x1c", "\x85", "<s>", "</s> ", "<|endoftext|>", " <unk>", "<0x41>", "1234", " 5.", "====", "-", " ", "𝔘", " ́", "ÿ", "🙂 ", "​", " ", "\r\n", "ß "]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]
    return [*texts, None, "", " ", "  ", "\n", "a▁b", "▁", " a", "a ", "a" * 1000, "= " * 500, "x ▁ y", "the same text", "the same text", "no▁blank here"]


@pytest.mark.parametrize("part", [1 << 23, 60])
def test_hostile_texts_match_whole_encodings(spark, part):
    texts = random_texts()
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as side", "'x' as ids", "2 as row")
    got = Counter(tuple(r) for r in align.align(docs.repartition(5), *PATHS, groups=True, part=part).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, Plain().aligned(texts), strict=True))
    assert got == want
    assert sum(x[1] == 0 for x in want) >= 5


def test_texts_over_many_windows(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "über", "naïve", "日本語", "tokenizers", "12345"]
    texts = [" ".join(rng.choices(words, k=60_000)), "=" * 200_001, "short one", "x" * 70_000 + " end", None, "é" * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert align.events(docs, *PATHS).where("at > 0").count() > 20
    plain = Plain()
    got = {r[0]: tuple(r[1:]) for r in align.align(docs, *PATHS).collect()}
    for i, text in enumerate(texts):
        a, b = plain.tokens(text)
        ends_b = {e for _, _, e in b}
        cuts = [e for _, _, e in a if e in ends_b]
        assert got[i][:4] == (len(a), len(b), len(cuts), len(plain.links(a, b)))


def test_whole_table(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    df = op11_token_alignment(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    plain = Plain()
    short = [t for _, t in rows]
    got = sorted(tuple(r) for r in df.collect())
    want = sorted((i, *x[:7]) for (i, _), x in zip(rows, fast(plain, short), strict=True))
    assert got == want


def fast(plain, texts):
    """aligned() without a scan of all tokens for each group."""
    each, total = [], Counter()
    for text in texts:
        a, b = plain.tokens(text)
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        side = []
        for tokens in (a, b):
            groups, now = [], []
            for i, _, e in tokens:
                now.append(str(i))
                if e in ends:
                    groups.append(",".join(now))
                    now = []
            side.append(groups)
        g = ";".join("|".join(x) for x in zip(*side))
        links = plain.links(a, b)
        total.update(links)
        each.append((len(a), len(b), len(ends), links, g))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return [(n_a, n_b, n_g, len(ls), sum(total[x] == most[x[1]] for x in ls), sum(total[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if n_a else "") for n_a, n_b, n_g, ls, g in each]


def test_empty(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    assert [tuple(r) for r in align.align(spark.createDataFrame([(None, None)], "doc_id long, text string"), *PATHS).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_parts_follow_the_links_and_not_the_tasks(spark):
    from tallyforge.llm import align as L

    documents = spark.createDataFrame([(t << 32, t, 10) for t in range(40)], "part long, doc_id long, n_links long")
    joint = L.joint_parts(documents, 100)
    assert joint.columns == documents.columns
    assert sorted(r["count"] for r in joint.groupBy("part").count().collect()) == [10] * 4
