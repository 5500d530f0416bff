import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import packing, token_files
from tallyforge.llm.common import scratch_path
from tallyforge.llm.queries import op9_token_files, op10_packing, vocabulary
from tallyforge.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
ODD = ["it's a TEST's '''s", "<|endoftext|>x foo<|endoftext|>", "İstanbul ΑΣ ς é ́a", "a b\tc\x1cd\x85e", "", "'  \n ", "x’s ÀÉ×÷ 12 a1b2 $$$", "ſt K", "a×!é÷.é!̸x", "don't!'s.'t<a|b>", "x" * 600 + "Y" * 600, None]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_gives_the_librarys_ids(library):
    coder = Encoder(vocabulary())
    assert coder.by_piece
    for batch in (ODD, ODD[2:], ODD[2:] * 3):
        ids, at = coder.encode(pa.array(batch))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(batch))] == [library(x) for x in batch]


def test_token_files_round_trip(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op9_token_files(spark, SF).collect()}
    start = 0
    for r in rows:
        ids = np.array(library(r.text) + [1], "<u4")
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_reader_decompresses_only_asked_frames_and_notices_damage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 8)
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = token_files.ShardWriter(f, 2)
        for d in range(10):
            w.add(d, np.arange(d, d + 5, dtype=np.uint32))
        w.close()
    import zstandard
    from pyarrow import fs

    system = fs.LocalFileSystem()
    with system.open_input_file(str(path)) as f:
        reader = token_files.ShardReader(f)
        seen = []
        frame = reader.frame
        reader.frame = lambda k: seen.append(k) or frame(k)
        assert [(d, x.tolist()) for _, d, x in reader.documents({7})] == [(7, [7, 8, 9, 10, 11])]
        assert seen == [3]
    data = path.read_bytes()
    assert len(zstandard.ZstdDecompressor().decompressobj().decompress(data)) == 20  # the first frame alone is a plain frame
    path.write_bytes(data[:20] + bytes([data[20] ^ 255]) + data[21:])
    with system.open_input_file(str(path)) as f, pytest.raises(Exception):
        list(token_files.ShardReader(f).documents())


def test_token_files_edge_rows(spark, library):
    rows = [(5, "b b", "x"), (5, "b b", "y"), (None, "n", "z"), (7, None, "u"), (-3, "", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    for df in (docs, docs.limit(0)):
        manifest = token_files.write_token_files(df, scratch_path(spark, "t"), vocabulary()).cache()
        out = token_files.placed(spark, manifest, token_files.read_token_files(manifest)).orderBy("start").collect()
        assert [(r.doc_id, r.n_tokens) for r in out] == ([(None, 2), (-3, 1), (5, 3), (5, 3), (7, 1)] if df is docs else [])


def _check_pieces(rows, expected, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(expected)
    for d, ids in expected.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    return padding / total


def test_packing_places_each_id_once(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    out = op10_packing(spark, "/root/testdata/sf0.01").collect()
    assert _check_pieces(out, {r.doc_id: library(r.text) + [2] for r in rows}, 4096) < 0.02


def test_packing_edge_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "long " * 5000, "z"), (None, "a", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").coalesce(1)
    _check_pieces(packing.pack_documents(docs, vocabulary()).collect(), {r[0]: library(r[1]) + [2] for r in rows}, 4096)
    assert packing.pack_documents(docs.limit(0), vocabulary()).collect() == []
    got = packing.pack_documents(docs, vocabulary(), with_ids=True).where("doc_id = 3").orderBy("start").collect()
    assert [i for r in got for i in r.ids] == library("long " * 5000) + [2]


def test_differencing_fills_and_raises_the_count():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 1025, size=rng.integers(1, 400))
        bins = packing.pack_cell(sizes, 4096)
        sums = np.bincount(bins, weights=sizes)
        assert sums.max() <= 4096 and len(sums) <= -(-sizes.sum() // 4096) + 2
    assert sorted(np.bincount(packing.pack_cell(np.array([3, 3, 3]), 5), weights=[3, 3, 3])) == [3, 3, 3]
