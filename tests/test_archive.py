"""The archive of readings: what a store rewrites, what a broken-off or beaten store leaves."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.scratch import scratch_path
from tallyforge.sources.archive import SCHEMA, ReadingArchive


def _rows(spark, *rows):
    return spark.createDataFrame([(lot, "m", 1, url, 1, generation, f"{lot}{url}{generation}") for lot, url, generation in rows], SCHEMA)


def _held(archive):
    return {(r.lot, r.url): r.generation for r in archive.read().collect()}


def _files(archive):
    return archive._manifest()[1]["files"]


def test_a_store_rewrites_only_the_buckets_of_its_lots(spark):
    archive = ReadingArchive(spark, scratch_path(spark, "archive"), buckets=16)
    archive.store(_rows(spark, *((f"lot{i}", "u", 1) for i in range(200))))
    before = _files(archive)
    assert len(before) == 16
    archive.store(_rows(spark, ("lot7", "v", 1), ("lot7", "u", 3)))
    after = _files(archive)
    assert sum(before[b] != after[b] for b in after) == 1
    archive.forget(spark.createDataFrame([("lot9",), ("no such lot",)], "lot string"))
    assert 1 <= sum(after[b] != p for b, p in _files(archive).items()) <= 2
    held = _held(archive)
    assert len(held) == 200 and held["lot7", "u"] == 3 and held["lot7", "v"] == 1 and ("lot9", "u") not in held
    assert ReadingArchive(spark, archive.folder, buckets=99).buckets == 16  # the first store decides
    archive.forget()
    assert _held(archive) == {} and archive.stored_lots() == 0


def test_a_broken_off_store_leaves_the_last_generation(spark, monkeypatch):
    archive = ReadingArchive(spark, scratch_path(spark, "archive"), buckets=4)
    archive.store(_rows(spark, ("a", "u", 1), ("b", "u", 1)))
    monkeypatch.setattr(archive, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        archive.store(_rows(spark, ("a", "u", 2)))
    again = ReadingArchive(spark, archive.folder)
    assert _held(again) == {("a", "u"): 1, ("b", "u"): 1}
    again.store(_rows(spark, ("a", "u", 2)))
    assert _held(again) == {("a", "u"): 2, ("b", "u"): 1}


def test_of_two_stores_at_once_one_is_an_error(spark):
    archive = ReadingArchive(spark, scratch_path(spark, "archive"), buckets=4)
    archive._commit(1, {})
    with pytest.raises(RuntimeError, match="store again"):
        archive._commit(1, {})


def test_random_stores_match_a_dictionary(spark):
    rng, archive, want = random.Random(4), None, {}
    folder = scratch_path(spark, "archive")
    for _ in range(5):
        archive = ReadingArchive(spark, folder, buckets=8)
        rows = [(rng.choice("abcdefgh"), rng.choice("uvw"), rng.randint(1, 9)) for _ in range(12)]
        archive.store(_rows(spark, *rows))
        for lot, url, generation in rows:
            want[lot, url] = max(want.get((lot, url), 0), generation)
        gone = rng.choice("abcdefgh")
        archive.forget(spark.createDataFrame([(gone,)], "lot string"))
        want = {k: g for k, g in want.items() if k[0] != gone}
        assert _held(archive) == want
    archive.store(spark.createDataFrame([], SCHEMA))
    assert archive.read("other").count() == 0 and archive.read().where(F.col("model") == "m").count() == len(want)
