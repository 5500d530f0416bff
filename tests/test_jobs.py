"""Jobs that are killed after any stage, run again and given changed input; the outcome ledger."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import appraisals as A
from tallyforge.operators import jobs
from tallyforge.scratch import scratch_path


class Killed(Exception):
    pass


def _stages(ran, dies=None):
    """Three stages over (lot, n) that record the lots they run over."""

    def stage(name, work):
        def run(lots, rows):
            if dies == name:
                raise Killed
            ran.append((name, sorted(r.lot for r in lots.collect())))
            return work(lots, rows)

        return run

    return [
        ("one", stage("one", lambda lots, rows: lots.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("lot"))))), "lot string, n int"),
        ("two", stage("two", lambda lots, rows: rows("one").where("n > 1").withColumn("m", F.col("n") * 10)), "lot string, m int"),
        ("three", stage("three", lambda lots, rows: rows("two").groupBy("lot").agg(F.sum("m").alias("s"))), "lot string, s long"),
    ]


def _lots(spark, **digests):
    return spark.createDataFrame(sorted(digests.items()), "lot string, digest string")


@pytest.mark.parametrize("dies", ["one", "two", "three"])
def test_killed_after_any_stage_it_ends_the_same(spark, dies):
    folder, ran = scratch_path(spark, "job"), []
    lots = _lots(spark, a="1", bbb="1", cc="1")
    with pytest.raises(Killed):
        jobs.StagedJob(spark, folder, _stages(ran, dies)).run(lots)
    done = [name for name, _ in ran]
    got = {r.lot: r.s for r in jobs.StagedJob(spark, folder, _stages(ran)).run(lots).collect()}
    assert got == {"bbb": 50, "cc": 20}  # a has no row, and is settled all the same
    assert [name for name, _ in ran] == ["one", "two", "three"] and done == ["one", "two", "three"][: len(done)]
    assert {r.lot: r.s for r in jobs.StagedJob(spark, folder, _stages(ran)).run(lots).collect()} == got and len(ran) == 3


def test_rows_that_no_stage_has_finished_do_not_count(spark):
    """A stage that is killed between its rows and their list is done again, and its first rows are passed over."""
    folder, ran = scratch_path(spark, "job"), []
    job = jobs.StagedJob(spark, folder, _stages(ran))
    lots = _lots(spark, bbb="1")
    spark.createDataFrame([("bbb", 9, "1", "lost")], "lot string, n int, digest string, run string").write.parquet(f"{folder}/one/rows/lost")
    assert [tuple(r) for r in job.run(lots).collect()] == [("bbb", 50)]


def test_changed_and_new_lots_alone_run_again(spark):
    folder, ran = scratch_path(spark, "job"), []
    job = jobs.StagedJob(spark, folder, _stages(ran))
    job.run(_lots(spark, aa="1", bbb="1"))
    ran.clear()
    got = {r.lot: r.s for r in job.run(_lots(spark, aa="2", bbb="1", dddd="1")).collect()}
    assert got == {"aa": 20, "bbb": 50, "dddd": 90} and all(lots == ["aa", "dddd"] for _, lots in ran)
    assert {r.lot for r in job.run(_lots(spark, bbb="1")).collect()} == {"bbb"}


def test_digests_tell_lots_apart(spark):
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "lot string, n int")
    labels = spark.createDataFrame([("a", "x")], "lot string, t string")
    now = {r.lot: r.digest for r in jobs.digests(frames, labels).collect()}
    assert set(now) == {"a", "b"} and {r.lot: r.digest for r in jobs.digests(frames.repartition(3), labels).collect()} == now
    for other in ([("a", 1), ("a", 3), ("b", 1)], [("a", 1), ("a", 2), ("a", 2), ("b", 1)], [("a", 1), ("b", 1)]):
        changed = {r.lot: r.digest for r in jobs.digests(spark.createDataFrame(other, "lot string, n int"), labels).collect()}
        assert changed["a"] != now["a"] and changed["b"] == now["b"]


def test_batches_that_cannot_be_read_and_repeated_frames(spark):
    frames = spark.createDataFrame([("l", i, "same" if i in (2, 5) else None, 10) for i in range(1, 8)] + [("m", 1, None, 10)], "lot string, position int, fingerprint string, bytes long")
    labels = spark.createDataFrame([("l", 1, ["C1"], ["first"]), ("l", 4, ["C4"], [])], "lot string, position int, codes array<string>, wording array<string>")
    sent = {}

    def ask(batches):
        sent.update({(r.lot, r.batch): r.positions for r in batches.collect()})
        lines = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Lamp "), F.col("batch")).alias("itemName"), F.concat(F.lit("MODEL"), F.col("batch")).alias("modelNumber"), F.lit(2.0).alias("quantity"), F.array(F.lit(1.0), F.lit(4.0)).alias("views"))).alias("manifest")))
        return batches.select("lot", "batch", F.when((F.col("lot") == "m") | (F.col("batch") == 2), "no answer").otherwise(lines).alias("text"))

    def price(pieces):
        return pieces.select("lot", "piece", F.to_json(F.struct(F.transform("lines", lambda x: F.struct(x["name"].alias("itemName"), x["quantity"].cast("double").alias("quantity"), (x["line"] + 5).cast("double").alias("resaleValue"), F.array_join(x["identifiers"], ",").alias("notes"))).alias("items"))).alias("text"))

    job = jobs.manifest_scan(spark, scratch_path(spark, "scan"), frames, labels, ask, price, width=2, budget=100, piece=1)
    got = [tuple(r) for r in job.run(jobs.digests(frames, labels)).orderBy("lot", "place").collect()]
    assert sent == {("l", 0): [1, 2], ("l", 1): [3, 4], ("l", 2): [6, 7], ("m", 0): [1]}
    # a batch's lines take the codes of its own frames alone; pieces are sorted together
    assert [(lot, place, name, n, resale, notes) for lot, place, name, _, n, _, resale, notes in got] == [("l", 0, "Lamp 1", 2, 6.0, "C4"), ("l", 1, "Lamp 0", 2, 5.0, "C1")]




def _outcomes(spark, *rows):
    from decimal import Decimal

    full = [(lot, attempt, kind, f"m{attempt}", [(Decimal(r), Decimal(s)) for r, s in items] if items is not None else None, 3, 1) for lot, attempt, kind, items in rows]
    return spark.createDataFrame(full, A.OUTCOME)


def test_a_batch_counts_once_and_a_broken_one_not(spark):
    ledger = A.OutcomeLedger(spark, scratch_path(spark, "ledger"))
    assert ledger.outcomes().count() == 0
    first = _outcomes(spark, (1, 1, "valued", [(10, 4)]))
    assert ledger.commit("x", first) and not ledger.commit("x", first.unionByName(first))
    first.write.parquet(f"{ledger.folder}/batch=y")
    ledger._fs.delete(ledger._path(f"{ledger.folder}/batch=y/_SUCCESS"), False)
    assert ledger.outcomes().count() == 1
    assert ledger.commit("y", _outcomes(spark, (1, 2, "failed", None))) and ledger.outcomes().count() == 2


def test_newest_outcome_and_figures(spark):
    rows = [
        (1, 1, "started", None), (1, 2, "valued", [(10, 4), (5, 1)]), (1, 3, "failed", None),  # figures stay
        (2, 1, "valued", [(7, 7)]), (2, 2, "stopped", None),  # a stop drops them
        (3, 1, "stopped", None), (3, 2, "valued", [(1, 1)]), (3, 2, "valued", [(1, 1)]),  # repeated
        (4, 1, "skipped", None), (5, 1, "valued", []), (6, 9, "started", None),
    ]
    outcomes = _outcomes(spark, *rows)
    lots = spark.createDataFrame([(i, 50.0, 90.0, "t") for i in range(1, 8)], "lot_id long, pre_resale double, pre_retail double, title string")
    got = {r.lot_id: r for r in A.applied(lots, outcomes).collect()}
    assert {i: (r.state, r.detail, r.retail, r.resale, r.item_count, r.pre_resale) for i, r in got.items()} == {
        1: ("failed", "m3", 15.0, 5.0, 2, None), 2: ("pending", "", 0.0, 0.0, 0, None), 3: ("completed", "", 1.0, 1.0, 1, None),
        4: ("skipped", "m1", 0.0, 0.0, 0, 50.0), 5: ("completed", "", 0.0, 0.0, 0, None), 6: ("analyzing", "", 0.0, 0.0, 0, 50.0), 7: ("pending", "", 0.0, 0.0, 0, 50.0),
    }
    again = A.applied(lots, outcomes.unionByName(outcomes).repartition(5))
    assert {r.lot_id: r for r in again.collect()} == got
    assert tuple(again.agg(*A.counts()).first()) == (7, 2, 1, 2, 1, 1, 4, 4)
