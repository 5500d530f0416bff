"""States of rows and jobs on small tables: nulls, ties, repeats, empty tables."""

from tallyforge.operators import progress as R
from tallyforge.operators import scans as C

EVENTS = "lot long, seq long, kind string, retail double, resale double, confidence string"
GROUPS = "lot long, position int, owner int, reason string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_price_state_follows_the_last_event(spark):
    events = [
        (1, 1, "apply", 10.0, 5.0, "High"), (1, 2, "start", None, None, None),
        (2, 1, "apply", 10.0, 5.0, "High"), (2, 2, "clear", None, None, None), (2, 3, "unknown", None, None, None),
        (3, 1, "start", None, None, None), (3, 2, "stop", None, None, None),
        (4, 1, "apply", 1.0, 1.0, "Low"), (4, 2, "start", None, None, None), (4, 3, "apply", 2.0, None, "Med"),
        (None, 1, "start", None, None, None), (5, 1, "unknown", 9.0, 9.0, "High"),
    ]
    got = rows(R.priced_state(spark.createDataFrame(events, EVENTS)))
    assert got == sorted([(1, 10.0, 5.0, "High", True), (2, 0.0, 0.0, "Low", False), (3, 0.0, 0.0, "Low", False), (4, 2.0, 0.0, "Med", False), (None, 0.0, 0.0, "Low", True)], key=str)
    assert rows(R.priced_state(spark.createDataFrame([], EVENTS))) == []


def test_gates_wait_for_exclusive_work_and_for_lots(spark):
    lots = spark.createDataFrame([(1, True, True, True), (1, None, True, None), (2, True, False, True), (3, False, False, True)], "board long, valued boolean, estimated boolean, checked boolean")
    boards = spark.createDataFrame([(1, True, False, False), (2, True, False, False), (3, True, False, True), (4, True, False, False), (5, None, False, False)], "board long, configured boolean, exclusive boolean, scanning boolean")
    got = rows(R.gates(lots, boards).select("board", "price_row", "price_all", "eval_all", "price_selected", "eval_selected"))
    assert got == [
        (1, True, True, False, True, False),  # the unvalued lot has an estimate; the checked one a value
        (2, True, False, False, True, False),
        (3, True, False, False, False, False),  # a single row is being priced
        (4, True, False, False, False, False),  # no lots
        (5, False, False, False, False, False),
    ]


def test_text_pass_ends_after_enough_identifiers(spark):
    frames = [(1, 1, 3), (1, 2, None), (1, 3, 1), (1, 4, 0), (1, 13, 0), (None, 1, 0)]
    got = rows(R.text_pass(spark.createDataFrame(frames, "lot long, position int, found int")))
    assert got == sorted([(1, 1, True), (1, 2, True), (1, 3, True), (1, 4, False), (None, 1, True)], key=str)


def test_claims_keep_reasons_apart(spark):
    groups = spark.createDataFrame([(1, 1, 1, None), (1, 2, 1, "same barcode"), (1, 3, 1, "same picture"), (1, 5, 1, "same barcode"), (1, 4, 4, None), (2, 1, 1, None)], GROUPS)
    codes = spark.createDataFrame([(1, 1, ["b", "a"])], "lot long, position int, codes array<string>")
    claims = R.view_claims(groups, codes)
    phrase = "photograph(s) 2, 5 carry the same decoded barcode as photograph 1 (a, b); photograph(s) 3 are the same picture as photograph 1"
    [(lot, owner, said, notes)] = rows(claims)
    assert (lot, owner, said, len(notes)) == (1, 1, phrase, 2)
    assert rows(R.grouped_views(groups, claims)) == [(1, "3 frame(s) read once: " + phrase)]
    assert rows(R.view_claims(groups.limit(0), codes)) == []


def test_a_batch_answers_for_the_frames_folded_into_it(spark):
    frames = spark.createDataFrame([(1, 1, "p", []), (1, 2, "q", []), (1, 3, "p", None), (1, 4, None, None)], "lot long, position int, fingerprint string, codes array<string>")
    placed = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 4), (2, 0, 9)], "lot long, batch int, position int")
    assert rows(R.batch_answers(placed, C.grouped_frames(frames))) == [(1, 0, [1, 2], 3), (1, 1, [4], 1), (2, 0, [9], 1)]
