"""State of rows and jobs: repeated views in words, batches and what they answer for, the text pass, price events, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import notes as N

#: Frames that the label reader looks at, and identifiers that end its text pass.
READ_IMAGES, ENOUGH_IDENTIFIERS = 12, 4


def view_claims(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """(lot, owner, phrase, notes) for each frame of groups (lot, position, owner, reason) that others were folded into.

    One clause and one note a reason, in the order in which reasons come up; codes (lot, position, codes) are those of the
    owner, in order, none where it has no row. What one owner gathers is the gallery of one lot.
    """
    folds = groups.where("reason is not null").groupBy("lot", "owner", "reason").agg(F.min("position").alias("first"), F.sort_array(F.collect_list("position")).alias("frames"))
    there = codes.select(F.col("lot").alias("c_lot"), F.col("position").alias("c_position"), F.array_sort("codes").alias("codes"))
    known = folds.join(there, F.col("lot").eqNullSafe(F.col("c_lot")) & (F.col("owner") == F.col("c_position")), "left")
    parts = [F.col("frames"), F.col("reason"), F.col("owner"), F.coalesce("codes", F.expr("cast(array() as array<string>)"))]
    said = F.sort_array(F.collect_list(F.struct("first", N.view_phrase(*parts).alias("phrase"), N.prompt_note(*parts).alias("note"))))
    views = known.groupBy("lot", "owner").agg(said.alias("s"))
    return views.select("lot", "owner", F.array_join(F.transform("s", lambda x: x["phrase"]), "; ").alias("phrase"), F.transform("s", lambda x: x["note"]).alias("notes"))


def grouped_views(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """(lot, said): how many frames of a lot were read once, with all of view_claims in order of owner; lots without folds give none."""
    counts = groups.where("reason is not null").groupBy(F.col("lot").alias("n_lot")).agg(F.count(F.lit(1)).alias("n"))
    all_of = claims.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("owner", "phrase"))).alias("s"))
    said = F.concat(F.col("n").cast("string"), F.lit(" frame(s) read once: "), F.array_join(F.transform("s", lambda x: x["phrase"]), "; "))
    return all_of.join(counts, F.col("lot").eqNullSafe(F.col("n_lot"))).select("lot", said.alias("said"))


def batch_answers(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """(lot, batch, positions, answered) of placed (lot, batch, position): the frames of a batch and how many it answers for, itself and those that grouped_frames folded into it."""
    stands = groups.groupBy(F.col("lot").alias("s_lot"), F.col("owner").alias("s_position")).agg(F.count(F.lit(1)).alias("stands"))
    joined = placed.join(stands, F.col("lot").eqNullSafe(F.col("s_lot")) & (F.col("position") == F.col("s_position")), "left")
    return joined.groupBy("lot", "batch").agg(F.sort_array(F.collect_list("position")).alias("positions"), F.sum(F.coalesce("stands", F.lit(1))).alias("answered"))


def text_pass(frames: DataFrame, images: int = READ_IMAGES, enough: int = ENOUGH_IDENTIFIERS) -> DataFrame:
    """frames (lot, position, found: identifiers that its text shows) that are looked at, with text_read: whether its text is, too.

    The first so many positions are looked at; text is read until frames before have shown enough identifiers. What an
    unread frame would show does not count, which changes nothing as the sum has reached enough by then.
    """
    before = F.sum(F.coalesce("found", F.lit(0))).over(Window.partitionBy("lot").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return frames.where(F.col("position") <= images).select("lot", "position", (F.coalesce(before, F.lit(0)) < enough).alias("text_read"))


def priced_state(events: DataFrame) -> DataFrame:
    """(lot, retail, resale, confidence, pricing) after events (lot, seq, kind, retail, resale, confidence).

    Kinds: `apply` sets the estimate, `clear` and `reset` drop it (0, 0, Low), `start` and `stop` touch the flag of a
    request under way alone, which all but `start` put down; other kinds do nothing. Equal seq: the kind later in order.
    """
    known = events.where(F.col("kind").isin("apply", "clear", "reset", "start", "stop"))
    order = F.struct("seq", "kind")
    state = F.when(F.col("kind") == "apply", F.struct(F.col("retail"), F.col("resale"), F.col("confidence"))).when(F.col("kind").isin("clear", "reset"), F.struct(F.lit(0.0).alias("retail"), F.lit(0.0).alias("resale"), F.lit("Low").alias("confidence")))
    last = known.groupBy("lot").agg(F.max_by(state, F.when(state.isNotNull(), order)).alias("s"), F.max_by("kind", order).alias("last"))
    return last.select("lot", F.coalesce("s.retail", F.lit(0.0)).alias("retail"), F.coalesce("s.resale", F.lit(0.0)).alias("resale"), F.coalesce("s.confidence", F.lit("Low")).alias("confidence"), (F.col("last") == "start").alias("pricing"))


def gates(lots: DataFrame, boards: DataFrame) -> DataFrame:
    """What may be started on each of boards (board, configured, exclusive, scanning) with lots (board, valued, estimated, checked).

    One row can be priced when pricing is configured and no exclusive job runs; batches also wait for single rows and need
    a lot that they would act on. A board without lots can run no batch.
    """
    lacking = ~F.coalesce(F.col("valued"), F.lit(False))
    fresh = lacking & ~F.coalesce(F.col("estimated"), F.lit(False))
    checked = F.coalesce(F.col("checked"), F.lit(False))
    some = lots.groupBy(F.col("board").alias("l_board")).agg(*(F.bool_or(c).alias(n) for n, c in {"any_price": lacking, "any_eval": fresh, "any_price_checked": checked, "any_eval_checked": checked & lacking}.items()))
    row = F.coalesce(F.col("configured") & ~F.col("exclusive"), F.lit(False))
    batch = row & ~F.coalesce(F.col("scanning"), F.lit(True))
    may = {"price_all": "any_price", "eval_all": "any_eval", "price_selected": "any_price_checked", "eval_selected": "any_eval_checked"}
    joined = boards.join(some, F.col("board").eqNullSafe(F.col("l_board")), "left")
    return joined.select("board", row.alias("price_row"), *((batch & F.coalesce(F.col(c), F.lit(False))).alias(n) for n, c in may.items()))
