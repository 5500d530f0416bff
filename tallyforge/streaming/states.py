"""Scan and scraper events projected onto the state of rows and boards, as they stream in.

An event may come late or twice, and a stop takes a row back to where it began, so a state cannot be the newest event
alone. For each key the stream keeps the state that is settled (no event before the watermark can still come) and the
events after it, by their number; each batch replays those in order of time and number, so that the state told is that of
all events seen so far, in whatever order they came. When the watermark passes an event (a timer tells, also for a key that
gets no more events) it is folded into the settled state and forgotten: what is kept follows the lateness allowed and not
the length of the run. Events later than the watermark are left out, as Spark does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Seen = Callable[[str], bool]


def _names(schema: str) -> list[str]:
    """The columns of a plain schema in words."""
    return [c.split()[0] for c in schema.split(", ")]


class Projection:
    """How events change a state. Both are tuples by the names of their schemas."""

    event: str
    state: str
    start: tuple

    @staticmethod
    def after(state: Row, event: Row, first: Seen) -> dict:
        """What an event changes of a state; first tells (once) whether a name is new to the key."""
        raise NotImplementedError


class RowStates(Projection):
    """A lot's row: pending, analyzing, completed, failed or skipped, its figures and its estimate from text alone.

    A valuation takes the place of an estimate; a stop leaves no partial answer: the row is pending again, without figures.
    """

    event = "kind string, retail double, resale double, message string"
    state = "state string, detail string, retail double, resale double, pre_retail double, pre_resale double, pre_pricing boolean"
    start = ("pending", "", 0.0, 0.0, 0.0, 0.0, False)

    @staticmethod
    def after(state: Row, event: Row, first: Seen) -> dict:
        none = {"pre_retail": 0.0, "pre_resale": 0.0, "pre_pricing": False}
        changes = {
            "analyzing": {"state": "analyzing", "detail": ""},
            "valued": {"state": "completed", "detail": "", "retail": event["retail"] or 0.0, "resale": event["resale"] or 0.0, **none},
            "failed": {"state": "failed", "detail": event["message"] or ""},
            "skipped": {"state": "skipped", "detail": event["message"] or ""},
            "stopped": {"state": "pending", "detail": "", "retail": 0.0, "resale": 0.0, **none},
            "estimating": {"pre_pricing": True},
            "estimated": {"pre_retail": event["retail"] or 0.0, "pre_resale": event["resale"] or 0.0, "pre_pricing": False},
            "not estimated": {"pre_pricing": False},
        }
        return changes.get(event["kind"], {})


class BoardStates(Projection):
    """A walk's board: its status line, the pages it may read and has read, the rows of the page at hand, distinct lots."""

    event = "kind string, page int, at int, of int, lot string, message string"
    state = "status string, page_limit int, rows_landed int, rows_on_page int, pages_extracted int, listing_pages int, lots long"
    start = ("", 0, 0, 0, 0, None, 0)

    @staticmethod
    def after(state: Row, event: Row, first: Seen) -> dict:
        kind, page, of = event["kind"], event["page"], event["of"]
        if kind == "status":
            return {"status": event["message"]}
        if kind == "page started":
            return {"page_limit": of, "rows_landed": 0, "rows_on_page": 0, "status": f"Scanning page {page} of {min(of, state['listing_pages'] or of)}"}
        if kind == "lot":
            moved = {"rows_landed": event["at"], "rows_on_page": of}
            if event["lot"] is None or not first(event["lot"]):
                return moved
            lots = state["lots"] + 1
            return {**moved, "lots": lots, "status": f"Page {page} — card {event['at']} of {of} on it, {lots} lot(s) on the board" if of > 1 else f"Page {page} — {lots} lot(s) on the board"}
        if kind == "page read":
            return {"pages_extracted": max(state["pages_extracted"], page), "rows_landed": 0, "rows_on_page": 0, "status": f"Page {page} — {state['lots']} lot(s) on the board"}
        if kind == "pages known":
            return {"listing_pages": of}
        if kind == "walk ended":
            return {"status": f"Scraping done — {event['message']}"}
        return {}


def _replayed(projection: type[Projection], state: tuple, events: list[dict], first: Seen) -> tuple:
    names = _names(projection.state)
    for event in events:
        now = dict(zip(names, state, strict=True))
        state = tuple((now | projection.after(now, event, first)).values())
    return state


def _in_order(events: list[dict]) -> list[dict]:
    return sorted(events, key=lambda e: (e["ts"], e["seq"]))


class Replay(StatefulProcessor):
    """Keeps the settled state, the events since, and the names seen, of each key."""

    def __init__(self, projection: type[Projection], key: str):
        self.projection, self.told = projection, [key, *_names(projection.state)]
        self.names = ["seq", "ts", *_names(projection.event)]

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.projection.state)
        self.waiting = handle.getListState("waiting", f"seq long, ts long, {self.projection.event}")  # ts in microseconds
        self.seen = handle.getMapState("seen", "name string", "seq long")

    def _first(self, new: set[str], known: dict[str, bool]) -> Seen:
        """Whether a name is new to the key; the state is asked once for each name, and new has those that it lacks."""

        def first(name: str) -> bool:
            if name not in known:
                known[name] = self.seen.containsKey((name,))
            if known[name] or name in new:
                return False
            new.add(name)
            return True

        return first

    def _settle(self, watermark: int, rows: list[tuple], known: dict[str, bool]) -> tuple[tuple, list[dict]]:
        """Takes rows in and folds what the watermark has passed; the state then, and the events that are still to be held.

        Waiting events are read and written as one list, as every call on a state costs a message between processes.
        """
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        last = {e[0]: e for e in (*held, *rows)}  # of a repeated number the last stays
        events = _in_order([dict(zip(self.names, e, strict=True)) for e in last.values()])
        state = tuple(self.settled.get()) if self.settled.exists() else self.projection.start
        done = [e for e in events if e["ts"] <= watermark * 1000]
        left = events[len(done) :]
        if done:
            new: set[str] = set()
            state = _replayed(self.projection, state, done, self._first(new, known))
            self.settled.update(state)
            for name in new:
                self.seen.updateValue((name,), (0,))
                known[name] = True
        if left and (rows or done):
            self.waiting.put([tuple(e[n] for n in self.names) for e in left])
        elif held and not left:
            self.waiting.clear()
        return state, left

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known: dict[str, bool] = {}
        state, events = self._settle(timerValues.getCurrentWatermarkInMs(), [(r["seq"], round(r["ts"].timestamp() * 1_000_000), *(r[n] for n in self.names[2:])) for r in rows], known)
        if events:
            self.handle.registerTimer(events[-1]["ts"] // 1000 + 1)
        yield Row(**dict(zip(self.told, (*key, *_replayed(self.projection, state, events, self._first(set(), known))), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._settle(timerValues.getCurrentWatermarkInMs(), [], {})
        return iter(())

    def close(self) -> None:
        pass


def projected(events: DataFrame, projection: type[Projection], key: str, late: str = "1 hour") -> DataFrame:
    """A stream of (key, state) from a stream of events (key, seq, ts, what the projection reads): the new state of every key with new events. Repeated numbers of a key are one event."""
    fields = _names(projection.event)
    rows = events.where(F.col("seq").isNotNull() & F.col("ts").isNotNull()).select(key, F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), *fields).withWatermark("ts", late)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithState(Replay(projection, key), f"`{key}` {kind}, {projection.state}", "Update", "EventTime")


def latest(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """The last state of each key after all that is there now; folder keeps the checkpoint and what each batch said, so that a later call goes on."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/told/batch={number}")  # a batch that is repeated replaces itself

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/told")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    told = spark.read.schema(schema.add("batch", T.LongType())).option("basePath", f"{folder}/told").parquet(f"{folder}/told")
    names = [f.name for f in schema if f.name not in (key, "batch")]
    return told.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(key, "s.*")


def replayed(events: DataFrame, projection: type[Projection], key: str) -> DataFrame:
    """The state of each key after a table of events, sorted and read once: what `latest` gives for the same events in any order."""
    fields = _names(projection.event)
    kind = events.schema[key].dataType.simpleString()
    # of repeated numbers the last in no particular order stays, as in the stream
    once = events.where("seq is not null and ts is not null").groupBy(key, "seq").agg(F.first(F.struct("ts", *fields)).alias("e")).select(key, "seq", "e.*")
    in_order = once.repartition(key).sortWithinPartitions(key, "ts", "seq")
    names = _names(projection.state)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        now, state, new, out = None, None, set(), []
        started = False

        def first(name: str) -> bool:
            fresh = name not in new
            new.add(name)
            return fresh

        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if not started or row[key] != now:
                    if started:
                        out.append((now, *state))
                    started, now, state = True, row[key], projection.start
                    new.clear()
                state = _replayed(projection, state, [row], first)
            if out:
                yield pd.DataFrame(out, columns=[key, *names])
                out = []
        if started:
            yield pd.DataFrame([(now, *state)], columns=[key, *names])

    return in_order.mapInPandas(run, f"`{key}` {kind}, {projection.state}")


def in_words(table: DataFrame, key: str) -> DataFrame:
    """Events of the driver's table as row events: what happened to a row, by type."""
    kind = (
        F.when(F.col("event_id") % 13 == 0, "stopped").when(F.col("event_type") == "view", "analyzing").when(F.col("event_type") == "purchase", "valued")
        .when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "failed").otherwise("skipped")).when(F.col("event_type") == "click", F.when(F.col("event_id") % 3 == 0, "estimating").otherwise("estimated")).otherwise("not estimated")
    )
    return table.select(F.col(key), F.col("event_id").cast("long").alias("seq"), "ts", kind.alias("kind"), F.col("value").alias("retail"), (F.col("value") / 2).alias("resale"), F.concat(F.lit("why "), F.col("event_id") % 5).alias("message"))


def as_walk(table: DataFrame, key: str) -> DataFrame:
    """Events of the driver's table as scraper events of walks."""
    n = F.col("event_id").cast("int")
    kind = F.when(n % 29 == 0, "walk ended").when(F.col("event_type") == "signup", "page started").when(F.col("event_type") == "purchase", "page read").when(F.col("event_type") == "error", F.when(n % 2 == 0, "status").otherwise("pages known")).otherwise("lot")
    return table.select(F.col(key), n.cast("long").alias("seq"), "ts", kind.alias("kind"), (n % 9 + 1).alias("page"), (n % 4 + 1).alias("at"), (n % 6 + 1).alias("of"), F.concat(F.lit("lot "), n % 37).alias("lot"), F.concat(F.lit("said "), n % 3).alias("message"))


