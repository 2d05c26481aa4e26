"""Staged inputs as a stateful stream: put once, take once, gone after a while.

:func:`stored` keeps whole stores, with their caps on entries and bytes: what a put comes to
depends on what came before it, so events wait until the watermark has passed them and are
then read in their order. :func:`staged` keeps single ids, as they come.

Events of :func:`staged` are (id, kind, at, bytes): kind ``put`` or ``take``, at in seconds of the log's own
clock. State is keyed by id, so staging scales with the number of ids; each id's state is one
row. Expiry is decided by the events' times (strictly later than the limit), and the state's
own time-to-live only removes what nobody asks for any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsift.operators.staging import GONE, LOCKOUT_SECONDS, MAX_BYTES, MAX_ENTRIES, MAX_TOTAL_BYTES, TTL_STAGED, Store
from docsift.scratch import new_path

OUT = "id string, kind string, at long, outcome string"


class Staging(StatefulProcessor):
    """One input: staged, taken, or told that it is gone."""

    def __init__(self, ttl: int = TTL_STAGED, keep_ms: int = 24 * 3600 * 1000) -> None:
        self.ttl, self.keep_ms = ttl, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.put_at = handle.getValueState("put_at", "at long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "kind"])
        out = []
        for kind, at, size in zip(events["kind"], events["at"], events["bytes"], strict=True):
            held = self.put_at.get()[0] if self.put_at.exists() else None
            if held is not None and at - held > self.ttl:
                self.put_at.clear()
                held = None
            if kind == "put":
                size = 0 if pd.isna(size) else int(size)
                if size == 0 or size > MAX_BYTES:
                    outcome = "empty" if size == 0 else "too large"
                elif held is not None:
                    outcome = "id in use"
                else:
                    self.put_at.update((int(at),))
                    outcome = "staged"
            elif held is None:
                outcome = GONE
            else:
                self.put_at.clear()
                outcome = "taken"
            out.append((key[0], kind, int(at), outcome))
        yield pd.DataFrame(out, columns=["id", "kind", "at", "outcome"])

    def close(self) -> None:
        pass


def staged(events: DataFrame, ttl: int = TTL_STAGED) -> DataFrame:
    """Outcome of each event of a stream; needs the RocksDB state store.

    A run that should end (trigger availableNow) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled=false``, as batches without data
    otherwise go on for the sake of the time-to-live.
    """
    return events.groupBy("id").transformWithStateInPandas(Staging(ttl), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def ended(rows: DataFrame, tag: str) -> DataFrame:
    """All that a stream over what there is now gives, as a table in the shared folder.

    Its state goes to RocksDB, and its checkpoint below the shared folder, so that a lost executor
    costs a batch. Batches without data run, so that timers see the last watermark.
    """
    spark = rows.sparkSession
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    path = new_path(spark, tag)
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        run = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, f"{tag}-checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(rows.schema).parquet(path)


STORED = "store string, event_id long, kind string, id string, at long, error string"
#: State of a store: events that wait, entries that it holds, and when its timer stands.
_STATE = "waiting array<struct<at:long,turn:int,event_id:long,id:string,bytes:long>>, held array<struct<at:long,bytes:long,id:string>>, wake long"
_ANSWER = Row("store", "event_id", "kind", "id", "at", "error")


class StoreProcessor(StatefulProcessor):
    """One store: events that wait for the watermark, and the entries that it holds.

    One timer stands at the first second that waits, or at which an entry expires. Seconds are
    read whole, takes before puts, then by event number, as in the batch form. All of a store's
    state is one value, read and written once for what a batch has of it, as each call costs
    more than what is done with the answer.
    """

    def __init__(self, ttl: int, max_bytes: int, max_entries: int, max_total: int) -> None:
        self.limits = ttl, max_bytes, max_entries, max_total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("store", _STATE)

    def _keep(self, waiting: list, held: list, wake: int | None) -> None:
        """Writes the state and sets its timer, in place of one at ``wake``."""
        if not waiting and not held:
            self.state.clear()
            return
        first = min([x[0] for x in waiting] + [x[0] + self.limits[0] for x in held[:1]])
        at = (first + 1) * 1000
        if at != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at)
        self.state.update((waiting, held, at))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], int(r["kind"] == "put"), r["event_id"], r["id"], r["bytes"]) for r in rows if r["kind"] in ("put", "take")]
        if new:
            waiting, held, wake = self.state.get() or ([], [], None)
            self._keep([*map(tuple, waiting), *new], [*map(tuple, held)], wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, held, _ = self.state.get() or ([], [], None)
        due, later = [], []
        for x in map(tuple, waiting):
            (due if (x[0] + 1) * 1000 <= now else later).append(x)
        store = Store(*self.limits, held=[*map(tuple, held)])
        out = []
        for at, turn, event_id, ident, size in sorted(due):
            error = store.put(at, size, ident) if turn else store.take(at, ident)
            out.append(_ANSWER(key[0], event_id, "put" if turn else "take", ident, at, error))
        self._keep(later, [x for x in store.held if (x[0] + self.limits[0] + 1) * 1000 > now], None)
        return iter(out)

    def close(self) -> None:
        pass


def stored(
    events: DataFrame, late: str = "10 minutes", ttl: int = TTL_STAGED, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL_BYTES
) -> DataFrame:
    """(store, event_id, kind, id, at, error) of a stream (store, event_id, ts, kind, id, bytes).

    Kinds are ``put`` and ``take``; any other kind, such as a tick that moves the clock on, is
    passed over. Events that come up to ``late`` after later ones are read in their place; those
    that come later still are dropped, as the answers after them are out, and so are those
    without a time. A null number or size counts as 0. Needs the RocksDB state store.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    rows = events.filter("ts IS NOT NULL").withWatermark("ts", late).select("store", number("event_id"), "ts", F.unix_seconds("ts").alias("at"), "kind", "id", number("bytes"))
    processor = StoreProcessor(ttl, max_bytes, max_entries, max_total)
    return rows.groupBy("store").transformWithState(processor, outputStructType=STORED, outputMode="Append", timeMode="EventTime")


def failures_per_span(events: DataFrame, seconds: int = LOCKOUT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, window, n): failed sign-ins (key, ts) in sliding spans, with late events allowed for."""
    spans = F.window("ts", f"{seconds} seconds", f"{max(1, seconds // 5)} seconds")
    return events.withWatermark("ts", late).groupBy("key", spans).agg(F.count(F.lit(1)).alias("n"))
