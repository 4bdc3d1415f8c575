"""Stop lists edited live: the fold of operators.itinerary over an unbounded stream of commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from atrium import params
from atrium.operators.itinerary import FRESH, after_gap, edit

ITINERARY = "user_id long, edits long, stops array<long>, choice int"
#: Spark setting that transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Itineraries(StatefulProcessor):
    """One visitor's list as keyed state: stops, chosen slot, whether it is shown, saved origin and time of the last command.

    Commands wait in a list until the watermark has passed them, so those that come out of order are
    applied in order; a timer wakes the visitor up for the first that waits. Another timer clears the
    list of one who has left; the saved origin stays.
    """

    def __init__(self, idle_s: float):
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("itinerary", "stops array<long>, choice int, shown boolean, saved long, edits long, last_us long")
        self.waiting = handle.getListState("waiting", "at_us long, event_id long, kind string, value long, door long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            columns = [frame[c].tolist() for c in ("at_us", "event_id", "kind", "value", "door")]
            self.waiting.appendList([tuple(None if not isinstance(x, str) and pd.isna(x) else x if isinstance(x, str) else int(x) for x in row) for row in zip(*columns)])
        yield from self.settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, timerValues)

    def settle(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Applies what the watermark has passed and sets the next timer."""
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        ripe = [r for r in rows if r[0] < now * 1000]
        rest = rows[len(ripe) :]
        if self.state.exists():
            stops, choice, shown, saved, edits, last = self.state.get()
            state = {"stops": tuple(stops), "choice": choice, "shown": shown, "saved": saved}
        else:
            state, edits, last = FRESH, 0, None
        for at, _, kind, value, door in ripe:
            state = edit(after_gap(state) if last is not None and at - last > self.idle_ms * 1000 else state, kind, value, door)
            edits, last = edits + 1, at
        if ripe:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield pd.DataFrame([(key[0], edits, list(state["stops"]), state["choice"])], columns=["user_id", "edits", "stops", "choice"])
        elif last is not None and not rest and now * 1000 > last + self.idle_ms * 1000:
            state = after_gap(state)
        if last is not None:
            self.state.update((list(state["stops"]), state["choice"], state["shown"], state["saved"], edits, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = rest[0][0] // 1000 + 1 if rest else int(last / 1000 + self.idle_ms) + 1 if last is not None else None
        if wake is not None and (rest or wake > now):
            self.handle.registerTimer(max(wake, now + 1))

    def close(self) -> None:
        pass


def live_itineraries(commands: DataFrame, late: str = "10 seconds", idle_s: float = params.IDLE_S) -> DataFrame:
    """(user_id, edits, stops, choice) of a stream of commands (itinerary.COMMANDS): a row whenever a user's list changes.

    Commands that come within ``late`` of later ones still take their place in order of (ts, event_id). The last
    row of each user is what itinerary.replay gives for the same commands. Rows of null user_id are left
    out. Needs the setting STATE_STORE and a shared checkpoint folder; recovers from both.
    """
    at = F.col("ts").cast("timestamp")
    rows = commands.where("user_id is not null").withColumn("ts", at).withWatermark("ts", late)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("at_us"), "event_id", "kind", F.col("value").cast("long").alias("value"), F.col("door").cast("long").alias("door"))
    return rows.groupBy("user_id").transformWithStateInPandas(Itineraries(idle_s), ITINERARY, "Update", "EventTime")
