"""Events on streams of scored windows: runs of positive windows, for late and unordered input, with state that survives
restarts (an extension: the results of `operators.windows.islands` for what the watermark has passed).

Each recording keeps the windows that may still be overtaken, in a map by start, the last window that has been passed,
and the run that is open. A timer for each window fires when the watermark reaches its start: what is behind the
watermark is then taken in order. A run is given out when a window breaks it, or when the watermark has passed the place
where the next window would begin. Windows later than the watermark are dropped, as everywhere on streams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that keyed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Runs(StatefulProcessor):
    def __init__(self, by: list[str], tolerance: float):
        self.by, self.tolerance = by, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start double, end double", "prediction int")
        self.last = handle.getValueState("last", "end double, prediction int")
        self.run = handle.getValueState("run", "start double, end double, windows long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        for row in rows:
            if row.start >= passed:
                self.waiting.updateValue((row.start, row.end), (row.prediction or 0,))
                self.handle.registerTimer(math.ceil(row.start * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000  # timers of one batch may fire in any order
        due = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] < passed)
        for start, end, prediction in due:
            self.waiting.removeKey((start, end))
            before = self.last.get()
            meets = before is not None and before[1] == 1 and abs(start - before[0]) <= self.tolerance
            run = self.run.get()
            if prediction == 1 and meets and run is not None:
                self.run.update((run[0], max(run[1], end), run[2] + 1))
            else:
                yield from self._given(key)
                if prediction == 1:
                    self.run.update((start, end, 1))
            self.last.update((end, prediction))
            if prediction == 1:
                self.handle.registerTimer(math.ceil((end + self.tolerance) * 1000) + 2)
        before = self.last.get()
        if before is not None and before[0] + self.tolerance < passed:
            yield from self._given(key)

    def _given(self, key: tuple) -> Iterator[Row]:
        run = self.run.get()
        if run is not None:
            self.run.clear()
            yield Row(**dict(zip(self.by, key, strict=True)), start=run[0], end=run[1], windows=run[2])

    def close(self) -> None:
        pass


def events(scored: DataFrame, by: list[str], start: str, end: str, late: str = "10 minutes", tolerance: float = 0.001) -> DataFrame:
    """by.., start and end (seconds since 1970) and windows of each run of positive windows, for a stream of windows with
    timestamps `start` and `end` and an int `prediction`. The session must use STATE_STORE."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    rows = scored.select(*by, F.col(start).cast("timestamp").alias("_t"), seconds(start).alias("start"), seconds(end).alias("end"), F.col("prediction").cast("int").alias("prediction")).withWatermark("_t", late)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "start double, end double, windows long"])
    return rows.groupBy(*by).transformWithState(Runs(by, tolerance), schema, "Append", "EventTime")
