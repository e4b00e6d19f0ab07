"""State that ends: latest readings and fill levels of nodes that still send.

Both run on event time. A node's state is kept until the watermark has passed its
newest reading by `idle`; then a timer closes the node, says so in a row, and clears the
state, so state grows with the nodes that send and not with all that ever did. Rows that
are older than the watermark when they come are dropped by Spark before they are seen;
a row that is late but not that late is taken, and never displaces a newer one. A node that
comes back in the very batch that would close it goes on as if it had not been silent.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LATEST = "node_id long, timestamp timestamp, reading_id long, waste_level double, gas_level double, live boolean"
FILL = "node_id long, fill double, emptied long, live boolean"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype("datetime64[us]").astype(np.int64)


def _time(us: int) -> datetime.datetime:
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)


class _Ending(StatefulProcessor):
    """Keeps one timer for each key: `idle` after its newest row."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def keep(self, newest_us: int) -> None:
        end = newest_us // 1000 + self.idle_ms
        for old in list(self.handle.listTimers()):
            if old != end:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(end)

    def close(self) -> None:
        pass


class LatestState(_Ending):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "us long, reading_id long, waste_level double, gas_level double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = best = tuple(self.latest.get()) if self.latest.exists() else None
        for pdf in rows:
            us, ids = _micros(pdf["timestamp"]), pdf["reading_id"].to_numpy()
            k = np.lexsort((ids, us))[-1]
            if best is None or (us[k], ids[k]) > best[:2]:
                best = (int(us[k]), int(ids[k]), float(pdf["waste_level"].iloc[k]), float(pdf["gas_level"].iloc[k]))
        if best != old:
            self.latest.update(best)
            self.keep(best[0])
            yield self._row(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get())
        self.latest.clear()
        yield self._row(key, best, False)

    @staticmethod
    def _row(key, best, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"node_id": [key[0]], "timestamp": [pd.Timestamp(best[0], unit="us")], "reading_id": [best[1]], "waste_level": [best[2]], "gas_level": [best[3]], "live": [live]})


def filled(more: np.ndarray, fill: float, emptied: int, full: float) -> tuple[float, int]:
    """Fill and number of emptyings after more has come in; at `full` a node is emptied. Steps from one emptying to the next."""
    at = 0
    while at < len(more):
        level = fill + np.cumsum(more[at:])
        over = np.flatnonzero(level >= full)
        if not len(over):
            return float(level[-1]), emptied
        at, fill, emptied = at + int(over[0]) + 1, 0.0, emptied + 1
    return fill, emptied


class FillState(_Ending):
    """Rows of one batch are taken in order of time and id; those of a later batch come after them."""

    def __init__(self, idle_ms: int, full: float):
        super().__init__(idle_ms)
        self.full = full

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("fill", "fill double, emptied long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fill, emptied, newest = tuple(self.now.get()) if self.now.exists() else (0.0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values(["timestamp", "reading_id"])  # one node's rows of one batch
        fill, emptied = filled(pdf["waste_level"].fillna(0.0).to_numpy(float), fill, emptied, self.full)
        newest = max(newest, int(_micros(pdf["timestamp"])[-1]))
        self.now.update((fill, emptied, newest))
        self.keep(newest)
        yield pd.DataFrame({"node_id": [key[0]], "fill": [fill], "emptied": [emptied], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fill, emptied, _ = tuple(self.now.get())
        self.now.clear()
        yield pd.DataFrame({"node_id": [key[0]], "fill": [fill], "emptied": [emptied], "live": [False]})


def _by_node(readings: DataFrame, late: str, *columns: str):
    use_store(readings.sparkSession)
    cols = readings.select("node_id", F.col("timestamp").cast("timestamp").alias("timestamp"), *columns)
    return cols.withWatermark("timestamp", late).groupBy("node_id")


def latest_until_silent(readings: DataFrame, idle_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """The newest reading of each node by event time whenever it changes (live), and once more when the node has been silent for idle_hours (not live)."""
    of = _by_node(readings, late, "reading_id", "waste_level", "gas_level")
    return of.transformWithStateInPandas(LatestState(idle_hours * HOUR_MS), LATEST, "Update", "EventTime")


def fill_until_silent(readings: DataFrame, full: float = 0.98, idle_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Fill level and emptyings of each node after each batch (live), and once more when it has been silent for idle_hours (not live)."""
    of = _by_node(readings, late, "reading_id", "waste_level")
    return of.transformWithStateInPandas(FillState(idle_hours * HOUR_MS, full), FILL, "Update", "EventTime")
