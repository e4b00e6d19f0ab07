"""Streaming twins: latest state by event time, window aggregates, collection cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dashboard

LATEST = "node_id long, timestamp timestamp, reading_id long, waste_level double, gas_level double"
LATEST_STATE = "us long, reading_id long, waste_level double, gas_level double"


def latest_state(readings: DataFrame) -> DataFrame:
    """The newest reading of each node by event time, given again whenever it changes. A late older row changes nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        best = old
        for pdf in batches:
            us = pdf["timestamp"].astype("int64").to_numpy() // (1000 if pdf["timestamp"].dtype == "datetime64[ns]" else 1)
            pdf = pdf.assign(us=us).sort_values(["us", "reading_id"])
            r = pdf.iloc[-1]
            new = (int(r.us), int(r.reading_id), float(r.waste_level), float(r.gas_level))
            if best is None or new[:2] > tuple(best[:2]):
                best = new
        if best != old:
            state.update(tuple(best))
            yield pd.DataFrame([{"node_id": key[0], "timestamp": pd.Timestamp(best[0], unit="us"), "reading_id": best[1], "waste_level": best[2], "gas_level": best[3]}])

    cols = readings.select("node_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "reading_id", "waste_level", "gas_level")
    return cols.groupBy("node_id").applyInPandasWithState(step, LATEST, LATEST_STATE, "update", GroupStateTimeout.NoTimeout)


def windows(readings: DataFrame, size: str = "6 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and maximum fill of tumbling (or sliding) windows, final once the watermark has passed."""
    w = F.window(F.col("timestamp"), size, slide) if slide else F.window(F.col("timestamp"), size)
    g = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).groupBy(w.alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg("waste_level").alias("mean_waste"), F.max("waste_level").alias("max_waste")).select(F.col("w.start").alias("start"), "n", "mean_waste", "max_waste")


def sessions(readings: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    g = readings.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late).groupBy("node_id", F.session_window("timestamp", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("node_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cycles(readings: DataFrame, full: float = 0.98) -> DataFrame:
    """node_id, emptied, times: how often each node was full, given again on a change."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else 0
        n = old + sum(int((pdf["waste_level"] >= full).sum()) for pdf in batches)
        if n != old:
            state.update((n,))
            yield pd.DataFrame([{"node_id": key[0], "times": n}])

    return readings.select("node_id", "waste_level").groupBy("node_id").applyInPandasWithState(step, "node_id long, times long", "times long", "update", GroupStateTimeout.NoTimeout)


def fill_machine(readings: DataFrame, full: float = 0.98) -> DataFrame:
    """node_id, fill, emptied: what readings (their waste_level is what came in) have filled each node with; at `full` it is emptied and counted.

    Within a batch a node's readings are taken in order of time and id; state goes on over batches. Given again whenever it changes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fill, emptied = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["timestamp", "reading_id"])  # one node's rows of one batch
        for more in rows["waste_level"].fillna(0.0):
            fill += float(more)
            if fill >= full:
                fill, emptied = 0.0, emptied + 1
        state.update((fill, emptied))
        yield pd.DataFrame([{"node_id": key[0], "fill": fill, "emptied": emptied}])

    cols = readings.select("node_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "reading_id", "waste_level")
    return cols.groupBy("node_id").applyInPandasWithState(step, "node_id long, fill double, emptied long", "fill double, emptied long", "update", GroupStateTimeout.NoTimeout)


def ingest(payloads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Readings of a stream of JSON bodies; the time is the server's, whatever the body says."""
    return dashboard.ingest(payloads, nodes).withColumn("timestamp", F.current_timestamp())


def refresh(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds", mode: str = "append"):
    """Run `work` on what is new every so often (dashboards 10 seconds, notifications 30); the query is given back and runs until it is stopped."""
    return stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def route_after_each_batch(stream: DataFrame, route: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Write the route that follows from each micro-batch; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        route(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, mode: str, name: str, path: str) -> DataFrame:
    """All that is there now, through the stream, into Parquet below path; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
