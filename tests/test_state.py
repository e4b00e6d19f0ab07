import datetime
import random

import numpy as np
import pytest

from fleetsense.streaming import state, telemetry

SCHEMA = "node_id long, reading_id long, timestamp timestamp, waste_level double, gas_level double"
START = datetime.datetime(2024, 3, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def run(spark, tmp_path, batches, make):
    """Each batch is a file that a micro-batch reads; rows come back with the batch they were given in."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    return telemetry.run_once(make(stream), "update", "state", str(tmp_path / "out")).collect()


def test_latest_ends_and_begins_again(spark, tmp_path):
    batches = [
        [(1, 1, at(0), 0.1, 0.0), (1, 2, at(1), 0.2, 0.0), (2, 3, at(1), 0.3, 0.0)],
        [(1, 4, at(0.5), 0.9, 0.0), (2, 5, at(20), 0.4, 0.0)],  # an older row, not too late
        [(2, 6, at(40), 0.5, 0.0)],  # node 1 has been silent for a day: closed in the next batch
        [(2, 8, at(2), 0.7, 0.0)],  # a row behind the watermark
        [(1, 7, at(41), 0.6, 0.0)],  # node 1 begins again
        [(3, 9, at(200), 0.8, 0.0)],
    ]
    got = [(r.node_id, r.reading_id, r.live) for r in run(spark, tmp_path, batches, state.latest_until_silent)]
    assert sorted(got) == sorted([(1, 2, True), (2, 3, True), (2, 5, True), (2, 6, True), (1, 2, False), (1, 7, True), (1, 7, False), (2, 6, False), (3, 9, True)])


def test_fill_ends(spark, tmp_path):
    batches = [
        [(1, 1, at(0), 0.5, 0.0), (1, 2, at(1), 0.6, 0.0), (1, 3, at(2), None, 0.0), (2, 4, at(2), 0.2, 0.0)],
        [(2, 5, at(3), 0.9, 0.0)],
        [(3, 6, at(90), 0.1, 0.0)],
        [(3, 7, at(91), 0.2, 0.0)],
    ]
    got = [(r.node_id, round(r.fill, 6), r.emptied, r.live) for r in run(spark, tmp_path, batches, state.fill_until_silent)]
    assert sorted(got) == sorted([(1, 0.0, 1, True), (2, 0.2, 0, True), (2, 0.0, 1, True), (1, 0.0, 1, False), (2, 0.0, 1, False), (3, 0.1, 0, True), (3, 0.3, 0, True)])


@pytest.mark.parametrize("seed", range(5))
def test_filled_is_the_loop_over_rows(seed):
    r = random.Random(seed)
    more = np.array([r.choice([0.0, 0.1, 0.5, 1.2]) for _ in range(r.randint(0, 60))])
    fill, emptied = 0.3, 2
    got = state.filled(more, fill, emptied, 0.98)
    for m in more:
        fill += m
        if fill >= 0.98:
            fill, emptied = 0.0, emptied + 1
    assert (round(got[0], 9), got[1]) == (round(fill, 9), emptied)
