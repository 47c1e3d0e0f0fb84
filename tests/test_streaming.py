"""Streams against batches, however they are cut."""

import os

import numpy as np
import pytest

from signalframe.operators import filters
from signalframe.streaming import convert, meters
from tests.test_signal import RATE, signal


def play(spark, tmp_path, rows, schema, plan, name, mode="append"):
    """Each row a file of its own, one to a micro-batch."""
    folder = tmp_path / name
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
        for f in (folder / f"{i:03d}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)  # the order in which they come
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.mark.parametrize("to", [11025.0, 5000.0, 8000.0])
def test_conversion_equals_the_batch(spark, tmp_path, to):
    x = np.random.default_rng(1).standard_normal(700)
    cuts = [0, 90, 100, 350, 351, 700]
    rows = [(0, 0, i, x[a:b].tolist(), b == 700) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = play(spark, tmp_path, rows, "recording long, channel int, block_index long, samples array<double>, last boolean", lambda s: convert.convert(s, RATE, to), f"conv{int(to)}")
    want = x if to == RATE else np.array([r["x"] for r in filters.resample(signal(spark, x), RATE, to).orderBy("n").collect()])
    got = np.array([r["x"] for r in sorted(got, key=lambda r: r["n"])])
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-12


def test_segments_keep_totals(spark, tmp_path):
    rows = [(0, 1, [1.0, -2.0]), (0, 1, [0.5]), (0, 2, [3.0])]
    got = play(spark, tmp_path, rows, "recording long, segment int, samples array<double>", convert.segment_peaks, "segments", "complete")
    assert {r["segment"]: (r["peak"], r["frames"]) for r in got} == {1: (2.0, 3), 2: (3.0, 1), None: (3.0, 4)}


def test_settings_in_force(spark, tmp_path):
    settings = spark.createDataFrame([(0, 1, 0.5), (0, 2, 2.0)], "recording long, version int, gain double")
    got = play(spark, tmp_path, [(0, [1.0]), (1, [1.0])], "recording long, samples array<double>", lambda s: convert.with_settings(s, settings), "settings")
    assert {r["recording"]: r["samples"] for r in got} == {0: [2.0], 1: [1.0]}


def test_running_statistics_and_late_events(spark, tmp_path):
    from datetime import datetime

    rows = [(0, 0, [1.0, -2.0]), (0, 0, [0.5, 0.5])]
    got = play(spark, tmp_path, rows, "recording long, channel int, samples array<double>", meters.running_statistics, "stats", "complete")
    assert (got[0]["peak"], got[0]["frames"], got[0]["mean"]) == (2.0, 4, 0.0)
    at = [datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 1, 5, 0), datetime(2024, 1, 1, 9, 0), datetime(2024, 1, 1, 0, 1), datetime(2024, 1, 1, 20, 0)]
    rows = [(t, "a", 1.0) for t in at]
    got = play(spark, tmp_path, rows, "ts timestamp, event_type string, value double", lambda s: meters.event_rates(s), "late")
    assert all(r["c"] == 1 for r in got) and len(got) >= 2  # the event that came hours late is in no window
