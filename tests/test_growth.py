"""Steps that must hold when recordings are many or long: what tasks get, and that results stay."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe import model, queries
from signalframe.functions import scalars
from signalframe.operators import blocks, edits, filters, measure, repair


def _long(spark, recordings: int, frames: int):
    return spark.range(recordings * frames).select((F.col("id") % recordings).alias("recording"), F.lit(0).alias("channel"), F.floor(F.col("id") / recordings).alias("n"), F.sin(F.col("id") * 0.7).alias("x"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    """Only what the code itself broadcasts."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k in keys:
        spark.conf.unset(k)


def test_samples_are_shuffled_in_arrays(spark):
    rows = _long(spark, 2, 5000)
    packed = blocks.pack(rows, 1000, 10, 20)
    plan = _plan(packed)
    exchange = plan[plan.index("Exchange hashpartitioning") :]
    assert "MapInArrow" in exchange, plan  # below the exchange, so pieces of blocks go through it
    got = {(r["recording"], r["block"]): r for r in packed.collect()}
    assert len(got) == 10
    for (rec, b), r in got.items():
        first, last = max(0, b * 1000 - 10), min(5000, (b + 1) * 1000 + 20)
        assert (r["start"], len(r["xs"]), r["start"] + r["lo"], r["start"] + r["hi"]) == (first, last - first, b * 1000, (b + 1) * 1000)
        assert np.allclose(r["xs"], np.sin((np.arange(first, last) * 2 + rec) * 0.7))


def test_many_short_gates_take_no_group_each(spark):
    """Gated as one long recording is: the states of many recordings go through one scan."""
    rows = _long(spark, 300, 40).withColumn("x", F.when(F.col("n") % 20 < 5, F.col("x")).otherwise(F.col("x") * 1e-4))
    gated = filters.gate(rows, 8000.0)
    assert "FlatMapGroupsInPandas" not in _plan(gated)
    assert gated.count() == 12000
    small = {(r["recording"], r["n"]): r["x"] for r in filters.gate(rows.filter("recording < 3"), 8000.0, size=16).collect()}
    for r in gated.filter("recording < 3").collect():
        assert math.isclose(r["x"], small[r["recording"], r["n"]], abs_tol=1e-9)


def test_held_peaks_step_by_step_are_those_of_lanes():
    v = np.abs(np.random.default_rng(3).standard_normal(20000))
    assert np.allclose(filters.held_peaks(v, 0.99, lane=8), filters.held_peaks(v, 0.99, lane=1 << 12), atol=1e-12)


@pytest.mark.parametrize("ratio", [8000 / 11025, 2**0.25, 6.0])
def test_kernel_table_is_the_kernel(ratio):
    half, kernel = filters.sinc_kernel("best")
    stretch = max(1.0, ratio)
    taps, table = filters.kernel_table("best", stretch)
    t = taps / stretch
    inner = np.abs(t) < half - 1e-6
    assert np.abs(table[1] - kernel(t))[inner].max() < 1e-14


@pytest.mark.parametrize("operator", ["declip", "denoise", "dehum", "deconvolve", "tail"])
def test_no_task_gets_a_whole_recording(unbroadcast, operator):
    rows = _long(unbroadcast, 1, 9000)
    sweep = np.sin(np.arange(64) ** 1.5)
    out = {
        "declip": lambda: repair.declip(rows), "denoise": lambda: repair.denoise(rows, 0, 2100), "dehum": lambda: repair.dehum(rows, 8000.0),
        "deconvolve": lambda: measure.deconvolve(rows, sweep, 8000.0, 20.0, 3000.0), "tail": lambda: measure.peak_to_tail(rows),
    }[operator]()
    for join in (line for line in _plan(out).splitlines() if "SortMergeJoin" in line):
        assert "block" in join or operator == "tail" and "LeftOuter" in join, join  # one row a recording


def test_beside_deals_out_a_large_side(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 1)
    rows = _long(spark, 3, 200).withColumnRenamed("n", "block")
    side = spark.range(3).select(F.col("id").alias("recording"), (F.col("id") * 10).alias("v"))
    got = blocks.beside(rows, side, ["recording"])
    assert got.count() == 600 and got.filter("v != recording * 10").count() == 0


def test_a_dealt_side_is_not_broadcast(spark, monkeypatch):
    """Its files are small, its 64 copies aren't: broadcast, they filled the driver."""
    monkeypatch.setattr(blocks, "FEW", 1)
    side = spark.range(300).select(F.col("id").alias("recording"), (F.col("id") * 10).alias("v"))
    got = blocks.beside(_long(spark, 300, 4).withColumnRenamed("n", "block"), side, ["recording"])
    assert "Broadcast" not in _plan(got) and got.count() == 1200
    got = blocks.beside(_long(spark, 400, 4).withColumnRenamed("n", "block"), side, ["recording"], "left")
    assert "Broadcast" not in _plan(got) and got.filter("v = recording * 10").count() == 1200 and got.filter("v IS NULL").count() == 400


def test_tempo_beside_a_peak_of_the_correlation():
    """The prior may choose a lag on the slope of a peak: the parabola there led to lags below 0, and to an error."""
    r = np.random.default_rng(0)
    for _ in range(3000):
        e = np.maximum(0.0, r.exponential(1.0, int(r.integers(30, 90))) - 1.0)
        measure.tempo(e, 8.0)


def test_copies_are_numbered_in_ranges(spark):
    clips = spark.range(1000).select(F.col("id").alias("clip_id"), F.lit(1).alias("source_id"), (F.col("id") * 3).alias("timeline_start"), F.lit(5).alias("length"))
    out = edits.duplicate(clips, clips.select("clip_id", (F.col("timeline_start") + 7).alias("new_start")), 1000)
    assert "Window [row_number" not in _plan(out)
    got = {r["clip_id"]: r["timeline_start"] for r in out.filter("clip_id >= 1000").collect()}
    assert got == {1000 + i: i * 3 + 7 for i in range(1000)}


def test_bessel_stops_where_the_sql_does(spark):
    p = 48.0
    want = sum((p / 2) ** (2 * k) / math.gamma(k + 1) ** 2 for k in range(40))
    assert math.isclose(spark.range(1).select(scalars.bessel_i0(F.lit(p))).first()[0], want, rel_tol=1e-14)


def test_a_session_is_no_longer_one_row(spark, monkeypatch):
    from signalframe import queries_verbs

    seen = {}
    monkeypatch.setattr(queries_verbs.verbs, "render", lambda sessions, sources: (seen.setdefault("s", sessions).select(F.lit(0.0).alias("x")), None))
    queries.QUERIES["v_render"](spark, "/root/testdata/sf0.01").count()
    assert seen["s"].count() == 15  # 15,000 clips
    assert seen["s"].select(F.max(F.length("json"))).first()[0] < 1_000_000


def test_ranges_to_number_grow_in_count_not_in_size(spark, monkeypatch, tmp_path):
    """A task that numbers rows sorts so many, however well a shuffle packs them."""
    monkeypatch.setattr(model, "ROWS", 500)
    spark.range(20000).select(((F.col("id") * 7919) % 20000).alias("o_orderkey"), F.lit(1).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    out = model.numbered(spark, str(tmp_path), "orders", ["o_orderkey"], ["o_custkey"], "rank")
    assert out.filter("rank != o_orderkey").count() == 0 and out.count() == 20000
    assert len(out.inputFiles()) > 30  # one for each range
