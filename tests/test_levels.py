"""Stored levels and what queries read of them; measures of several recordings at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe import verbs
from signalframe.operators import filters, pyramids
from signalframe.plans import levels, tiles


def long(spark, *signals):
    """Recordings 0, 1, ... of one channel."""
    return spark.createDataFrame([(r, 0, n, float(v)) for r, x in enumerate(signals) for n, v in enumerate(x)], "recording long, channel int, n long, x double")


def tone(hz, rate, seconds, phase=0.0, level=1.0):
    return level * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate + phase)


def many(spark, n):
    noise = F.sin(F.col("id") * 12.9898) * 43758.5453
    return spark.range(n).select(F.lit(0).cast("long").alias("recording"), F.lit(0).alias("channel"), F.col("id").alias("n"), (noise - F.floor(noise) - 0.5).alias("x"))


def read_by(df):
    """Rows that the scans of a query have read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            return walk(p.plan())
        if p.nodeName().startswith("Scan"):
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(out)


def test_a_query_reads_one_level(spark):
    n = 3_000_000
    samples = many(spark, n)
    stored = pyramids.peak_store(samples, 64)
    assert stored.top == math.ceil(math.log2(-(-n // 64)))
    for start, stop in ((0, n), (1 << 20, 1 << 21), (123_456, 2_222_222)):
        got = pyramids.peak_columns(stored, start, stop, 64)
        rows = {r["column"]: r for r in got.collect()}
        assert sorted(rows) == list(range(64)) and read_by(got) < n / 100
        plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PartitionFilters" in plan and "level" in plan.split("PartitionFilters")[1][:200]
    # where columns begin with bins, the level says what a scan of the samples says
    exact = {r["column"]: r for r in pyramids.peak_query(samples, 1 << 20, 1 << 21, 64).collect()}
    for r in pyramids.peak_columns(stored, 1 << 20, 1 << 21, 64).collect():
        own = exact[r["column"]]
        assert (r["min"], r["max"]) == (own["min"], own["max"]) and r["rms"] == pytest.approx(own["rms"], rel=1e-12)


def test_levels_of_odd_lengths_against_numpy(spark):
    rng = np.random.default_rng(4)
    signals = [rng.normal(size=n) for n in (1, 16, 17, 1000)]
    stored = pyramids.peak_store(long(spark, *signals), 16)
    got = {(r["recording"], r["level"], r["idx"]): r for r in stored.read().collect()}
    assert stored.top == 6
    for r, x in enumerate(signals):
        for level in range(stored.top + 1):
            w = 16 << level
            for i in range(-(-len(x) // w)):
                own, row = x[i * w : (i + 1) * w], got.pop((r, level, i))
                assert (row["min"], row["max"], row["frames"]) == (own.min(), own.max(), len(own)) and row["sq"] == pytest.approx((own**2).sum())
    assert not got
    with pytest.raises(ValueError):
        pyramids.peak_store(long(spark, signals[0]), 100)
    with pytest.raises(ValueError):
        stored.touched(5, 5, 3)
    none = pyramids.peak_store(long(spark), 16)
    assert pyramids.peak_columns(none, 0, 100, 4).count() == 0


def test_overview_of_a_spectrogram(spark):
    q = spark.range(4096 * 33).select(F.floor(F.col("id") / 33).alias("frame"), (F.col("id") % 33).alias("bin"), F.pmod(F.hash("id"), F.lit(256)).alias("q"))
    stored = tiles.overview(q)
    got = tiles.overview_view(stored, 0, 4096, 33, 32, 16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tiles.view(q, 4096, 33, 32, 16).collect()))  # columns of 128 frames are entries of a level
    assert read_by(got) < 4096 * 33 / 50
    detail = tiles.overview_view(stored, 100, 110, 33, 10, 33)
    assert sorted((r["column"], r["row"], r["q"]) for r in detail.collect()) == sorted((r["frame"] - 100, r["bin"], r["q"]) for r in q.filter("frame >= 100 AND frame < 110").collect())
    assert levels.column_of is not None


def test_true_peak_lies_between_the_samples(spark):
    """A tone of a quarter of the rate whose samples all lie at -3 dB; and each sub-block has its own."""
    x = tone(2000, 8000, 5, math.pi / 4) * np.minimum(1, np.arange(40000) / 2000)  # faded in: a sudden start overshoots
    c = verbs.contour(long(spark, x), 8000).filter("truePeakDbtp IS NOT NULL").collect()
    assert len(c) == 21 and all(abs(r["truePeakDbtp"]) < 0.02 for r in c) and max(abs(v) for v in x) < 0.71
    assert all(r["psrDb"] == pytest.approx(r["truePeakDbtp"] - r["shortTermLufs"]) for r in c)
    assert abs(verbs.contour_summary(long(spark, x), 8000).first()["truePeakDbtp"]) < 0.02
    # a loud half second moves into the window of three seconds and out again
    y = np.concatenate([tone(2000, 8000, 4, math.pi / 4, 0.1), tone(2000, 8000, 0.5, math.pi / 4), tone(2000, 8000, 4, math.pi / 4, 0.1)])
    loud = [r["seconds"] for r in verbs.contour(long(spark, y), 8000).collect() if r["truePeakDbtp"] is not None and r["truePeakDbtp"] > -1]
    assert (min(loud), max(loud)) == (pytest.approx(4.1), pytest.approx(7.5))


def test_true_peaks_of_blocks_are_those_of_the_whole(spark):
    x = np.random.default_rng(1).normal(size=70_000)  # more than a block
    phases = filters.interpolator(4, 25, filters.blackman_harris)
    assert phases[0] == pytest.approx(np.eye(25)[12]) and phases.sum(1) == pytest.approx(np.ones(4))
    top = np.max([np.abs(np.convolve(x, p)[: len(x)]) for p in phases] + [np.abs(x)], 0)
    assert filters.true_peak(long(spark, x)).first()["true_peak"] == pytest.approx(top.max(), rel=1e-12)
    got = {r["sub"]: r["true_peak"] for r in filters.sub_peaks(long(spark, x), 800).collect()}
    assert got == pytest.approx({i: top[i * 800 : (i + 1) * 800].max() for i in range(88)}, rel=1e-12)


def test_points_of_the_contour(spark):
    """From 0 at every interval; nothing before the windows are full; silence has a crest of 0."""
    c = {round(r["seconds"], 3): r for r in verbs.contour(long(spark, np.zeros(8000 * 4)), 8000, 0.25).collect()}
    assert sorted(c) == [k / 4 for k in range(17)]
    assert c[0.25]["momentaryLufs"] is None and c[0.5]["momentaryLufs"] == -200 and c[0.5]["crestDb"] == 0.0
    assert c[2.75]["shortTermLufs"] is None and c[3.0]["truePeakDbtp"] == -200 and c[3.0]["psrDb"] is None
    assert verbs.contour(long(spark, np.zeros(3000)), 8000).count() == 0
    s = verbs.contour_summary(long(spark, np.zeros(8000 * 4)), 8000).first()
    assert s["quietestShortTermLufs"] is None and s["plrDb"] is None and s["points"] == 41
    with pytest.raises(ValueError):
        verbs.contour(long(spark, np.zeros(10)), 8000, 0.0)


def test_recordings_stay_apart(spark):
    """Two tones measured together give what each gives alone."""
    a = tone(220, 8000, 3) + 0.5 * tone(277.18, 8000, 3) + 0.5 * tone(329.63, 8000, 3)
    b = tone(261.63, 8000, 3) + 0.5 * tone(311.13, 8000, 3) + 0.5 * tone(392, 8000, 3)
    b = np.round(b * 0.4 * 2**15) / 2**15
    both, alone = long(spark, a * 0.4, b), [long(spark, a * 0.4), long(spark, b)]
    for verb in (lambda s: verbs.key(spark, s, 8000), lambda s: verbs.bands(spark, s, 8000, octave=True), lambda s: verbs.provenance(s, 8000)):
        got = sorted(map(tuple, verb(both).collect()), key=str)
        want = sorted([(r, *tuple(row)[1:]) for r, s in enumerate(alone) for row in verb(s).collect()], key=str)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert [v for v in g if not isinstance(v, (float, list))] == [v for v in w if not isinstance(v, (float, list))]
            assert [v for v in g if isinstance(v, float)] == pytest.approx([v for v in w if isinstance(v, float)])
    keys = {r["recording"]: r for r in verbs.key(spark, both, 8000).collect()}
    assert (keys[0]["tonic"], keys[0]["mode"], keys[1]["key"]) == ("A", "major", "C minor")
    assert len(keys[0]["chroma"]) == 12 and sum(keys[0]["chroma"]) == pytest.approx(1) and max(range(12), key=lambda d: keys[0]["chroma"][d]) == 9
    bits = {r["recording"]: (r["effectiveBits"], r["padded"]) for r in verbs.provenance(both, 8000).collect()}
    assert bits[1] == (16, True) and bits[0][0] > 20
