"""Operators that no task holds a whole recording for, against one transform in numpy."""

import numpy as np
import pandas as pd
import pytest

from signalframe import verbs
from signalframe.operators import fourier, measure


def frame(spark, *signals, channel=True):
    parts = [pd.DataFrame({"recording": r, "channel": 0, "n": np.arange(len(x)), "x": np.asarray(x, float)}) for r, x in enumerate(signals)]
    df = spark.createDataFrame(pd.concat(parts), "recording long, channel int, n long, x double")
    return df if channel else df.drop("channel")


def plain_correlation(a, b, size):
    return np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)


def test_correlation_of_bundles(spark):
    """Recordings of one sample, of odd lengths, and of several bundles both ways."""
    rng = np.random.default_rng(2)
    a = [rng.normal(size=n) for n in (1, 5, 300, 300_000)]
    b = [rng.normal(size=n) for n in (1, 9, 41, 280_001)]
    give = lambda recording, size, at, r, frames, others: pd.DataFrame({"recording": recording, "size": size, "at": at, "r": r})
    got = fourier.correlation(frame(spark, *a, channel=False), frame(spark, *b, channel=False), give, "recording long, size long, at long, r double").toPandas()
    assert fourier.shape(20)[2] < fourier.shape(20)[1] and fourier.shape(20)[3] < fourier.shape(20)[0]
    for k, (x, y) in enumerate(zip(a, b)):
        own = got[got["recording"] == k].sort_values("at")
        size = int(own["size"].iloc[0])
        assert size >= len(x) + len(y) - 1 and own["at"].tolist() == list(range(size))
        assert np.abs(own["r"].to_numpy() - plain_correlation(x, y, size)).max() < 1e-9


def test_lags_and_levels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    pairs = [(x, np.concatenate([np.zeros(70), x])), (x[100:], x), (x, -0.5 * x), (np.zeros(50), np.ones(60)), (x[:10], x[2990:]), (x, np.concatenate([np.zeros(900), x]))]
    a, b = (frame(spark, *s) for s in zip(*pairs))
    got = {r["recording"]: r for r in verbs.null(a, b, 8000.0).collect()}
    assert {k: got[k]["delaySamples"] for k in (0, 1, 2, 3)} == {0: 70, 1: 100, 2: 0, 3: 0} and got[5]["delaySamples"] == 900
    assert got[2]["polarityInverted"] and got[2]["gainDb"] == pytest.approx(20 * np.log10(0.5)) and got[2]["verdict"] == "null"
    assert got[3]["verdict"] == "different" and got[3]["gainDb"] == -200 and got[0]["comparedFrames"] == 3000 and got[1]["comparedFrames"] == 2900
    near = {r["recording"]: r["delaySamples"] for r in verbs.null(a, b, 8000.0, max_delay=100).collect()}
    assert near[0] == 70 and abs(near[5]) <= 100
    silent = verbs.null(frame(spark, np.zeros(50)), frame(spark, np.zeros(60)), 8000.0).first()
    assert (silent["verdict"], silent["residualDb"]) == ("null", -200)
    same = {r["recording"]: r["verdict"] for r in verbs.null(frame(spark, x, x), frame(spark, x, np.append(x, 0.0)), 8000.0).collect()}
    assert same == {0: "identical", 1: "null"}  # lengths count for identity


def test_octaves_of_the_residual(spark):
    """A tone that only one of the two has stands in its octave."""
    n = np.arange(40_000)
    x = np.random.default_rng(5).normal(0, 0.1, len(n))
    y = x + 0.01 * np.sin(2 * np.pi * 1000 * n / 8000)
    got = {r["centreHz"]: r for r in verbs.null_bands(spark, frame(spark, x), frame(spark, np.concatenate([np.zeros(30), y])), 8000.0).collect()}
    assert max(got, key=lambda c: got[c]["residualDb"]) == 1000.0 and got[1000.0]["residualDb"] == pytest.approx(-40, abs=0.5)
    assert got[1000.0]["residualDb"] - got[250.0]["residualDb"] > 30 and got[250.0]["referenceDb"] > -45


def test_deconvolution_in_blocks(spark):
    """As one convolution over the whole, for blocks that are shorter and longer than the recording."""
    rng = np.random.default_rng(6)
    sweep, x = rng.normal(size=900), rng.normal(size=9000)
    t = np.arange(900) / 8000
    inverse = sweep[::-1] * np.exp(-t * np.log(3000 / 50) / (900 / 8000))
    inverse = inverse / np.abs(np.convolve(sweep, inverse)).max()
    want = np.convolve(x, inverse)[899:]
    df = frame(spark, x, x[:899], x[:900])
    for size in (1, 4096, 1 << 16):
        got = measure.deconvolve(df, sweep, 8000, 50, 3000, size=size).toPandas()
        own = got[got["recording"] == 0].sort_values("n")
        assert own["n"].tolist() == list(range(9000)) and np.abs(own["x"].to_numpy() - want).max() < 1e-9
        assert sorted(got["recording"].unique()) == [0, 2]
    assert measure.deconvolve(df, sweep, 8000, 50, 3000, keep=10).count() == 20


def test_peak_above_the_tail(spark):
    x = np.zeros(1000)
    x[3], x[900:] = -1.0, 0.01
    got = {r["recording"]: r for r in verbs.deconvolve_report(frame(spark, x, np.zeros(100)), 8000.0).collect()}
    assert (got[0]["frames"], got[0]["seconds"]) == (1000, 0.125) and got[0]["peakAboveTailDb"] == pytest.approx(40) and got[1]["peakAboveTailDb"] is None
