"""Gate, limiter, resampler and hum search against plain loops and known answers; results don't depend on the size of blocks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalframe import verbs
from signalframe.operators import filters, repair

RATE = 8000


def frame(spark, *signals):
    parts = [pd.DataFrame({"recording": r, "channel": 0, "n": np.arange(len(x)), "x": np.asarray(x, float)}) for r, x in enumerate(signals)]
    return spark.createDataFrame(pd.concat(parts), "recording long, channel int, n long, x double")


def back(df, recording=0):
    pdf = df.toPandas()
    return pdf[pdf["recording"] == recording].sort_values("n")["x"].to_numpy()


def plain_gate(x, threshold, hysteresis, hold, depth, attack, release, detector):
    c = lambda s: math.exp(-1 / (s * RATE)) if s > 0 else 0.0
    level, gain, left, open_, out = 0.0, depth, 0, False, []
    for v in x:
        level = max(abs(v), abs(v) + c(detector) * (level - abs(v)))
        db = 20 * math.log10(level) if level > 1e-10 else -200.0
        if db > threshold:
            open_, left = True, int(hold * RATE + 0.5)
        elif db < threshold - hysteresis:
            if left > 0:
                left -= 1
            else:
                open_ = False
        target = 0.0 if open_ else depth
        gain = target + (c(attack) if target > gain else c(release)) * (gain - target)
        out.append(v * 10 ** (gain / 20))
    return np.array(out)


def bursts(seed, n=30_000):
    """Loud, quiet and silent stretches of all lengths, so that blocks begin in every state."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.normal(0, rng.choice([0, 1e-4, 2e-3, 4e-3, 0.3]), int(rng.integers(1, 3000))))
    return np.concatenate(out)[:n]


@pytest.mark.parametrize("hold,hysteresis,detector", [(0.01, 6.0, 0.01), (0.2, 3.0, 0.002), (0.0, 0.0, 0.01)])
def test_gate_in_blocks(spark, hold, hysteresis, detector):
    signals = [bursts(k) for k in range(2)] + [np.zeros(50), np.array([0.5])]
    df = frame(spark, *signals)
    for size in (500, 1 << 16):
        got = filters.gate(df, RATE, -50.0, hysteresis, hold, -80.0, 0.001, 0.05, detector, size)
        for k, x in enumerate(signals):
            assert np.abs(back(got, k) - plain_gate(x, -50.0, hysteresis, hold, -80.0, 0.001, 0.05, detector)).max() < 1e-9


def test_held_peaks_against_a_loop():
    rng = np.random.default_rng(8)
    for n in (1, 255, 256, 257, 3000):
        v, s, want = np.abs(rng.normal(size=n)), 0.0, []
        for x in v:
            s = max(x, 0.01 * x + 0.99 * s)
            want.append(s)
        assert np.abs(filters.held_peaks(v, 0.99) - want).max() < 1e-12


def peak_between(x, factor=32):
    n = 1 << (len(x) - 1).bit_length()
    spectrum = np.zeros(n * factor // 2 + 1, complex)
    spectrum[: n // 2 + 1] = np.fft.rfft(x, n)
    return np.abs(np.fft.irfft(spectrum, n * factor)).max() * factor


def test_limiter_hears_between_the_samples(spark):
    """A tone of 0.4 of the rate whose waveform is higher than any sample; only the true-peak side chain keeps it under the ceiling."""
    n = np.arange(16_000)
    x = 0.9 * np.sin(2 * np.pi * 0.2475 * n + 0.78) * (0.7 + 0.3 * np.sin(2 * np.pi * 3 * n / RATE))
    df, top = frame(spark, x), 10 ** (-6 / 20)
    plain, heard = back(filters.limit(df, RATE, -6.0)), back(filters.limit(df, RATE, -6.0, true_peak=True))
    assert np.abs(plain).max() <= top + 1e-12 and np.abs(heard).max() <= top + 1e-12
    assert peak_between(heard[2000:-2000] * np.hanning(12_000)) <= top * 1.012 < peak_between(plain[2000:-2000] * np.hanning(12_000))
    with pytest.raises(ValueError):
        filters.limit(df, RATE, true_peak=True, oversampling=17)


def test_detector_against_a_direct_sum(spark):
    x = np.random.default_rng(1).normal(size=1000)
    half, factor = 16, 4
    want = np.abs(x)
    for p in range(factor):
        at = p / factor + np.arange(33) - half
        h = np.where(at <= half, np.sinc(at) * np.i0(5 * np.sqrt(np.maximum(0, 1 - (at / half) ** 2))) / np.i0(5.0), 0)
        padded = np.concatenate([np.zeros(half), x, np.zeros(half)])
        want = np.maximum(want, np.abs([padded[i : i + 33] @ (h / h.sum())[::-1] for i in range(1000)]))
    assert np.abs(back(filters.detect_true_peak(frame(spark, x), 4)) - want).max() < 1e-12
    one = np.zeros(100)
    one[40] = 1.0
    assert back(filters.detect_true_peak(frame(spark, one)))[40] == pytest.approx(1.0)


@pytest.mark.parametrize("quality,edge,stop,depth", [("fast", 0.38, 0.5, 75), ("best", 0.43, 0.5, 120)])
def test_resampler_passes_and_stops(spark, quality, edge, stop, depth):
    """Flat up to near the cut-off, and nothing of what the lower rate can't hold."""
    n = np.arange(24_000)
    level = lambda y: np.sqrt(2 * (y[len(y) // 4 : -len(y) // 4] ** 2).mean())
    for hz, want in ((500, 1.0), (edge * 4000, 1.0), (stop * 4000 + 60, 0.0)):
        y = back(filters.resample(frame(spark, np.sin(2 * np.pi * hz * n / RATE)), RATE, 4000, quality))
        assert len(y) == 12_000
        if want:
            assert 20 * np.log10(level(y)) == pytest.approx(0, abs=0.02)
        else:
            assert 20 * np.log10(max(level(y), 1e-12)) < -depth
    # the kernel's -6 dB point is its cut-off, not half the rate
    up = back(filters.resample(frame(spark, np.sin(2 * np.pi * filters.QUALITIES[quality][3] * RATE * n / RATE)), RATE, 12_000, quality))
    assert 20 * np.log10(level(up)) == pytest.approx(-6.02, abs=0.1)


def test_resampler_edges(spark):
    x = np.random.default_rng(0).normal(size=70_000)
    df = frame(spark, x, [1.0])
    assert (back(filters.resample(df, RATE, RATE)) == x).all()
    with pytest.raises(ValueError):
        filters.resample(df, RATE, 48_000, "finest")
    with pytest.raises(ValueError):
        filters.resample(df, RATE, 10)
    y = back(filters.resample(df, RATE, 11_025))
    _, kernel = filters.sinc_kernel("best")
    for k in (0, 5, 90_000, 96_468):  # also around the edge of a block
        at = np.arange(len(x)) - k * RATE / 11_025
        near = np.abs(at) < 64
        assert y[k] == pytest.approx(float((x[near] * kernel(at[near])).sum()), abs=1e-9)
    assert len(y) == math.ceil(70_000 * 11_025 / 8000)


def test_hum_is_found_to_a_hundredth(spark):
    """49.97 Hz with partials is found and goes; a gliding tone, a single tone and noise are refused."""
    n = np.arange(200_000)
    rng = np.random.default_rng(6)
    noise = 0.02 * rng.normal(size=len(n))
    hum = sum(0.1 / k * np.sin(2 * np.pi * 49.97 * k * n / RATE + k) for k in range(1, 6))
    glide = 0.3 * np.sin(2 * np.pi * np.cumsum(50 + 3 * np.sin(2 * np.pi * n / RATE / 5)) / RATE)
    df = frame(spark, hum + noise, glide + noise, noise, hum[:50_000])
    got = {r["recording"]: r for r in repair.find_hum(df, RATE).collect()}
    assert got[0]["found"] and got[0]["hz"] == pytest.approx(49.97, abs=0.011) and len(got[0]["parts"]) == 5
    assert not got[1]["found"] and not got[2]["found"] and not got[3]["found"]
    clean = verbs.dehum(df, RATE)
    assert ((back(clean) - noise)[5000:-5000] ** 2).mean() < 0.01 * (hum**2).mean()
    for k, x in ((1, glide + noise), (2, noise)):
        assert (back(clean, k) == x).all()
    r = {x["recording"]: x for x in verbs.dehum_report(df, RATE).collect()}
    assert r[0]["harmonics"] == 5 and r[0]["removedDb"] < -10 and (r[2]["harmonics"], r[2]["removedDb"]) == (0, 0.0)
    given = {x["recording"]: x for x in repair.find_hum(df, RATE, 49.97, 8).collect()}
    assert len(given[0]["parts"]) == 5 and not given[2]["found"] and len(given[3]["parts"]) == 8


def test_a_lone_second_hum_doesnt_lower_the_first(spark):
    n = np.arange(140_000)
    x = 0.01 * np.random.default_rng(7).normal(size=len(n))
    one = x + sum(0.1 * np.sin(2 * np.pi * 50 * k * n / RATE) for k in (1, 2, 3))
    two = one + 0.1 * np.sin(2 * np.pi * 60 * n / RATE)
    got = {r["recording"]: r for r in repair.find_hum(frame(spark, one, two), RATE).collect()}
    assert all(got[k]["hz"] == pytest.approx(50, abs=0.011) for k in (0, 1)) and got[1]["evidence"] == pytest.approx(got[0]["evidence"], rel=0.2)


def test_hum_is_looked_for_in_all_of_a_recording(spark):
    """Hum that is silent at the beginning, in the middle and at the end is found; hum that is only there, in less than four of ten groups, is none."""
    span, n = 131_072, F.col("n")
    frames = 10 * span - 5000
    rows = spark.range(2 * frames).select((F.col("id") % 2).alias("recording"), F.lit(0).alias("channel"), F.floor(F.col("id") / 2).alias("n"))
    middle = (frames - span) // 2
    ends = (n < span) | n.between(middle, middle + span - 1) | (n >= frames - span)
    hum = sum(0.1 / k * F.sin(2 * math.pi * 49.98 * k / RATE * n) for k in (1, 2, 3))
    noise = 0.02 * (F.pmod(F.xxhash64("recording", "n"), F.lit(2001)) / 1000 - 1)
    rows = rows.withColumn("x", F.when(ends == (F.col("recording") == 1), hum).otherwise(0.0) + noise)
    got = {r["recording"]: r for r in repair.find_hum(rows, RATE).collect()}
    assert got[0]["found"] and got[0]["hz"] == pytest.approx(49.98, abs=0.011) and len(got[0]["parts"]) == 3
    assert not got[1]["found"]
    given = {r["recording"]: r for r in repair.find_hum(rows, RATE, 49.98).collect()}
    assert len(given[0]["parts"]) == 3 and not given[1]["found"] and given[1]["parts"] is None


def test_groups_of_hum_cover_all_samples(spark):
    span = repair.HumMeter.SPAN
    for frames, begins in ((span, [0]), (3 * span, [0, span, 2 * span]), (2 * span + 9, [0, (span + 9) // 2, span + 9])):
        rows = spark.range(frames).select(F.lit(7).cast("long").alias("recording"), F.lit(0).alias("channel"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
        ends = rows.groupBy("recording").agg(F.count("*").alias("frames"))
        got = repair.hum_groups(rows, ends).select("start", F.size("xs").alias("size"), F.col("xs")[0].alias("first")).orderBy("start").collect()
        assert [(r["start"], r["size"], r["first"]) for r in got] == [(b, span, b) for b in begins]


def response(sections, hz):
    z = np.exp(-2j * np.pi * np.asarray(hz, float) / RATE)
    out = np.ones(len(z), complex)
    for b0, b1, b2, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return 20 * np.log10(np.abs(out))


@pytest.mark.parametrize("order", [2, 4, 6, 12])
def test_band_pass_is_the_analogue_one(order):
    """Against the closed form of a Butterworth band-pass at warped frequencies; 3 dB down at both edges."""
    low, high = 707.1, 1414.2
    sections = filters.band_pass(RATE, low, high, order)
    hz = np.array([50.0, 300, low, 900, 1000, high, 2500, 3900])
    w, a, b = (np.tan(np.pi * np.asarray(f) / RATE) for f in (hz, low, high))
    want = -10 * np.log10(1 + ((w * w - a * b) / (w * (b - a))) ** order)
    assert len(sections) == order // 2 and response(sections, hz) == pytest.approx(want, abs=1e-6)
    assert response(sections, [low, high]) == pytest.approx(-3.0103, abs=1e-4)
    middle = np.arctan(np.sqrt(a * b)) * RATE / np.pi
    assert response(sections, [middle]) == pytest.approx(0, abs=1e-9)


def test_layout_of_bands():
    octaves, thirds = filters.band_layout(48_000), filters.band_layout(48_000, True)
    assert [round(b["centre"], 1) for b in octaves] == [31.6, 63.1, 125.9, 251.2, 501.2, 1000.0, 1995.3, 3981.1, 7943.3, 15848.9]
    assert len(thirds) == 31 and round(thirds[0]["centre"], 2) == 19.95 and round(thirds[-1]["centre"]) == 19953
    assert [b["reason"] for b in filters.band_layout(16_000)][-2:] == ["above Nyquist", "above Nyquist"]
    assert all((b["sections"] is None) == (b["reason"] is not None) for b in thirds)
    with pytest.raises(ValueError):
        filters.band_layout(8000, order=5)


def test_levels_of_a_bank(spark):
    """A tone in one band, over more than a block; what can't be measured says why."""
    x = np.sin(2 * np.pi * 1000 * np.arange(70_000) / RATE)
    got = {round(r["centre"]): r for r in verbs.bands(spark, frame(spark, x), RATE, octave=True, filtered=True).withColumnRenamed("centreHz", "centre").collect()}
    assert got[1000]["levelDbfs"] == pytest.approx(0, abs=0.015) and got[501]["levelDbfs"] < -15 and got[1995]["levelDbfs"] < -15
    assert got[3981]["levelDbfs"] is None and got[3981]["missingBecause"] == "above Nyquist"


def test_decay_of_each_band(spark):
    """Noise that dies in one octave within 0.4 s and in another within 0.8 s."""
    n = np.arange(16_000)
    rng = np.random.default_rng(3)

    def band(centre, seconds):
        spectrum = np.fft.rfft(rng.normal(size=len(n)))
        hz = np.fft.rfftfreq(len(n), 1 / RATE)
        spectrum[(hz < centre / 1.3) | (hz > centre * 1.3)] = 0
        return np.fft.irfft(spectrum, len(n)) * 10 ** (-3 * n / RATE / seconds)

    x = band(500, 0.4) + band(2000, 0.8)
    got = {round(r["centreHz"]): r for r in verbs.room(frame(spark, x, x), RATE, banded=True).filter("recording = 1").collect()}
    assert got[501]["t20Seconds"] == pytest.approx(0.4, rel=0.15) and got[1995]["t20Seconds"] == pytest.approx(0.8, rel=0.15)
    assert got[3981]["t20Seconds"] is None and len(got) == 10


def test_keys_look_at_a_part_of_long_recordings(spark):
    from pyspark.sql import functions as F

    from signalframe.plans import tiles

    x = np.round(np.random.default_rng(2).normal(0, 0.2, 100_000) * 32768) / 32768
    changed = x.copy()
    changed[50_000] += 0.5  # in a block that is looked at
    hidden = x.copy()
    hidden[3000] += 0.5  # between two
    df = frame(spark, x, x, changed, hidden, x[:-1], x[:5000], np.append(x[:4999], 0.5)).drop("channel")
    k = {r["recording"]: r["key"] for r in tiles.source_keys(df, RATE, 1).collect()}
    assert k[0] == k[1] == k[3] and len({k[0], k[2], k[4], k[5], k[6]}) == 5
    assert {r["key"] for r in tiles.source_keys(df.filter(F.col("recording") == 0), RATE, 2).collect()} != {k[0]}
