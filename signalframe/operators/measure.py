"""Alignment, decay and pitch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FLOOR_DB, db
from .blocks import BLOCK, beside, map_blocks, pack
from .fourier import correlation
from .room import remaining


def residual(a: DataFrame, b: DataFrame, lag: int) -> DataFrame:
    """Gain, compared frames and residual of ``a(recording, n, x)`` less the matched, shifted ``b``, per recording."""
    j = a.select("recording", "n", F.col("x").alias("x")).join(b.select("recording", (F.col("n") - lag).alias("n"), F.col("x").alias("y")), ["recording", "n"])
    t = j.groupBy("recording").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("frames"))
    g = F.when(F.col("yy") > 0, F.col("xy") / F.col("yy")).otherwise(1.0)
    left = F.col("xx") - 2 * g * F.col("xy") + g * g * F.col("yy")
    return t.select("recording", "frames", g.alias("gain"), F.when(F.col("xx") > 0, db(F.greatest(left, F.lit(0.0)) / F.col("xx"), 10.0)).alias("residual_db"))


def lags(a: DataFrame, b: DataFrame, most: int = 0) -> DataFrame:
    """``recording, lag``: how far ``b(recording, n, x)`` lies behind ``a``: where their cross-correlation (``fourier``) is largest in size; ties go to the smallest absolute lag, then to the negative one."""

    def best(recording, size, at, r, frames, others) -> pd.DataFrame:
        lag = np.where(at < others, at, at - size)
        ok = (lag > -frames) & (np.abs(lag) <= (most or size))
        v, lag = np.round(np.abs(r[ok]), 9), lag[ok]
        if not len(v):
            return pd.DataFrame({"recording": [], "v": [], "lag": []})
        k = np.lexsort((lag, np.abs(lag), -v))[0]
        return pd.DataFrame({"recording": [recording], "v": [v[k]], "lag": [lag[k]]})

    found = correlation(a, b, best, "recording long, v double, lag long")
    return found.groupBy("recording").agg(F.max_by("lag", F.struct("v", -F.abs("lag"), -F.col("lag"))).alias("lag"))


def null_test(a: DataFrame, b: DataFrame, most: int = 0, align: bool = True, match: bool = True, silent_db: float = -120.0) -> DataFrame:
    """Align each pair of recordings, match gain, subtract: lag, gain, level of ``b`` against ``a``, polarity, frames, residual, its peak and where it is, bit identity and a verdict.

    What is subtracted is the ``b`` that fits best; the level (``gain_db``) is the share of ``a`` that ``b`` holds.  Pairs that don't overlap once aligned are left out."""
    found = lags(a, b, most) if align else a.select("recording").distinct().withColumn("lag", F.lit(0).cast("long"))
    j = a.select("recording", "n", "x").join(found, "recording").withColumn("at", F.col("n") + F.col("lag"))
    j = j.join(b.select("recording", F.col("n").alias("at"), F.col("x").alias("y")), ["recording", "at"])
    t = j.groupBy("recording", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("frames"), F.min((F.col("x") == F.col("y")).cast("int")).alias("same"))
    gain = F.when((F.col("yy") > 0) & F.lit(match), F.col("xy") / F.col("yy")).otherwise(1.0)
    ends = lambda df, name: df.groupBy("recording").agg((F.max("n") + 1).alias(name))
    lengths = ends(a, "_a").join(ends(b, "_b"), "recording")
    whole = (F.col("same") == 1) & (F.col("lag") == 0) & (F.col("_a") == F.col("_b"))
    level = F.when((F.col("xx") > 0) & (F.col("xy") != 0), db(F.abs(F.col("xy") / F.col("xx")))).otherwise(FLOOR_DB)
    t = t.join(lengths, "recording").select("recording", "lag", "frames", "xx", "yy", gain.alias("gain"), level.alias("gain_db"), (F.col("xy") < 0).alias("inverted"), whole.alias("identical"))
    left = F.col("x") - F.col("gain") * F.col("y")
    e = j.drop("lag").join(t, "recording").groupBy("recording", "lag", "gain", "gain_db", "inverted", "frames", "xx", "yy", "identical").agg(F.sum(left * left).alias("left"), F.max(F.abs(left)).alias("most"), F.max_by("n", F.struct(F.abs(left), -F.col("n"))).alias("worst_n"))
    level = F.when(F.col("xx") > 0, db(F.col("left") / F.col("xx"), 10.0)).otherwise(-200.0)
    verdict = F.when(F.col("identical"), "identical").when((level <= silent_db) & ((F.col("xx") > 0) | (F.col("yy") == 0)), "null").otherwise("different")
    return e.select("recording", "lag", "gain", "gain_db", "inverted", "frames", level.alias("residual_db"), db(F.col("most")).alias("peak_residual_db"), "worst_n", "identical", verdict.alias("verdict"))


def residual_samples(a: DataFrame, b: DataFrame, tested: DataFrame) -> DataFrame:
    """``recording, channel, n, x``: as channel 0 the part of ``a`` that was compared, from 0 on, and as channel 1 what the subtraction of ``null_test`` left of it."""
    j = a.select("recording", "n", "x").join(tested.select("recording", "lag", "gain"), "recording").withColumn("at", F.col("n") + F.col("lag"))
    j = j.join(b.select("recording", F.col("n").alias("at"), F.col("x").alias("y")), ["recording", "at"])
    first = F.greatest(F.lit(0), -F.col("lag"))
    return j.select("recording", (F.col("n") - first).alias("n"), F.posexplode(F.array(F.col("x"), F.col("x") - F.col("gain") * F.col("y"))).alias("channel", "x"))


def schroeder(impulse: DataFrame) -> DataFrame:
    """Energy that is left from each sample on, in dB of the whole, per recording; sums go over blocks, then within them."""
    e = F.col("x") * F.col("x")
    whole = impulse.groupBy("recording").agg(F.sum(e).alias("all"))
    t = remaining(impulse.select("recording", "n", "x"), e).join(whole, "recording")
    return t.select("recording", "n", F.when(F.col("all") > 0, db(F.col("left") / F.col("all"), 10.0)).alias("level_db"))


def decay_time(curve: DataFrame, rate: float, top: float, bottom: float) -> DataFrame:
    """Seconds for 60 dB by the straight line through the part of the curve between two levels; null without range."""
    part = curve.filter((F.col("level_db") <= top) & (F.col("level_db") >= bottom))
    n, x, y = F.count("*"), F.col("n") / rate, F.col("level_db")
    slope = (n * F.sum(x * y) - F.sum(x) * F.sum(y)) / F.nullif(n * F.sum(x * x) - F.sum(x) * F.sum(x), F.lit(0.0))
    by = part.groupBy("recording").agg(slope.alias("slope"), F.min("level_db").alias("lowest"))
    return by.select("recording", F.when(F.col("slope") < 0, -60 / F.col("slope")).alias("seconds"))


def clarity(impulse: DataFrame, rate: float) -> DataFrame:
    """C50, C80, D50 and centre time from energy splits.

    As in IEEE arithmetic, a recording without late energy has a clarity of plus infinity, one without early energy of minus infinity, and a silent one no number (NaN)."""
    e = F.col("x") * F.col("x")
    before = lambda ms: F.sum(F.when(F.col("n") < int(rate * ms / 1000), e).otherwise(0.0))
    t = impulse.groupBy("recording").agg(before(50).alias("e50"), before(80).alias("e80"), F.sum(e).alias("all"), F.sum(e * F.col("n") / rate).alias("moment"))
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))

    def clear(k):
        early, late = F.col(k), F.col("all") - F.col(k)
        return F.when((early > 0) & (late > 0), 10 * F.log10(early / late)).when(early > 0, inf).when(late > 0, -inf).when(F.col("all") == 0, nan)

    share = lambda k: F.when(F.col("all") == 0, nan).otherwise(F.try_divide(k, "all"))
    return t.select("recording", *(clear(k).alias(f"c{k[1:]}_db") for k in ("e50", "e80")), share("e50").alias("d50"), share("moment").alias("centre_time"))


def yin(x: np.ndarray, rate: float, low: float = 50.0, high: float = 1000.0, threshold: float = 0.15) -> tuple[float, float, bool]:
    """Pitch, confidence and whether it is voiced: the first dip below the threshold, followed to its bottom, from lag 1 on."""
    longest = min(int(rate / low) + 1, len(x) // 2)
    if longest < 3:
        return 0.0, 0.0, False
    w = len(x) - longest
    d = np.array([np.cumsum(((x[:w] - x[k : k + w]) ** 2)[::-1])[-1] for k in range(longest + 1)])  # one by one from the last, as the SQL's join brings them: ties in a rounded confidence hang on it
    total = np.cumsum(d[1:])
    norm = np.ones(longest + 1)
    norm[1:] = np.where(total > 0, d[1:] * np.arange(1, longest + 1) / np.where(total > 0, total, 1), 1)
    below = np.flatnonzero(norm[1:] < threshold)
    if not len(below):
        return 0.0, float(max(0.0, 1 - norm[1:].min())), False
    k = int(below[0]) + 1
    while k + 1 <= longest and norm[k + 1] < norm[k]:
        k += 1
    lag = float(k)
    if 1 <= k < longest:
        a, b, c = norm[k - 1], norm[k], norm[k + 1]
        if a - 2 * b + c > 0:
            lag = k + 0.5 * (a - c) / (a - 2 * b + c)
    hz = rate / lag
    voiced = low <= hz <= high
    return (hz if voiced else 0.0), float(max(0.0, min(1.0, 1 - norm[k]))), voiced


def track_pitch(frames: DataFrame, rate: float, hop: int, **settings) -> DataFrame:
    """``recording, frame, seconds, hz, confidence, voiced`` of ``frames(recording, frame, samples)``."""

    def run(batches):
        for pdf in batches:
            got = [yin(np.asarray(s, float), rate, **settings) for s in pdf["samples"]]
            yield pd.DataFrame({"recording": pdf["recording"], "frame": pdf["frame"], "seconds": [(f * hop + len(s) / 2) / rate for f, s in zip(pdf["frame"], pdf["samples"])], "hz": [g[0] if g[2] else None for g in got], "confidence": [g[1] for g in got], "voiced": [g[2] for g in got]})

    return frames.select("recording", "frame", "samples").mapInPandas(run, "recording long, frame long, seconds double, hz double, confidence double, voiced boolean")


def pitch_summary(points: DataFrame) -> DataFrame:
    """``recording, median_hz, lowest_hz, highest_hz, voiced_fraction, frames``; the median is the upper one, by rank."""
    w = Window.partitionBy("recording").orderBy("hz")
    ranked = points.filter("voiced").withColumn("k", F.row_number().over(w) - 1).withColumn("c", F.count("*").over(Window.partitionBy("recording")))
    tops = ranked.groupBy("recording").agg(F.max(F.when(F.col("k") == F.floor(F.col("c") / 2), F.col("hz"))).alias("median_hz"), F.min("hz").alias("lowest_hz"), F.max("hz").alias("highest_hz"))
    return points.groupBy("recording").agg(F.avg(F.col("voiced").cast("int")).alias("voiced_fraction"), F.count("*").alias("frames")).join(tops, "recording", "left").select("recording", "median_hz", "lowest_hz", "highest_hz", "voiced_fraction", "frames")


def tempo(envelope: np.ndarray, frame_rate: float, low: float = 60.0, high: float = 200.0) -> dict:
    """Beats per minute of an onset envelope: concentration, autocorrelation under a log-Gaussian prior, then a beat grid by phase and least squares."""
    none = {"valid": False, "bpm": None, "confidence": 0.0, "beats": []}
    e = np.asarray(envelope, float)
    if len(e) < 8 or e.sum() <= 0:
        return none
    top = np.sort(e)[::-1][: max(1, len(e) // 10)].sum() / e.sum()
    if top < 0.55:
        return none
    lags = np.arange(max(1, int(frame_rate * 60 / high)), min(len(e) // 4, int(np.ceil(frame_rate * 60 / low))) + 1)
    if len(lags) < 3:
        return none
    soft = np.convolve(e, [0.25, 0.5, 0.25], "same")  # periods that fall between frames keep their peak
    zero = float(soft @ soft) / len(e)
    r = np.array([float(soft[:-k] @ soft[k:]) / (len(e) - k) for k in lags]) / zero
    prior = np.exp(-0.5 * (np.log2(frame_rate * 60 / lags / np.sqrt(low * high)) / 0.9) ** 2)
    i = int(np.argmax(r * prior))
    if r[i] < 0.15:
        return none | {"confidence": float(max(r[i], 0))}
    lag = float(lags[i])
    if 0 < i < len(lags) - 1 and r[i - 1] - 2 * r[i] + r[i + 1] < 0:
        shift = 0.5 * (r[i - 1] - r[i + 1]) / (r[i - 1] - 2 * r[i] + r[i + 1])
        lag += shift if abs(shift) <= 1 else 0.0  # the prior can choose a lag beside a peak, where the parabola leads far away
    at = lambda p: np.interp(p, np.arange(len(e)), e)
    phase = max(np.arange(0, lag, 0.125), key=lambda p: at(np.arange(p, len(e), lag)).sum())
    for _ in range(2):
        k = np.arange(int((len(e) - 1 - phase) / lag) + 1)
        peaks, weight = [], []
        for p in phase + k * lag:
            a, b = max(0, int(p - 0.25 * lag)), min(len(e), int(p + 0.25 * lag) + 1)
            peaks.append(a + int(np.argmax(e[a:b])) if b > a else p)
            weight.append(e[a:b].max() if b > a else 0.0)
        w, y = np.array(weight), np.array(peaks, float)
        near = np.abs(y - (phase + k * lag)) <= 0.25 * lag
        w = w * near
        if (w > 0).sum() < 2:
            return none
        mk, my = (w @ k) / w.sum(), (w @ y) / w.sum()
        spread = w @ (k - mk) ** 2
        fitted = float((w * (k - mk)) @ (y - my) / spread) if spread > 0 else 0.0
        if abs(fitted - lag) < 0.1 * lag:  # beyond a tenth the fit has locked on to something else
            lag, phase = fitted, float(my - fitted * mk)
        phase = phase % lag if phase < 0 else phase
    beats = np.arange(phase, len(e), lag)
    return {"valid": len(beats) >= 2, "bpm": 60 * frame_rate / lag, "confidence": float(r[i]), "beats": (beats / frame_rate).tolist()}


def track_tempo(onsets: DataFrame, frame_rate: float, **settings) -> DataFrame:
    """``recording, valid, bpm, confidence, beats`` of ``onsets(recording, frame, onset)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = tempo(pdf.sort_values("frame")["onset"].to_numpy(), frame_rate, **settings)
        return pd.DataFrame({"recording": [pdf["recording"].iloc[0]], **{k: [v] for k, v in got.items()}})

    return onsets.groupBy("recording").applyInPandas(run, "recording long, valid boolean, bpm double, confidence double, beats array<double>")


def convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = 1 << int(len(a) + len(b)).bit_length()
    return np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[: len(a) + len(b) - 1]


def deconvolve(recorded: DataFrame, sweep: np.ndarray, rate: float, start: float, end: float, keep: int = 0, size: int = BLOCK) -> DataFrame:
    """``recording, channel, n, x``: impulse responses from recorded exponential sweeps, as long as the recordings (or ``keep`` frames); shorter recordings than the sweep give none.

    The inverse filter is the reversed sweep whose level falls with frequency, peak-normalised through itself.  A block sees as many samples ahead as the filter is long,
    so every task convolves its own block."""
    t = np.arange(len(sweep)) / rate
    inverse = sweep[::-1] * np.exp(-t * np.log(end / start) / (len(sweep) / rate))
    inverse = inverse / np.abs(convolve(sweep, inverse)).max()
    size = max(size, 1 << (len(sweep) - 1).bit_length())
    whole = recorded.groupBy("recording", "channel").agg(F.max("n").alias("_last")).filter(F.col("_last") + 1 >= len(sweep)).select("recording", F.col("channel").cast("int").alias("channel"))
    own = beside(pack(recorded, size, 0, len(sweep) - 1), whole, ["recording", "channel"], "left_semi")
    out = map_blocks(own, lambda xs, lo, hi, at: convolve(xs[lo:], inverse)[len(sweep) - 1 : len(sweep) - 1 + hi - lo])
    return out.filter(F.col("n") < keep) if keep else out


def peak_to_tail(impulse: DataFrame) -> DataFrame:
    """``recording, channel, frames, peak_db``: how far the peak stands above the last tenth of an impulse response; null for silence."""
    ends = impulse.groupBy("recording", "channel").agg((F.max("n") + 1).alias("frames"), F.max(F.abs("x")).alias("peak"))
    tail = beside(impulse, ends.select("recording", "channel", "frames"), ["recording", "channel"], by="n").filter(F.col("n") >= F.col("frames") - F.floor(F.col("frames") / 10))
    rms = tail.groupBy("recording", "channel").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return ends.join(rms, ["recording", "channel"], "left").select("recording", "channel", "frames", F.when((F.col("peak") > 0) & (F.col("rms") > 0), db(F.col("peak") / F.col("rms"))).alias("peak_db"))


def concentration(onsets: DataFrame) -> DataFrame:
    """``recording, concentration``: the share of all rise that the highest tenth of frames holds."""
    w = Window.partitionBy("recording")
    o = onsets.withColumn("k", F.row_number().over(w.orderBy(F.desc("onset"), "frame"))).withColumn("c", F.count("*").over(w))
    top = F.sum(F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("c") / 10)), F.col("onset")))
    return o.groupBy("recording").agg(top.alias("t"), F.sum("onset").alias("s")).filter("s > 0").select("recording", (F.col("t") / F.col("s")).alias("concentration"))


def weighted_fit(points: DataFrame) -> DataFrame:
    """``recording, period, phase``: ``at = phase + period * k`` by weighted least squares."""
    w, k, y = F.col("weight"), F.col("k"), F.col("at")
    means = points.groupBy("recording").agg((F.sum(w * k) / F.nullif(F.sum(w), F.lit(0.0))).alias("mk"), (F.sum(w * y) / F.nullif(F.sum(w), F.lit(0.0))).alias("my")).filter("mk IS NOT NULL")
    j = points.join(means, "recording")
    dk = k - F.col("mk")
    t = j.groupBy("recording", "mk", "my").agg((F.sum(w * dk * (y - F.col("my"))) / F.nullif(F.sum(w * dk * dk), F.lit(0.0))).alias("period"))
    return t.select("recording", "period", (F.col("my") - F.col("mk") * F.col("period")).alias("phase"))


def inverse_sweep(sweep: DataFrame, frames: int, rate: float, start: float, end: float) -> DataFrame:
    """The reversed sweep whose level falls with frequency; ``deconvolve`` scales it by its own convolution."""
    t = (F.lit(frames - 1) - F.col("n")) / rate
    return sweep.select((F.lit(frames - 1) - F.col("n")).alias("n"), (F.col("x") * F.exp(-t * float(np.log(end / start)) / (frames / rate))).alias("x"))
