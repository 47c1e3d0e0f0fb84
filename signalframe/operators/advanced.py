"""Operators composed of filters, spectra and dynamics: multiband, de-esser, pitch-shift, heal, exact peaks, dither, contour."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FLOOR_DB, db
from .blocks import BLOCK, map_blocks, pack
from .filters import _db, _per_channel, _with_run_up, band_layout, butterworth, compression_curve, follow, resample, split_bank, sub_peaks
from .loudness import run_sections
from .room import room
from .repair import istft, stft, stretch


def split_bands(x: np.ndarray, rate: float, crossovers: list[float]) -> list[np.ndarray]:
    """Linkwitz-Riley (order 4) bands whose sum has a flat magnitude: lower bands pass the later crossovers' all-pass sums."""
    low = lambda y, f: run_sections(y, butterworth("low_pass", rate, f, 2) * 2)
    high = lambda y, f: run_sections(y, butterworth("high_pass", rate, f, 2) * 2)
    out, rest = [], np.asarray(x, float)
    for f in crossovers:
        out = [low(b, f) + high(b, f) for b in out]
        out.append(low(rest, f))
        rest = high(rest, f)
    return [*out, rest]


def multiband_compress(samples: DataFrame, rate: float, crossovers: tuple[float, ...] = (200.0, 2000.0, 8000.0), threshold: float = -20.0, ratio: float = 3.0, attack: float = 0.01, release: float = 0.1, bypass: bool = False, solo: int | None = None) -> DataFrame:
    """Each band compressed by itself; bypassed bands still add up flat; ``solo`` lets one band alone be heard."""
    used = [f for f in crossovers if f < rate / 2]
    if solo is not None and not 0 <= solo <= len(used):
        raise ValueError("there is no such band")

    def run(x):
        total = np.zeros(len(x))
        for k, band in enumerate(split_bands(x, rate, used)):
            if solo is None or solo == k:
                gain = 1.0 if bypass else 10 ** (-follow(compression_curve(_db(np.abs(band)), threshold, ratio), attack, release, rate) / 20)
                total += band * gain
        return total

    return _with_run_up(samples, rate, (attack, release, *(1 / f for f in used)), run)


def _deess_cut(high, rate, threshold, ratio, most):
    return np.minimum(follow(compression_curve(_db(np.abs(high)), threshold, ratio), 0.001, 0.05, rate), most)


def deess(samples: DataFrame, rate: float, hz: float = 5000.0, threshold: float = -30.0, ratio: float = 4.0, most: float = 12.0) -> DataFrame:
    """The band above ``hz`` compressed by at most ``most`` dB."""

    def run(x):
        low, high = split_bands(x, rate, [hz])
        return low + high * 10 ** (-_deess_cut(high, rate, threshold, ratio, most) / 20)

    return _with_run_up(samples, rate, (0.05, 1 / hz), run)


def deess_report(samples: DataFrame, rate: float, hz: float = 5000.0, threshold: float = -30.0, ratio: float = 4.0, most: float = 12.0) -> DataFrame:
    """``recording, channel, fraction, most_db``: the share of samples that were cut by more than 1 dB, and the deepest cut."""
    cuts = _with_run_up(samples, rate, (0.05, 1 / hz), lambda x: _deess_cut(split_bands(x, rate, [hz])[1], rate, threshold, ratio, most))
    return cuts.groupBy("recording", "channel").agg(F.avg((F.col("x") > 1).cast("double")).alias("fraction"), F.max("x").alias("most_db"))


def pitch_shift(samples: DataFrame, rate: float, semitones: float, size: int = 2048, hop: int = 256) -> DataFrame:
    """Stretch by the interval, then resample back to the length."""
    if not -36 <= semitones <= 36:
        raise ValueError("at most 36 semitones either way")
    factor = 2 ** (semitones / 12)
    return resample(stretch(samples, factor, size, hop), rate * factor, rate)


def exact_peak(x: np.ndarray, factor: int = 16, block: int = 4096) -> float:
    """Peak between samples by zero-padded transforms of half-overlapping blocks, without their outer sixteenths; short signals give the sample peak."""
    x = np.asarray(x, float)
    if len(x) < block:
        return float(np.abs(x).max(initial=0.0))
    hop = block // 2
    padded = np.concatenate([np.zeros(hop), x, np.zeros(block)])
    return max(float(np.abs(x).max()), _between(padded, range(0, len(x) + hop, hop), factor, block))


def _between(x: np.ndarray, starts, factor: int, block: int) -> float:
    edge, most = block // 16, 0.0
    for s in starts:
        up = np.fft.irfft(np.fft.rfft(x[s : s + block]), block * factor) * factor
        most = max(most, float(np.abs(up[edge * factor : -edge * factor]).max()))
    return most


def exact_true_peak(samples: DataFrame, factor: int = 16, block: int = 4096) -> DataFrame:
    """``recording, channel, true_peak``: each block of samples transforms the windows that begin in it."""
    hop = block // 2
    frames = samples.groupBy("recording", "channel").agg(F.count("*").alias("frames"))

    def run(xs, lo, hi, start, frames):
        most = float(np.abs(xs[lo:hi]).max())
        if frames >= block:
            first = start + lo - hop  # windows begin half a window before their block's samples
            padded = np.concatenate([np.zeros(max(0, start - first)), xs, np.zeros(2 * block)])
            shift = min(start, first)
            last = frames + hop if start + hi >= frames else start + hi
            most = max(most, _between(padded, range(first - shift, last - hop - shift, hop), factor, block))
        return {"true_peak": pa.array([most])}

    packed = pack(samples, BLOCK, hop, block).join(frames, ["recording", "channel"])
    return map_blocks(packed, run, "recording long, channel int, true_peak double", "frames").groupBy("recording", "channel").agg(F.max("true_peak").alias("true_peak"))


def heal(samples: DataFrame, rate: float, t0: float, t1: float, f0: float, f1: float, size: int = 1024, hop: int = 256) -> DataFrame:
    """A time-frequency region is filled from the frames before and after it: magnitudes in a straight line, phases carried on.

    Only the region and two windows around it go through a group; all other samples pass by."""
    low = max(0, int(t0 * rate) - 3 * size) // hop * hop
    high = (int(t1 * rate) + 3 * size) // hop * hop

    def run(x):
        spec = stft(x, size, hop)
        t = (np.arange(len(spec)) * hop - (size - hop) + size / 2 + low) / rate
        rows = np.flatnonzero((t >= t0) & (t <= t1))
        cols = np.flatnonzero((np.arange(spec.shape[1]) * rate / size >= f0) & (np.arange(spec.shape[1]) * rate / size <= f1))
        if not len(rows) or not len(cols) or rows[0] == 0 or rows[-1] + 1 >= len(spec):
            return x
        a, b = np.abs(spec[rows[0] - 1, cols]), np.abs(spec[rows[-1] + 1, cols])
        phase = np.angle(spec[rows[0] - 1, cols])
        for k, r in enumerate(rows):
            phase = phase + 2 * np.pi * hop * cols / size
            w = (k + 1) / (len(rows) + 1)
            spec[r, cols] = (a * (1 - w) + b * w) * np.exp(1j * phase)
        out, edge = x.copy(), size if low else 0  # near the cut edges what was there stays
        healed = istft(spec, size, hop, len(x))
        out[edge : len(x) - size] = healed[edge : len(x) - size]
        return out

    near = (F.col("n") >= low) & (F.col("n") < high)
    rest = samples.filter(~near).select("recording", F.col("channel").cast("int").alias("channel"), "n", "x")
    return _per_channel(samples.filter(near), run).unionByName(rest)


# The generator's first state, its shifts and its multiplier.
SEED, SHIFTS, SCRAMBLE = 0x5EED5EED5EED5EED, (12, 25, 27), 0x2545F4914F6CDD1D
U64 = np.uint64


def _turn(s: np.ndarray) -> np.ndarray:
    a, b, c = (U64(v) for v in SHIFTS)
    s = s ^ (s >> a)
    s = s ^ (s << b)
    return s ^ (s >> c)


def _times(columns: np.ndarray, s: np.ndarray) -> np.ndarray:
    """States by a matrix of bits, whose columns are where each single bit goes."""
    out = np.zeros_like(s)
    for i in range(64):
        out ^= np.where((s >> U64(i)) & U64(1) == 1, columns[i], U64(0))
    return out


@lru_cache(maxsize=8)
def _jumps(top: int = 48) -> list[np.ndarray]:
    """The turns by 1, 2, 4, ... steps: the generator is linear over bits, so any place of its sequence can be jumped to."""
    out = [_turn(U64(1) << np.arange(64, dtype=U64))]
    for _ in range(top):
        out.append(_times(out[-1], out[-1]))
    return out


def uniforms(first: int, count: int, seed: int = SEED, lane: int = 512) -> np.ndarray:
    """Draws ``first`` to ``first + count`` of the seeded sequence, centred on 0, without those before."""
    jumps = _jumps()
    state = np.array([seed or 0x9E3779B97F4A7C15], U64)
    for k in range(48):
        if first >> k & 1:
            state = _times(jumps[k], state)
    starts, step = state, lane
    while len(starts) * lane < count:  # lanes side by side, doubled by jumps
        starts = np.concatenate([starts, _times(jumps[step.bit_length() - 1], starts)])
        step *= 2
    out = np.empty((lane, len(starts)), U64)
    for i in range(lane):
        starts = _turn(starts)
        out[i] = starts * U64(SCRAMBLE)
    return (out.T.ravel()[:count] >> U64(11)).astype(np.float64) / 9007199254740992.0 - 0.5


def dither(samples: DataFrame, bits: int = 16, shaped: bool = False, seed: int = SEED, channels: int = 2) -> DataFrame:
    """Triangular dither (with two-tap error feedback if shaped) and rounding to the codes of ``bits``; the same seed gives the same samples.

    Each frame draws two uniforms for each channel in turn, so channels and recordings differ as the sequence does.  Flat dither
    jumps to each block's draws; the feedback of shaped dither makes a channel one group."""
    if not 2 <= bits <= 32:
        raise ValueError("between 2 and 32 bits")
    step = 2.0 ** (1 - bits)

    def noise(start, n, channel):
        u = uniforms(2 * channels * start, 2 * channels * n, seed).reshape(n, channels, 2)
        return u[:, channel].sum(1) * step

    def code(v):
        return np.clip(np.sign(v) * np.floor(np.abs(v) / step + 0.5) * step, -1, 1)

    if not shaped:
        return map_blocks(pack(samples, BLOCK), lambda xs, lo, hi, start, channel: code(xs + noise(start, len(xs), channel)), None, "channel")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        e1 = e2 = 0.0
        out = np.empty(len(pdf))
        for i, (v, d) in enumerate(zip(pdf["x"].tolist(), noise(0, len(pdf), int(pdf["channel"].iloc[0])).tolist())):
            got = v - (2 * e1 - e2) + d
            scaled = got / step
            e1, e2 = np.sign(scaled) * np.floor(abs(scaled) + 0.5) * step - got, e1
            out[i] = got
        return pd.DataFrame({"recording": pdf["recording"], "channel": pdf["channel"], "n": pdf["n"], "x": code(out)})

    return samples.select("recording", "channel", "n", "x").groupBy("recording", "channel").applyInPandas(run, "recording long, channel int, n long, x double")


def contour(points: DataFrame, samples: DataFrame, rate: float) -> DataFrame:
    """Loudness at each whole sub-block: momentary and short-term, the true peak and PSR of the last 3 s, and the crest of the last 400 ms (0 for silence).

    True peak and PSR are null where short-term loudness is; PSR also where either lies at the floor."""
    size = int(rate / 10)
    by = samples.groupBy("recording", F.floor(F.col("n") / size).cast("long").alias("sub")).agg(F.max(F.abs("x")).alias("peak"), F.avg(F.col("x") * F.col("x")).alias("ms"))
    w = Window.partitionBy("recording").orderBy("sub")
    j = points.join(by, ["recording", "sub"]).join(sub_peaks(samples, size), ["recording", "sub"])
    top, short, mean = F.max("true_peak").over(w.rowsBetween(-29, 0)), F.max("peak").over(w.rowsBetween(-3, 0)), F.avg("ms").over(w.rowsBetween(-3, 0))
    out = j.select(
        "recording", "sub", ((F.col("sub") + 1) / 10).alias("seconds"), "momentary", "short_term", F.when(F.col("short_term").isNotNull(), db(top)).alias("peak_db"),
        F.when(F.col("momentary").isNotNull(), F.when(mean > 0, db(short / F.sqrt(mean))).otherwise(0.0)).alias("crest_db"),
    )
    heard = (F.col("peak_db") > FLOOR_DB) & (F.col("short_term") > FLOOR_DB)
    return out.withColumn("psr_db", F.when(heard, F.col("peak_db") - F.col("short_term")))


def contour_grid(measured: DataFrame, samples: DataFrame, rate: float, interval: float) -> DataFrame:
    """``contour`` at every ``interval`` seconds from 0 to the end: what the sub-blocks that were whole by then say; nothing before the first windows are full."""
    step, size = max(1, int(interval * rate + 0.5)), int(rate / 10)
    ends = samples.groupBy("recording").agg((F.max("n") + 1).alias("frames"))
    at = ends.filter(F.col("frames") >= 4 * size).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("frames") / step))))
    sub = F.least(F.floor(F.col("k") * step / size), F.floor(F.col("frames") / size)).cast("long") - 1
    at = at.select("recording", (F.col("k") * step / rate).alias("seconds"), sub.alias("sub"))
    return at.join(measured.drop("seconds"), ["recording", "sub"], "left").drop("sub")


def contour_summary(grid: DataFrame, programme: DataFrame, peaks: DataFrame) -> DataFrame:
    """Of each recording: loudness, range, true peak and their distance; extremes and nearest-rank P10 and P95 of the emitted short-term readings above -70."""
    gated = grid.filter("short_term > -70").select("recording", "short_term")
    n = gated.groupBy("recording").agg(F.count("*").alias("n"))
    ranked = gated.withColumn("rank", F.row_number().over(Window.partitionBy("recording").orderBy("short_term")) - 1).join(n, "recording")  # a reading for each interval
    at = lambda f: F.max(F.when(F.col("rank") == F.floor((F.col("n") - 1) * f + 0.5), F.col("short_term")))
    spread = ranked.groupBy("recording").agg(F.min("short_term").alias("quietest"), F.max("short_term").alias("loudest"), at(0.10).alias("p10"), at(0.95).alias("p95"))
    top = peaks.groupBy("recording").agg(db(F.max("true_peak")).alias("peak_db"))
    points = grid.groupBy("recording").agg(F.count("*").alias("points"))
    j = points.join(programme, "recording", "left").join(top, "recording", "left").join(spread, "recording", "left")
    return j.withColumn("plr_db", F.when((F.col("peak_db") > FLOOR_DB) & (F.col("integrated") > FLOOR_DB), F.col("peak_db") - F.col("integrated")))


def room_by_band(impulse: DataFrame, rate: float, thirds: bool = False, order: int = 6) -> DataFrame:
    """Acoustics of each octave or third-octave: ``recording, centre, valid, edt, t20, t30, c50_db, ...``; a band that can't be made has an empty row.

    All bands are filtered in one pass and measured as so many recordings."""
    layout = [b for b in band_layout(rate, thirds, order)]
    first, count = layout[0]["band"], len(layout)
    split = split_bank(impulse.withColumn("channel", F.lit(0)), rate, thirds, order)
    keyed = split.select((F.col("recording") * count + F.col("band") - first).alias("recording"), "n", "x")
    measured = room(keyed, rate).select(F.floor(F.col("recording") / count).cast("long").alias("recording"), (F.pmod(F.col("recording"), F.lit(count)) + first).cast("int").alias("band"), "valid", "edt", "t20", "t30", "c50_db", "c80_db", "d50", "centre_time", "usable_range_db")
    names = impulse.sparkSession.createDataFrame([(b["band"], round(b["centre"], 6)) for b in layout], "band int, centre double")
    every = impulse.select("recording").distinct().join(F.broadcast(names))  # 31 bands
    return every.join(measured, ["recording", "band"], "left").drop("band")


__all__ = ["contour", "contour_grid", "contour_summary", "deess", "dither", "deess_report", "exact_peak", "exact_true_peak", "heal", "multiband_compress", "pitch_shift", "room_by_band", "split_bands", "uniforms"]
