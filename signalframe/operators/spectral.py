"""Spectra of frames and what is read off them: bands, chroma, key, onsets.

``mags(frame, bin, mag)`` is the long form.  Transforms take whole Arrow batches of frames through numpy; ``spectra`` and
``onsets`` cut the frames of long recordings from blocks and add up inside them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import FLOOR_DB, db  # noqa: F401
from .blocks import map_blocks, pack

# Nominal band centres and key profiles by degree from the tonic.
OCTAVES = [31.5, 63.0, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0]
THIRDS = [20.0, 25.0, 31.5, 40.0, 50.0, 63.0, 80.0, 100.0, 125.0, 160.0, 200.0, 250.0, 315.0, 400.0, 500.0, 630.0, 800.0, 1000.0, 1250.0, 1600.0, 2000.0, 2500.0, 3150.0, 4000.0, 5000.0, 6300.0, 8000.0, 10000.0, 12500.0, 16000.0, 20000.0]
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR = [6.0, 1.9, 2.6, 1.6, 3.8, 2.6, 1.6, 4.6, 1.6, 2.6, 1.9, 2.4]
MINOR = [6.0, 1.7, 2.5, 3.8, 1.7, 2.5, 1.6, 4.6, 2.5, 1.8, 2.4, 2.2]


def hann(size: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]


def dft(frames: DataFrame, size: int, windowed: bool = True) -> DataFrame:
    """``frame, bin, re, im, mag`` of ``frames(frame, samples)``: whole Arrow batches of frames are transformed at once, without a shuffle."""
    w = np.array(hann(size)) if windowed else np.ones(size)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = np.fft.rfft(part.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size) * w, axis=1)
                n = got.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "frame": pa.array(np.repeat(part.column("frame").to_numpy(), n)), "bin": pa.array(np.tile(np.arange(n), part.num_rows)),
                    "re": pa.array(got.real.ravel()), "im": pa.array(got.imag.ravel()), "mag": pa.array(np.abs(got).ravel()),
                })

    return frames.select(F.col("frame").cast("long").alias("frame"), "samples").mapInArrow(run, "frame long, bin long, re double, im double, mag double")


def average_spectrum(mags: DataFrame, size: int) -> DataFrame:
    """Mean and peak-hold magnitude of each bin in dB, scaled by 2 / coherent gain."""
    scale = 2 / sum(hann(size))
    by = mags.groupBy("bin").agg((F.avg("mag") * scale).alias("mean"), (F.max("mag") * scale).alias("peak"))
    return by.select("bin", db(F.col("mean")).alias("average_db"), db(F.col("peak")).alias("peak_db"))


def _by(df: DataFrame) -> list[str]:
    """What a measure is taken for: each recording, where there are several."""
    return ["recording"] if "recording" in df.columns else []


def _beside(df: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the one row of ``one`` for all of it or for each recording."""
    return df.join(one, by) if by else df.join(F.broadcast(one))


def band_layout(spark: SparkSession, rate: float, thirds: bool = False) -> DataFrame:
    half = 2 ** (1 / 6 if thirds else 1 / 2)
    rows = [(c, c / half, c * half) for c in (THIRDS if thirds else OCTAVES) if c * half <= rate / 2]
    return spark.createDataFrame(rows, "centre double, low double, high double")


def bands(spectrum: DataFrame, spark: SparkSession, rate: float, size: int, thirds: bool = False) -> DataFrame:
    """Band levels: bins in [low, high) add their powers, over the noise bandwidth; an empty band takes the nearest bin."""
    w, by = hann(size), _by(spectrum)
    enbw = size * sum(v * v for v in w) / sum(w) ** 2
    layout = F.broadcast(band_layout(spark, rate, thirds).withColumn("near", F.round(F.col("centre") * size / rate).cast("long")))  # at most 31 rows
    spec = spectrum.select(*by, "bin", (F.col("bin") * rate / size).alias("hz"), F.pow(F.lit(10.0), F.col("average_db") / 10).alias("p"))
    within = (F.col("hz") >= F.col("low")) & (F.col("hz") < F.col("high"))
    own = spec.join(layout, within | (F.col("bin") == F.col("near"))).groupBy(*by, "centre", "low", "high").agg(F.sum(F.when(within, F.col("p"))).alias("p"), F.max(F.when(F.col("bin") == F.col("near"), F.col("p"))).alias("one"))
    power = F.greatest(F.coalesce("p", "one", F.lit(0.0)) / enbw, F.lit(1e-30))
    return own.select(*by, "centre", "low", "high", db(power, 10.0).alias("level_db"))


def chroma(mags: DataFrame, rate: float, size: int, low: float = 65.0, high: float = 5000.0) -> DataFrame:
    """``pitch_class, weight``: magnitudes folded onto twelve classes, summing to one."""
    hz = F.col("bin") * rate / size
    note = F.round(69 + 12 * F.log2(hz / 440.0)).cast("int")
    keys = _by(mags)
    by = mags.filter((F.col("bin") > 0) & (hz >= low) & (hz <= high)).groupBy(*keys, F.pmod(note, F.lit(12)).alias("pitch_class")).agg(F.sum("mag").alias("m"))
    total = by.groupBy(*keys).agg(F.sum("m").alias("t"))
    return _beside(by, total, keys).select(*keys, "pitch_class", F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0).alias("weight"))


def key_scores(spark: SparkSession, folded: DataFrame) -> DataFrame:
    """Pearson correlation of the chroma with each of 24 rotated profiles (twelve rows against 288 fixed ones)."""
    rows = [(tonic, m, NAMES[tonic] + (" major" if m == 0 else " minor"), d, (MAJOR, MINOR)[m][(d - tonic) % 12]) for tonic in range(12) for m in (0, 1) for d in range(12)]
    profile = spark.createDataFrame(rows, "tonic int, mode int, name string, pitch_class int, p double")
    j = profile.join(folded, "pitch_class", "left").withColumn("c", F.coalesce("weight", F.lit(0.0)))
    n = 12.0
    s = j.groupBy("tonic", "mode", "name").agg(F.sum("p").alias("sp"), F.sum("c").alias("sc"), F.sum(F.col("p") * F.col("c")).alias("spc"), F.sum(F.col("p") * F.col("p")).alias("spp"), F.sum(F.col("c") * F.col("c")).alias("scc"))
    top, bottom = F.col("spc") - F.col("sp") * F.col("sc") / n, (F.col("spp") - F.col("sp") * F.col("sp") / n) * (F.col("scc") - F.col("sc") * F.col("sc") / n)
    return s.select("tonic", "mode", "name", F.when(bottom > 1e-30, top / F.sqrt(bottom)).otherwise(0.0).alias("fit"))


def best_key(scores: DataFrame) -> DataFrame:
    """The best key and the runner-up; ties keep the earlier tonic, major before minor."""
    w = Window.orderBy(F.desc(F.round("fit", 9)), "tonic", "mode")  # 24 rows
    r = scores.withColumn("rank", F.row_number().over(w))
    return r.agg(F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("key"), F.max(F.when(F.col("rank") == 1, F.col("fit"))).alias("fit"), F.max(F.when(F.col("rank") == 2, F.col("name"))).alias("runner_up"), (F.max(F.when(F.col("rank") == 1, F.col("fit"))) - F.max(F.when(F.col("rank") == 2, F.col("fit")))).alias("margin"))


def onset_envelope(mags: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Half-wave rectified rise of compressed magnitudes between frames; the first frame is 0."""
    top = mags.withColumn("top", F.max("mag").over(Window.partitionBy("frame")))
    level = F.log1p(1000 * F.greatest(F.col("mag"), floor * F.col("top")))
    prev = F.lag("v").over(Window.partitionBy("bin").orderBy("frame"))
    rise = top.withColumn("v", level).withColumn("rise", F.greatest(F.lit(0.0), F.col("v") - prev))
    return rise.groupBy("frame").agg(F.coalesce(F.sum("rise"), F.lit(0.0)).alias("onset"))


def quantised(mags: DataFrame, size: int, low: float = -120.0, high: float = 0.0) -> DataFrame:
    """Eight-bit log magnitude, reference half the coherent gain."""
    ref = sum(hann(size)) / 2
    level = 20 * F.log10(F.greatest(F.col("mag") / ref, F.lit(1e-12)))
    return mags.select("frame", "bin", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - low) / (high - low))) * 255 + 0.5).cast("int").alias("q"))


def noise_profile(mags: DataFrame) -> DataFrame:
    return mags.groupBy("bin").agg(F.avg("mag").alias("noise"))


def denoise_gain(mags: DataFrame, profile: DataFrame, over: float = 1.5, reduction_db: float = 12.0) -> DataFrame:
    """Wiener-like gain of each bin with over-subtraction and a floor, before smoothing."""
    j = mags.join(profile, "bin")
    p, n = F.col("mag") * F.col("mag"), F.pow(F.col("noise") * over, 2)
    s = F.greatest(F.lit(0.0), p - n)
    gain = F.when(s + n > 0, s / (s + n)).otherwise(1.0)
    return j.select("frame", "bin", F.greatest(gain, F.lit(10 ** (-reduction_db / 20))).alias("gain"))


def provenance(spectrum: DataFrame, rate: float, size: int, per_octave: int = 16, floor_hz: float = 500.0, drop_db: float = 35.0) -> DataFrame:
    """Where a spectrum ends: the last of the log-spaced steps above max - drop, the fall over the next quarter octave, and whether it is steep."""
    step, by = F.floor(F.log2(F.col("bin") * rate / size / floor_hz) * per_octave).cast("long"), _by(spectrum)
    steps = spectrum.filter((F.col("bin") > 0) & (F.col("bin") * rate / size >= floor_hz)).groupBy(*by, step.alias("step")).agg(F.avg("average_db").alias("level"))
    top = steps.groupBy(*by).agg((F.max("level") - drop_db).alias("least"))
    last = _beside(steps, top, by).filter("level >= least").groupBy(*by).agg(F.max("step").alias("last"))
    j = _beside(steps, last, by)
    before = F.max(F.when(F.col("step") == F.col("last"), F.col("level")))
    after = F.max(F.when(F.col("step") == F.col("last") + per_octave // 4, F.col("level")))
    return j.groupBy(*by).agg((floor_hz * F.pow(F.lit(2.0), (F.max("last") + 1) / per_octave)).alias("cutoff_hz"), (before - after).alias("drop_db")).withColumn("steep", F.coalesce(F.col("drop_db") >= drop_db, F.lit(False)))


def smooth_gain(gains: DataFrame, keep: float = 0.55, span: int = 96) -> DataFrame:
    """``frame, bin, gain``: the mean of three bins (edges shortened), then exponential smoothing over frames from 1.

    What is older than ``span`` frames has a weight below 1e-24, so a window of so many frames stands for all."""
    near = F.avg("gain").over(Window.partitionBy("frame").orderBy("bin").rowsBetween(-1, 1))
    w = Window.partitionBy("bin").orderBy("frame")
    g = gains.select("frame", "bin", near.alias("g"))
    past = F.collect_list("g").over(w.rowsBetween(1 - span, 0))
    rank = F.row_number().over(w)
    start = F.when(rank <= span, F.lit(1.0)).otherwise(F.lit(0.0))
    return g.select("frame", "bin", F.aggregate(past, start, lambda s, v: keep * s + (1 - keep) * v).alias("gain"))


def late_gain(mags: DataFrame, delay: int, share: float, floor_db: float = -400.0) -> DataFrame:
    """Gain that takes away a share of each bin's energy of ``delay`` frames before (none before the first)."""
    p = F.col("mag") * F.col("mag")
    late = share * F.coalesce(F.lag(p, delay).over(Window.partitionBy("bin").orderBy("frame")), F.lit(0.0))
    gain = F.sqrt(F.greatest(F.lit(0.0), p - late) / F.greatest(p, F.lit(1e-30)))
    return mags.select("frame", "bin", F.greatest(gain, F.lit(10 ** (floor_db / 20))).alias("gain"))


def tuning(mags: DataFrame, rate: float, size: int, low: float = 65.0, high: float = 5000.0) -> DataFrame:
    """``tuning_cents``: the circular mean of how far magnitudes lie from equal temperament at A = 440."""
    hz = F.col("bin") * rate / size
    s = 69 + 12 * F.log2(hz / 440.0)
    turn = 2 * math.pi * (s - F.round(s))
    keys = _by(mags)
    by = mags.filter((F.col("bin") > 0) & (hz >= low) & (hz <= high)).groupBy(*keys).agg(F.sum(F.col("mag") * F.sin(turn)).alias("y"), F.sum(F.col("mag") * F.cos(turn)).alias("x"))
    return by.select(*keys, (F.atan2("y", "x") * 100 / (2 * math.pi)).alias("tuning_cents"))


def key(spark: SparkSession, mags: DataFrame, rate: float, size: int) -> DataFrame:
    """One row for each recording: chroma of twelve, key with tonic and mode, fit, margin, runner-up, contrast of the chroma, strength, tuning and whether it is worth naming."""
    by = _by(mags)
    folded = chroma(mags, rate, size).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("pitch_class", "weight"))).alias("m"))  # twelve entries
    folded = folded.select(*by, F.array(*(F.coalesce(F.try_element_at("m", F.lit(d)), F.lit(0.0)) for d in range(12))).alias("chroma"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    c = F.col("chroma")
    own = folded.withColumn("mean", total(c) / 12).withColumn("off", F.transform(c, lambda v: v - F.col("mean"))).withColumn("power", total(F.transform("off", lambda v: v * v)))
    profiles = [(t, mode, [(MAJOR, MINOR)[mode][(d - t) % 12] for d in range(12)]) for t in range(12) for mode in (0, 1)]

    def fit(p):
        off = [v - sum(p) / 12 for v in p]
        bottom = F.col("power") * sum(v * v for v in off)
        return F.when(bottom > 1e-30, sum((F.get("off", F.lit(d)) * off[d] for d in range(12)), F.lit(0.0)) / F.sqrt(bottom)).otherwise(0.0)

    ranked = F.array_sort(F.array(*(F.struct((-F.round(fit(p), 9)).alias("k"), F.lit(t).alias("tonic"), F.lit(mode).alias("mode"), fit(p).alias("fit")) for t, mode, p in profiles)))
    own = own.withColumn("r", ranked).select(*by, "chroma", F.when(F.col("mean") > 0, F.sqrt(F.col("power") / 12) / F.col("mean")).otherwise(0.0).alias("contrast"), F.col("r")[0].alias("a"), F.col("r")[1].alias("b"))
    note, mode = lambda k: F.get(F.array(*map(F.lit, NAMES)), F.col(f"{k}.tonic")), lambda k: F.when(F.col(f"{k}.mode") == 0, "major").otherwise("minor")
    named = own.select(*by, "chroma", "contrast", note("a").alias("tonic"), mode("a").alias("mode"), F.col("a.fit").alias("fit"), (F.col("a.fit") - F.col("b.fit")).alias("margin"), F.concat_ws(" ", note("a"), mode("a")).alias("key"), F.concat_ws(" ", note("b"), mode("b")).alias("runner_up"))
    strength = F.col("fit") * F.least(F.lit(1.0), F.col("contrast"))
    return _beside(named, tuning(mags, rate, size), by).withColumn("strength", strength).withColumn("worth_naming", (F.col("contrast") >= 0.15) & (F.col("strength") >= 0.2))


def framed(xs: np.ndarray, lo: int, hi: int, start: int, size: int, hop: int) -> tuple[np.ndarray, int]:
    """(frames that begin among a block's own samples and are whole, the number of the first)."""
    first = -(-(start + lo) // hop)
    begin = first * hop - start
    last = min(hi - 1, len(xs) - size)
    if last < begin:
        return np.zeros((0, size)), first
    return np.lib.stride_tricks.sliding_window_view(xs, size)[begin : last + 1 : hop], first


def spectra(samples: DataFrame, size: int = 8192, hop: int = 4096) -> DataFrame:
    """``recording, channel, bin, mean, peak, total, frames``: magnitudes of Hann frames without padding, added up in blocks."""
    w = np.array(hann(size))

    def run(xs, lo, hi, start):
        got, _ = framed(xs, lo, hi, start, size, hop)
        mags = np.abs(np.fft.rfft(got * w, axis=1))
        n = mags.shape[1]
        return {"bin": pa.array(np.arange(n)), "total": pa.array(mags.sum(0)), "peak": pa.array(mags.max(0, initial=0.0)), "frames": pa.array(np.full(n, len(mags)))}

    parts = map_blocks(pack(samples, max(1 << 16, size) // hop * hop, 0, size), run, "recording long, channel int, bin long, total double, peak double, frames long")
    by = parts.groupBy("recording", "channel", "bin").agg(F.sum("total").alias("total"), F.max("peak").alias("peak"), F.sum("frames").alias("frames")).filter("frames > 0")
    return by.select("recording", "channel", "bin", (F.col("total") / F.col("frames")).alias("mean"), "peak", "total", "frames")


def levels(spectrum: DataFrame, size: int) -> DataFrame:
    """``bin, average_db, peak_db`` of one channel's ``spectra``."""
    scale = 2 / sum(hann(size))
    return spectrum.select(*_by(spectrum), "bin", db(F.col("mean") * scale).alias("average_db"), db(F.col("peak") * scale).alias("peak_db"))


def onsets(samples: DataFrame, size: int = 1024, hop: int = 256, floor: float = 1e-3) -> DataFrame:
    """``recording, channel, frame, onset`` over blocks that see the frame before their first."""
    w = np.array(hann(size))

    def run(xs, lo, hi, start):
        back = min(lo // hop, 1) * hop
        got, first = framed(xs, lo - back, hi, start, size, hop)
        mags = np.abs(np.fft.rfft(got * w, axis=1))
        v = np.log1p(1000 * np.maximum(mags, floor * mags.max(1, keepdims=True, initial=0.0)))
        rise = np.concatenate([[0.0], np.maximum(v[1:] - v[:-1], 0).sum(1)]) if len(v) else np.zeros(0)
        cut = int(back > 0)
        return {"frame": pa.array(np.arange(first + cut, first + len(v))), "onset": pa.array(rise[cut:])}

    return map_blocks(pack(samples, (1 << 16) // hop * hop, hop, size), run, "recording long, channel int, frame long, onset double")


def windows_of(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """``recording, channel, frame, samples``: whole frames, cut from blocks that overlap by a frame."""

    def run(xs, lo, hi, start):
        got, first = framed(xs, lo, hi, start, size, hop)
        return {"frame": pa.array(np.arange(first, first + len(got))), "samples": pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(got).ravel()))}

    return map_blocks(pack(samples, (1 << 16) // hop * hop, 0, size), run, "recording long, channel int, frame long, samples array<double>")
