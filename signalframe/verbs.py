"""The batch verbs: each takes ``samples(recording, channel, n, x)`` and a rate, and gives a report table or samples again.

Options have the names and defaults of the command line that they stand for; wrong ones raise ``ValueError`` before
anything runs.  What could not be measured is null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import db_to_gain
from .operators import advanced, channels as edits, filters, loudness, measure, repair, room as rooms, spectral, statistics, timeline
from .plans import reports, session
from .scratch import Scratch
from .sources import containers

FORMATS = {"16": "s16", "24": "s24", "float": "f32"}
ANALYSIS = [
    "file", "sampleRate", "channels", "frames", "seconds", "format", "integratedLufs", "loudnessRangeLu", "maxShortTermLufs", "maxMomentaryLufs", "truePeakDbtp", "samplePeakDbfs", "rmsDbfs", "crestFactorDb", "dcOffset",
    "stereoCorrelation", "stereoWidthDb", "stereoBalanceDb", "monoLossDb",
]


def _channel(samples: DataFrame, channel: int) -> DataFrame:
    if channel < 0:
        raise ValueError("there is no such channel")
    return samples.filter(F.col("channel") == channel)


def analyse(samples: DataFrame, rate: float, info: DataFrame | None = None) -> DataFrame:
    """One row of nineteen columns for each recording; ``info(recording, file, format)`` names them."""
    stats = statistics.by_recording(samples)
    loud = loudness.programme(samples, rate)
    peak = filters.true_peak(samples).groupBy("recording").agg(F.max("true_peak").alias("true_peak"))
    info = info if info is not None else stats.select("recording", F.col("recording").cast("string").alias("file"), F.lit(None).cast("string").alias("format"))
    j = stats.join(loud, "recording", "left").join(peak, "recording", "left").join(statistics.field_by_recording(samples), "recording", "left").join(info, "recording", "left")
    floor = lambda c: F.coalesce(F.col(c), F.lit(-200.0))
    return j.select(
        "file", F.lit(float(rate)).alias("sampleRate"), "channels", "frames", (F.col("frames") / rate).alias("seconds"), "format", F.col("integrated").alias("integratedLufs"), F.col("lra").alias("loudnessRangeLu"),
        floor("max_short_term").alias("maxShortTermLufs"), floor("max_momentary").alias("maxMomentaryLufs"), statistics.db(F.col("true_peak")).alias("truePeakDbtp"), F.col("sample_peak_db").alias("samplePeakDbfs"), F.col("rms_db").alias("rmsDbfs"),
        F.col("crest_db").alias("crestFactorDb"), F.col("dc_offset").alias("dcOffset"), F.col("correlation").alias("stereoCorrelation"), F.col("width_db").alias("stereoWidthDb"), F.col("balance_db").alias("stereoBalanceDb"), F.col("mono_loss_db").alias("monoLossDb"),
    )


def analyse_json(samples: DataFrame, rate: float, info: DataFrame | None = None) -> DataFrame:
    return reports.json_lines(analyse(samples, rate, info))


def analyse_csv(samples: DataFrame, rate: float, info: DataFrame | None = None) -> DataFrame:
    return reports.csv_lines(analyse(samples, rate, info))


def bands(spark: SparkSession, samples: DataFrame, rate: float, octave: bool = False, filtered: bool = False, order: int = 6, size: int = 8192) -> DataFrame:
    """``recording, centreHz, lowHz, highHz, levelDbfs`` of channel 0's first 120 seconds, off the average spectrum or through a filter bank."""
    s = edits.first_seconds(_channel(samples, 0), 120.0, rate)
    if filtered:
        bank = filters.filter_bank(s, rate, order, thirds=not octave)
        return bank.select("recording", F.col("centre").alias("centreHz"), F.col("low").alias("lowHz"), F.col("high").alias("highHz"), (F.col("level_db") + 3.0103).alias("levelDbfs"), F.col("reason").alias("missingBecause"))
    spectrum = spectral.levels(spectral.spectra(s, size, size // 2), size)
    out = spectral.bands(spectrum, spark, rate, size, thirds=not octave)
    return out.select("recording", F.col("centre").alias("centreHz"), F.col("low").alias("lowHz"), F.col("high").alias("highHz"), F.col("level_db").alias("levelDbfs"))


def room(samples: DataFrame, rate: float, banded: bool = False, thirds: bool = False) -> DataFrame:
    """Each channel's acoustics; ``banded``: channel 0 by octave or third-octave."""
    if banded:
        r = advanced.room_by_band(_channel(samples, 0).drop("channel"), rate, thirds)
        return r.select("recording", F.col("centre").alias("centreHz"), F.col("t20").alias("t20Seconds"), F.col("t30").alias("t30Seconds"), F.col("edt").alias("edtSeconds"))
    keyed = samples.select((F.col("recording") * 64 + F.col("channel")).alias("recording"), "n", "x")
    r = rooms.room(keyed, rate)
    names = {"c50_db": "c50Db", "c80_db": "c80Db", "centre_time": "centreTimeSeconds", "usable_range_db": "usableRangeDb"}
    return r.select(F.floor(F.col("recording") / 64).alias("recording"), (F.col("recording") % 64).cast("int").alias("channel"), *(F.col(c).alias(names.get(c, c)) for c in r.columns if c not in ("recording", "direct")))


def tempo(samples: DataFrame, rate: float, low: float = 60.0, high: float = 200.0, channel: int = 0, size: int = 1024, hop: int = 256) -> DataFrame:
    """``recording, valid, bpm, confidence, firstBeatSeconds, beats`` of the first 120 seconds."""
    s = edits.first_seconds(_channel(samples, channel), 120.0, rate)
    got = measure.track_tempo(spectral.onsets(s, size, hop).select("recording", "frame", "onset"), rate / hop, low=low, high=high)
    shift = (size - hop / 2) / rate
    return got.select("recording", "valid", "bpm", "confidence", (F.get("beats", F.lit(0)) + shift).alias("firstBeatSeconds"), F.transform("beats", lambda b: b + shift).alias("beats"))


def pitch_of(samples: DataFrame, rate: float, low: float = 50.0, high: float = 1000.0, threshold: float = 0.15, channel: int = 0, size: int = 2048, hop: int = 256) -> tuple[DataFrame, DataFrame]:
    """(summary, contour): ``medianHz, lowestHz, highestHz, voicedFraction, frames`` and ``seconds, hz, confidence, voiced``."""
    frames = spectral.windows_of(_channel(samples, channel), size, hop)
    points = measure.track_pitch(frames, rate, hop, low=low, high=high, threshold=threshold)
    s = measure.pitch_summary(points)
    return s.select("recording", F.col("median_hz").alias("medianHz"), F.col("lowest_hz").alias("lowestHz"), F.col("highest_hz").alias("highestHz"), F.col("voiced_fraction").alias("voicedFraction"), "frames"), points.select("recording", "seconds", "hz", "confidence", "voiced")


def null(reference: DataFrame, other: DataFrame, rate: float, align: bool = True, gain_match: bool = True, max_delay: int = 0, channel: int = 0) -> DataFrame:
    """``verdict, delaySamples, gainDb, polarityInverted, residualDb, peakResidualDb, worstTimeSeconds, comparedFrames``."""
    t = measure.null_test(_channel(reference, channel), _channel(other, channel), max_delay, align, gain_match)
    return t.select(
        "recording", "verdict", F.col("lag").alias("delaySamples"), F.col("gain_db").alias("gainDb"), F.col("inverted").alias("polarityInverted"), F.col("residual_db").alias("residualDb"), F.col("peak_residual_db").alias("peakResidualDb"),
        (F.col("worst_n") / rate).alias("worstTimeSeconds"), F.col("frames").alias("comparedFrames"),
    )


def null_bands(spark: SparkSession, reference: DataFrame, other: DataFrame, rate: float, align: bool = True, gain_match: bool = True, max_delay: int = 0, channel: int = 0, size: int = 8192) -> DataFrame:
    """``recording, centreHz, referenceDb, residualDb, relativeDb``: the octaves of what was compared and of what the null test left."""
    a, b = _channel(reference, channel), _channel(other, channel)
    scratch = Scratch(spark, "null")
    tested = scratch.keep(measure.null_test(a, b, max_delay, align, gain_match), "tested")
    spectrum = scratch.keep(spectral.spectra(measure.residual_samples(a, b, tested), size, size // 2), "spectra")
    side = lambda c, name: spectral.bands(spectral.levels(spectrum.filter(F.col("channel") == c), size), spark, rate, size).select("recording", F.col("centre").alias("centreHz"), F.col("level_db").alias(name))
    j = side(0, "referenceDb").join(side(1, "residualDb"), ["recording", "centreHz"])
    return j.withColumn("relativeDb", F.col("residualDb") - F.col("referenceDb"))


def _grid(samples: DataFrame, rate: float, interval: float) -> DataFrame:
    if not interval > 0 or interval * rate < 1:
        raise ValueError("the interval is at least one sample")
    points = loudness.series(loudness.sub_blocks(samples, rate), rate)
    return advanced.contour_grid(advanced.contour(points, samples, rate), samples, rate, interval)


def contour(samples: DataFrame, rate: float, interval: float = 0.1) -> DataFrame:
    """``recording, seconds, momentaryLufs, shortTermLufs, truePeakDbtp, psrDb, crestDb`` at every interval from 0 on; a recording shorter than 400 ms has none."""
    c = _grid(samples, rate, interval)
    return c.select("recording", "seconds", F.col("momentary").alias("momentaryLufs"), F.col("short_term").alias("shortTermLufs"), F.col("peak_db").alias("truePeakDbtp"), F.col("psr_db").alias("psrDb"), F.col("crest_db").alias("crestDb"))


def contour_summary(samples: DataFrame, rate: float, interval: float = 0.1) -> DataFrame:
    """The contour's keys: ``integratedLufs, loudnessRangeLu, truePeakDbtp, plrDb``, extremes and percentiles of short-term loudness, and the number of points."""
    grid = Scratch(samples.sparkSession, "contour").keep(_grid(samples, rate, interval), "grid")
    s = advanced.contour_summary(grid, loudness.programme(samples, rate), filters.true_peak(samples))
    return s.select(
        "recording", F.col("integrated").alias("integratedLufs"), F.col("lra").alias("loudnessRangeLu"), F.col("peak_db").alias("truePeakDbtp"), F.col("plr_db").alias("plrDb"), F.col("quietest").alias("quietestShortTermLufs"),
        F.col("loudest").alias("loudestShortTermLufs"), F.col("p10").alias("shortTermPercentile10Lufs"), F.col("p95").alias("shortTermPercentile95Lufs"), "points",
    )


def key(spark: SparkSession, samples: DataFrame, rate: float, channel: int = 0, size: int = 4096) -> DataFrame:
    """``recording, key, tonic, mode, worthNaming, strength, fit, contrast, margin, tuningOffsetCents, runnerUp, chroma`` of the first 60 seconds."""
    s = edits.first_seconds(_channel(samples, channel), 60.0, rate)
    mags = Scratch(spark, "key").keep(spectral.spectra(s, size, size // 2).select("recording", "bin", F.col("total").alias("mag")), "mags")  # read twice
    k = spectral.key(spark, mags, rate, size)
    return k.select("recording", "key", "tonic", "mode", F.col("worth_naming").alias("worthNaming"), "strength", "fit", "contrast", "margin", F.col("tuning_cents").alias("tuningOffsetCents"), F.col("runner_up").alias("runnerUp"), "chroma")


def sweep(spark: SparkSession, rate: float = 48000.0, start: float = 20.0, end: float = 20000.0, seconds: float = 5.0, level_db: float = -6.0206, fade: float = 0.02) -> DataFrame:
    return filters.sweep(spark, rate, seconds, start, end, 10 ** (level_db / 20), fade)


def deconvolve(recorded: DataFrame, rate: float, start: float = 20.0, end: float = 20000.0, seconds: float = 5.0, level: float = 0.5, fade: float = 0.02, keep: float = 0.0, channel: int = 0) -> DataFrame:
    """Impulse responses ``recording, channel, n, x``, the first ``keep`` seconds of them; a recording shorter than the sweep gives none."""
    end = min(end, 0.99 * rate / 2)
    frames, edge = int(seconds * rate), max(1, int(fade * rate))
    n = np.arange(frames)
    near = np.minimum(n, frames - 1 - n)
    k = math.log(end / start)
    tone = level * np.sin(2 * np.pi * start * seconds / k * (np.exp(n / rate / seconds * k) - 1)) * np.where(near < edge, 0.5 - 0.5 * np.cos(np.pi * near / edge), 1.0)

    return measure.deconvolve(_channel(recorded, channel), tone, rate, start, end, int(keep * rate))


def deconvolve_report(impulse: DataFrame, rate: float) -> DataFrame:
    """``recording, frames, seconds, peakAboveTailDb`` of what ``deconvolve`` gives."""
    r = measure.peak_to_tail(impulse)
    return r.select("recording", "frames", (F.col("frames") / rate).alias("seconds"), F.col("peak_db").alias("peakAboveTailDb"))


def provenance(samples: DataFrame, rate: float, declared_bits: int = 24, size: int = 8192) -> DataFrame:
    """``recording, sampleRate, declaredBits, effectiveBits, padded, cutoffHz, cutoffDropDb, steepCutoff`` of the first 120 seconds of channel 0."""
    s = edits.first_seconds(_channel(samples, 0), 120.0, rate)
    used = statistics.effective_bits(s, declared_bits)
    end = spectral.provenance(spectral.levels(spectral.spectra(s, size, size // 2), size), rate, size)
    j = used.join(end, "recording", "left")
    return j.select("recording", F.lit(float(rate)).alias("sampleRate"), F.lit(declared_bits).alias("declaredBits"), F.col("effective_bits").alias("effectiveBits"), ((F.col("effective_bits") > 0) & (F.col("effective_bits") < declared_bits)).alias("padded"), F.col("cutoff_hz").alias("cutoffHz"), F.col("drop_db").alias("cutoffDropDb"), F.col("steep").alias("steepCutoff"))


def convert(samples: DataFrame, rate: float, to_rate: float | None = None, fmt: str = "24", dither: str = "none", quality: str = "best") -> DataFrame:
    """Another rate and depth; with the same rate and no dither samples pass as they are."""
    if fmt not in FORMATS or dither not in ("none", "tpdf", "shaped"):
        raise ValueError("formats are 16, 24 and float; dithers none, tpdf and shaped")
    s = samples if to_rate in (None, rate) else filters.resample(samples, rate, to_rate, quality)
    return s if dither == "none" or fmt == "float" else advanced.dither(s, int(fmt), dither == "shaped")


def normalise(spark: SparkSession, samples: DataFrame, rate: float, target: str) -> DataFrame:
    """Each recording under the gain that meets the target without breaking its ceiling; one in which nothing passes the gate is left out."""
    known = [t for t in statistics.TARGETS if t[0].lower() == target.lower()]
    if not known:
        raise ValueError(f"unknown target {target!r}")
    _, lufs, ceiling, _ = known[0]
    loud = loudness.programme(samples, rate).select("recording", "integrated")
    peak = filters.true_peak(samples).groupBy("recording").agg(statistics.db(F.max("true_peak")).alias("peak"))
    gain = loud.filter("integrated IS NOT NULL").join(peak, "recording").select("recording", db_to_gain(F.least(lufs - F.col("integrated"), ceiling - F.col("peak"))).alias("gain"))
    return samples.join(gain, "recording").select("recording", "channel", "n", (F.col("x") * F.col("gain")).alias("x"))


def denoise(samples: DataFrame, rate: float, noise: tuple[float, float], amount: float = 12.0) -> DataFrame:
    return repair.denoise(samples, int(noise[0] * rate), int(noise[1] * rate), amount)


def dereverb(samples: DataFrame, rate: float, amount: float = 1.0, decay: float = 0.8, floor: float = -20.0) -> DataFrame:
    return repair.dereverb(samples, rate, amount, decay, floor)


def deess(samples: DataFrame, rate: float, frequency: float = 5000.0, threshold: float = -30.0, ratio: float = 4.0, most: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """(samples, report)."""
    return advanced.deess(samples, rate, frequency, threshold, ratio, most), advanced.deess_report(samples, rate, frequency, threshold, ratio, most)


def dehum(samples: DataFrame, rate: float, frequency: float | None = None, partials: int = 8) -> DataFrame:
    """At a given mains frequency, or for each recording at the one that the search finds (to 0.01 Hz); only partials that are steady and stand out go."""
    return repair.dehum_each(samples, rate, _hum(samples, rate, frequency, partials))


def _hum(samples: DataFrame, rate: float, frequency: float | None, partials: int) -> DataFrame:
    if frequency is not None and not 0 < frequency < rate / 2:
        raise ValueError("a frequency below half the rate")
    return Scratch(samples.sparkSession, "hum").keep(repair.find_hum(samples, rate, frequency, partials), "found")


def dehum_report(samples: DataFrame, rate: float, frequency: float | None = None, partials: int = 8) -> DataFrame:
    """``recording, found, frequencyHz, harmonics, removedDb, prominence``: what ``dehum`` does to each recording."""
    found = _hum(samples, rate, frequency, partials)
    energy = lambda df, name: df.groupBy("recording").agg(F.sum(F.col("x") * F.col("x")).alias(name))
    j = found.join(energy(samples, "before"), "recording").join(energy(repair.dehum_each(samples, rate, found), "after"), "recording")
    removed = F.when(F.col("found") & (F.col("before") > 0) & (F.col("after") > 0), 10 * F.log10(F.col("after") / F.col("before"))).otherwise(0.0)
    return j.select("recording", "found", F.col("hz").alias("frequencyHz"), F.coalesce(F.size("parts"), F.lit(0)).alias("harmonics"), removed.alias("removedDb"), F.col("evidence").alias("prominence"))


def declip(samples: DataFrame, rate: float, keep_level: bool = False) -> DataFrame:
    return repair.declip(samples, keep_level=keep_level)


def declick(samples: DataFrame, rate: float, sensitivity: float = 5.0) -> DataFrame:
    return repair.declick(samples, sensitivity=sensitivity)


def stretch(samples: DataFrame, rate: float, length: float) -> DataFrame:
    """``length`` in per cent, from 10 to 1000."""
    if not 10 <= length <= 1000:
        raise ValueError("the length lies between 10 and 1000 per cent")
    return repair.stretch(samples, length / 100)


def pitch(samples: DataFrame, rate: float, semitones: float) -> DataFrame:
    return advanced.pitch_shift(samples, rate, semitones)


def compress(samples: DataFrame, rate: float, threshold: float = -20.0, ratio: float = 4.0, attack: float = 10.0, release: float = 100.0, knee: float = 6.0, makeup: float = 0.0, link: bool = True) -> DataFrame:
    """Attack and release in milliseconds; linked channels hear the loudest of them."""
    if ratio < 1 or attack < 0 or release < 0 or knee < 0:
        raise ValueError("a ratio below 1 or a negative time")
    return filters.linked_compress(samples, rate, threshold, ratio, attack / 1000, release / 1000, knee, makeup, 1.0 if link else 0.0)


def gate(samples: DataFrame, rate: float, threshold: float = -50.0, depth: float = -80.0, hysteresis: float = 6.0, attack: float = 1.0, hold: float = 50.0, release: float = 100.0) -> DataFrame:
    """Each channel by itself."""
    return filters.gate(samples, rate, threshold, hysteresis, hold / 1000, depth, attack / 1000, release / 1000)


def channels(samples: DataFrame, rate: float, op: str) -> DataFrame:
    """reverse, invert, swap (stereo only) or mono."""
    if op not in ("reverse", "invert", "swap", "mono"):
        raise ValueError(f"unknown channel edit {op!r}")
    if op == "invert":
        return edits.invert(samples)
    if op == "reverse":
        last = samples.groupBy("recording").agg(F.max("n").alias("last"))
        return samples.join(last, "recording").select("recording", "channel", (F.col("last") - F.col("n")).alias("n"), "x")
    if op == "swap":
        stereo = samples.groupBy("recording").agg(F.max("channel").alias("top")).filter("top = 1").select("recording")
        return edits.swap(samples.join(stereo, "recording", "left_semi"))
    mean = samples.groupBy("recording", "n").agg(F.avg("x").alias("x"))
    return samples.select("recording", "channel", "n").join(mean, ["recording", "n"]).select("recording", "channel", "n", "x")


def render(sessions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``n, x`` of the timeline of one or more sessions' JSON, which add up; warnings); sources that are missing sound as silence."""
    loaded = session.load(sessions)
    clips = loaded["clips"]
    return timeline.render(clips, sources, 0, timeline.duration(clips)), loaded["warnings"]


def write(samples: DataFrame, rate: int, path: str, fmt: str = "24") -> DataFrame:
    """``recording, content``: files in the container that the path's extension names."""
    if fmt not in FORMATS:
        raise ValueError("formats are 16, 24 and float")
    return containers.write_files(samples, rate, containers.kind_of(path), FORMATS[fmt])


VERBS = {
    "analyse": analyse, "bands": bands, "room": room, "tempo": tempo, "pitch-of": pitch_of, "null": null, "contour": contour, "key": key, "sweep": sweep, "deconvolve": deconvolve, "provenance": provenance, "convert": convert, "normalise": normalise,
    "denoise": denoise, "dereverb": dereverb, "deess": deess, "dehum": dehum, "declip": declip, "declick": declick, "stretch": stretch, "pitch": pitch, "compress": compress, "gate": gate, "channels": channels, "render": render,
}


def run(verb: str, *args, **options):
    """Dispatch by name; an unknown verb lists those there are."""
    if verb not in VERBS:
        raise ValueError(f"unknown verb {verb!r}; there are {', '.join(sorted(VERBS))}")
    return VERBS[verb](*args, **options)
