"""Programme statistics, stereo field, bit depth and compliance: one scan and map-side aggregation each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FLOOR_DB, db
from .blocks import map_blocks, pack

# Delivery targets (name, integrated LUFS, true-peak ceiling dBTP, tolerance LU).
TARGETS = [
    ("Spotify", -14.0, -1.0, 1.0), ("Apple Music", -16.0, -1.0, 1.0), ("YouTube", -14.0, -1.0, 1.0), ("Amazon Music", -14.0, -2.0, 1.0),
    ("Tidal", -14.0, -1.0, 1.0), ("Podcast", -16.0, -1.0, 1.0), ("EBU R128", -23.0, -1.0, 0.5), ("ATSC A/85", -24.0, -2.0, 2.0),
]


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "target string, lufs double, ceiling double, tolerance double")


def signal_statistics(samples: DataFrame) -> DataFrame:
    """One row from ``samples(channel, n, x)``: peak, RMS, DC offset of largest size with its sign (first channel on a tie), crest factor."""
    by = samples.groupBy("channel").agg(F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.sum("x").alias("total"), F.count("*").alias("frames"))
    by = by.withColumn("mean", F.col("total") / F.col("frames"))
    out = by.agg(F.max("peak").alias("peak"), F.sqrt(F.sum("sq") / F.sum("frames")).alias("rms"), F.max_by("mean", F.struct(F.abs("mean"), -F.col("channel"))).alias("dc_offset"), F.max("frames").alias("frames"))
    crest = F.when((F.col("rms") > 0) & (F.col("peak") > 0), db(F.col("peak") / F.col("rms"))).otherwise(0.0)
    return out.select("frames", db(F.col("peak")).alias("sample_peak_db"), db(F.col("rms")).alias("rms_db"), "dc_offset", crest.alias("crest_db"))


def stereo_field(stereo: DataFrame, *keys: str) -> DataFrame:
    """Correlation (without removing means), width, balance and mono loss of ``n, l, r``; null for silence."""
    l, r = F.col("l"), F.col("r")
    m, s = (l + r) / 2, (l - r) / 2
    t = stereo.groupBy(*keys).agg(*(F.sum(a * b).alias(k) for k, a, b in (("ll", l, l), ("rr", r, r), ("lr", l, r), ("mm", m, m), ("ss", s, s))))
    ratio = lambda a, b: F.when((a <= 0) & (b <= 0), 0.0).when(b <= 0, 200.0).when(a <= 0, -200.0).otherwise(F.greatest(F.lit(-200.0), F.least(F.lit(200.0), 10 * F.log10(a / b))))
    ll, rr = F.col("ll"), F.col("rr")
    loud = (ll + rr) > 0
    corr = F.when((ll > 0) & (rr > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("lr") / F.sqrt(ll * rr)))).otherwise(0.0)
    cols = {"correlation": corr, "width_db": ratio(F.col("ss"), F.col("mm")), "balance_db": ratio(rr, ll), "mono_loss_db": ratio(F.col("mm"), (ll + rr) / 2)}
    return t.select(*keys, *(F.when(loud, v).alias(k) for k, v in cols.items()))


def effective_bits(samples: DataFrame, bits: int = 24) -> DataFrame:
    """Bits in use: all less the trailing zeros that every sample shares; 0 for silence."""
    scaled = F.abs(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x"))) * (1 << (bits - 1))).cast("long"))
    by = ["recording"] if "recording" in samples.columns else []
    used = samples.groupBy(*by).agg(F.bit_or(scaled).alias("used"))
    return used.select(*by, F.when(F.col("used") == 0, 0).otherwise(bits - F.bit_count(F.expr("(used & -used) - 1"))).cast("int").alias("effective_bits"))


def compliance(measured: DataFrame, against: DataFrame) -> DataFrame:
    """Each measurement (``lufs_in, peak_in``) against each of the few targets; the gain that conforms never breaks the ceiling."""
    d = F.col("lufs_in") - F.col("lufs")
    margin, gain = F.col("ceiling") - F.col("peak_in"), F.col("lufs") - F.col("lufs_in")
    rows = measured.join(F.broadcast(against))  # eight fixed rows
    return rows.select(
        *measured.columns, "target", d.alias("deviation_lu"), margin.alias("margin_db"), (F.abs(d) <= F.col("tolerance")).alias("on_target"), (margin >= 0).alias("within_ceiling"), gain.alias("gain_to_target"),
        F.least(gain, margin).alias("conform_gain"),
    )


def peak_to_loudness(peak, loudness):
    """PLR and PSR: nothing (-200) where either is at the floor."""
    return F.when((peak <= FLOOR_DB) | (loudness <= FLOOR_DB), F.lit(FLOOR_DB)).otherwise(peak - loudness)


def find_targets(asked: DataFrame, against: DataFrame) -> DataFrame:
    """``asked`` names with their targets, whatever their case; unknown names have none."""
    return asked.join(F.broadcast(against), F.lower("asked") == F.lower("target"), "left")  # eight fixed rows


def by_recording(samples: DataFrame) -> DataFrame:
    """``signal_statistics`` of each recording of ``samples(recording, channel, n, x)``, with its channels and frames."""
    by = samples.groupBy("recording", "channel").agg(F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("c"))
    by = by.join(means(samples), ["recording", "channel"], "left")
    out = by.groupBy("recording").agg(
        F.count("*").cast("int").alias("channels"), F.max("c").alias("frames"), F.max("peak").alias("peak"), F.sqrt(F.sum("sq") / F.sum("c")).alias("rms"), F.max_by("mean", F.struct(F.abs("mean"), -F.col("channel"))).alias("dc_offset")
    )
    crest = F.when((F.col("rms") > 0) & (F.col("peak") > 0), db(F.col("peak") / F.col("rms"))).otherwise(0.0)
    return out.select("recording", "channels", "frames", db(F.col("peak")).alias("sample_peak_db"), db(F.col("rms")).alias("rms_db"), crest.alias("crest_db"), "dc_offset")


def means(samples: DataFrame) -> DataFrame:
    """``recording, channel, mean``, added up in the order of ``n``: a mean that is a tie in the last written digit hangs on the last bit of the sum.

    Each block is added up in that order, then the blocks are; a task holds a few blocks at a time."""

    def total(xs, lo, hi, start):
        return {"at": np.array([start]), "total": np.cumsum(xs)[-1:], "frames": np.array([len(xs)])}  # cumsum adds one by one, sum in pairs

    parts = map_blocks(pack(samples.filter("x IS NOT NULL")), total, "recording long, channel int, at long, total double, frames long")
    whole = parts.groupBy("recording", "channel").agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("parts"), F.sum("frames").alias("frames"))
    return whole.select("recording", "channel", (F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["total"]) / F.col("frames")).alias("mean"))


def field_by_recording(samples: DataFrame) -> DataFrame:
    """``stereo_field`` of each recording that has two channels."""
    pair = samples.filter("channel < 2").groupBy("recording", "n").agg(F.max(F.when(F.col("channel") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("x"))).alias("r"))
    return stereo_field(pair.filter("l IS NOT NULL AND r IS NOT NULL"), "recording")
