"""Element-wise operators: channel edits, fades, tapers, quantising."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reverse(samples: DataFrame, frames: int) -> DataFrame:
    return samples.withColumn("n", F.lit(frames - 1) - F.col("n"))


def invert(samples: DataFrame) -> DataFrame:
    return samples.withColumn("x", -F.col("x"))


def swap(samples: DataFrame) -> DataFrame:
    return samples.withColumn("channel", 1 - F.col("channel"))


def mono(stereo: DataFrame) -> DataFrame:
    m = 0.5 * (F.col("l") + F.col("r"))
    return stereo.select("n", m.alias("l"), m.alias("r"))


def channel_edit(samples: DataFrame, op: str, frames: int) -> DataFrame:
    if op not in ("reverse", "invert", "swap"):
        raise ValueError(f"unknown channel edit {op!r}")
    return {"reverse": lambda: reverse(samples, frames), "invert": lambda: invert(samples), "swap": lambda: swap(samples)}[op]()


def fade(shape: str, t: Column) -> Column:
    """Gain of a fade-in at 0..1; a fade-out takes 1 - t."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return {"linear": t, "equal_power": F.sin(t * (math.pi / 2)), "logarithmic": F.sqrt(t), "exponential": t * t, "s_curve": t * t * (3 - 2 * t)}[shape]


SHAPES = ("linear", "equal_power", "logarithmic", "exponential", "s_curve")


def taper(kind: str, i: Column, size: int) -> Column:
    """Periodic tapers: the period is the size."""
    a = 2 * math.pi * i / size
    return {
        "rectangular": F.lit(1.0) + 0 * i, "hann": 0.5 - 0.5 * F.cos(a), "hamming": 0.54 - 0.46 * F.cos(a),
        "blackman_harris": 0.35875 - 0.48829 * F.cos(a) + 0.14128 * F.cos(2 * a) - 0.01168 * F.cos(3 * a),
    }[kind]


TAPERS = ("rectangular", "hann", "hamming", "blackman_harris")


def tapers(spark: SparkSession, size: int) -> DataFrame:
    i = F.col("id")
    return spark.range(size).select(F.col("id").alias("i"), *(taper(k, i, size).alias(k) for k in TAPERS))


def cola_deviation(spark: SparkSession, size: int, hop: int) -> DataFrame:
    """How far the overlap-added squares of each taper are from flat: (max - min) / mean over the hop's places."""
    t = tapers(spark, size).withColumn("slot", F.col("i") % hop)
    sums = t.groupBy("slot").agg(*(F.sum(F.col(k) * F.col(k)).alias(k) for k in TAPERS))
    return sums.agg(*(((F.max(k) - F.min(k)) / F.avg(k)).alias(k) for k in TAPERS))


def quantise(x: Column, bits: int) -> Column:
    """Scale, round half away from zero, clamp."""
    top = 1 << (bits - 1)
    return F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.round(x * top).cast("long")))


def select_range(samples: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples of [start, stop), as far as the signal has them."""
    return samples.filter((F.col("n") >= max(0, start)) & (F.col("n") < stop))


def select_channel(samples: DataFrame, channel: int, channels: int) -> DataFrame:
    if not 0 <= channel < channels:
        raise ValueError(f"there is no channel {channel} of {channels}")
    return samples.filter(F.col("channel") == channel)


def first_seconds(samples: DataFrame, seconds: float, rate: float) -> DataFrame:
    """The cap of verbs that listen to a beginning only; it comes before framing."""
    return samples.filter(F.col("n") < int(seconds * rate))
