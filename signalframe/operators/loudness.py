"""Loudness: K-weighting in blocks, then plain aggregation and window frames.

Sub-blocks of 100 ms are the seam: below it a filter runs in blocks that carry its state; above it all is SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FLOOR_DB
from ..scratch import Scratch
from .blocks import BLOCK, cascades, run_cascade

# The analogue prototypes of the two K-weighting stages (Hz, dB, Q).
SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196)
SHELF_EXPONENT = 0.4996667741545416
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
OFFSET = -0.691
BINS, WIDTH, LOWEST = 1000, 0.1, -70.0


def k_weighting(rate: float) -> list[tuple[float, ...]]:
    """The two sections (b0, b1, b2, a1, a2) at a rate of 8 kHz or more."""
    if rate < 8000:
        raise ValueError("K-weighting needs 8 kHz or more")
    f, gain, q = SHELF
    k, v = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    vb, d = v**SHELF_EXPONENT, 1 + k / q + k * k
    shelf = ((v + vb * k / q + k * k) / d, 2 * (k * k - v) / d, (v - vb * k / q + k * k) / d, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)
    f, q = HIGH_PASS
    k = math.tan(math.pi * f / rate)
    d = 1 + k / q + k * k
    return [shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)]


def run_sections(x: np.ndarray, sections) -> np.ndarray:
    """Transposed direct form II, section after section, from nothing."""
    return run_cascade(x, sections)[0]


def sub_blocks(samples: DataFrame, rate: float, weighted: bool = True) -> DataFrame:
    """``recording, channel, sub, sq, frames``: energy of each whole 100 ms."""
    size = int(rate / 10)
    if weighted:
        sections = k_weighting(rate)

        def energies(start, ys):
            whole = len(ys[0]) // size
            sq = (ys[0][: whole * size].reshape(whole, size) ** 2).sum(1)
            return {"sub": pa.array(start // size + np.arange(whole)), "sq": pa.array(sq)}

        block = max(1, BLOCK // size) * size  # so that no sub-block is cut
        return cascades(samples, [sections], energies, "recording long, channel int, sub long, sq double", block)
    by = samples.groupBy("recording", "channel", F.floor(F.col("n") / size).cast("long").alias("sub")).agg(F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("frames"))
    return by.filter(F.col("frames") == size).drop("frames")


def loudness_of(energy):
    return F.when(energy > 0, F.greatest(F.lit(FLOOR_DB), OFFSET + 10 * F.log10(energy))).otherwise(F.lit(FLOOR_DB))


def series(subs: DataFrame, rate: float, weights: dict[int, float] | None = None) -> DataFrame:
    """Momentary (4 sub-blocks) and short-term (30) loudness of each sub-block; null before the window is full."""
    size = int(rate / 10)
    weight = F.lit(1.0)
    for c, v in (weights or {}).items():
        weight = F.when(F.col("channel") == c, v).otherwise(weight)
    e = subs.groupBy("recording", "sub").agg((F.sum(weight * F.col("sq")) / size).alias("e"))
    w = Window.partitionBy("recording").orderBy("sub")
    over = lambda k: F.when(F.row_number().over(w) >= k, F.sum("e").over(w.rowsBetween(1 - k, 0)) / k)
    out = e.withColumn("me", over(4)).withColumn("se", over(30))
    return out.select("recording", "sub", "me", F.when(F.col("me").isNotNull(), loudness_of(F.col("me"))).alias("momentary"), F.when(F.col("se").isNotNull(), loudness_of(F.col("se"))).alias("short_term"))


def _bin(level):
    return F.least(F.floor((level - LOWEST) / WIDTH).cast("int"), F.lit(BINS - 1))


def integrated(points: DataFrame) -> DataFrame:
    """Gated loudness on a histogram of 0.1 LU: bins whose centre is above the relative threshold (mean - 10) count."""
    bins = points.filter(F.col("momentary") > LOWEST).groupBy("recording", _bin(F.col("momentary")).alias("bin")).agg(F.count("*").alias("c"), F.sum("me").alias("e"))
    first = bins.groupBy("recording").agg((loudness_of(F.sum("e") / F.sum("c")) - 10).alias("gate"))
    kept = bins.join(first, "recording").filter((F.col("bin") + 0.5) * WIDTH + LOWEST > F.col("gate"))
    return kept.groupBy("recording").agg(loudness_of(F.sum("e") / F.sum("c")).alias("integrated"), F.sum("c").alias("gated_blocks"))


def loudness_range(points: DataFrame) -> DataFrame:
    """P95 less P10 (nearest rank, bin centres) of short-term loudness at a hop of 1 s above mean - 20."""
    st = points.filter(F.col("short_term").isNotNull() & ((F.col("sub") - 29) % 10 == 0) & (F.col("short_term") > LOWEST))
    st = st.withColumn("e", F.pow(F.lit(10.0), (F.col("short_term") - OFFSET) / 10))
    bins = st.groupBy("recording", _bin(F.col("short_term")).alias("bin")).agg(F.count("*").alias("c"), F.sum("e").alias("e"))
    gate = bins.groupBy("recording").agg((loudness_of(F.sum("e") / F.sum("c")) - 20).alias("gate"))
    kept = bins.join(gate, "recording").filter((F.col("bin") + 0.5) * WIDTH + LOWEST > F.col("gate"))
    w = Window.partitionBy("recording")
    cum = kept.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("n", F.sum("c").over(w))
    at = lambda f: (F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * f + 0.5), F.col("bin"))) + 0.5) * WIDTH + LOWEST
    return cum.groupBy("recording").agg(F.greatest(F.lit(0.0), at(0.95) - at(0.10)).alias("lra"))


def programme(samples: DataFrame, rate: float, weighted: bool = True) -> DataFrame:
    """Integrated loudness, range and the loudest windows of each recording.

    Three aggregations read the points (ten small rows a second), so they are written once rather than filtered three times."""
    points = Scratch(samples.sparkSession, "loudness").keep(series(sub_blocks(samples, rate, weighted), rate), "points")
    tops = points.groupBy("recording").agg(F.max("momentary").alias("max_momentary"), F.max("short_term").alias("max_short_term"))
    return tops.join(integrated(points), "recording", "left").join(loudness_range(points), "recording", "left")
