"""Scalar functions as column expressions: window kernels, axes, colours, wording."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import db_to_gain

# The stops (position, red, green, blue) of two colour maps.
MAGMA = [(0.0, 0.001, 0.0, 0.014), (0.125, 0.078, 0.054, 0.211), (0.25, 0.232, 0.06, 0.438), (0.375, 0.39, 0.1, 0.502), (0.5, 0.55, 0.161, 0.506), (0.625, 0.716, 0.215, 0.475), (0.75, 0.868, 0.288, 0.409), (0.875, 0.967, 0.468, 0.36), (1.0, 0.987, 0.991, 0.749)]
VIRIDIS = [(0.0, 0.267, 0.005, 0.329), (0.125, 0.283, 0.141, 0.458), (0.25, 0.254, 0.265, 0.53), (0.375, 0.208, 0.372, 0.553), (0.5, 0.164, 0.471, 0.558), (0.625, 0.128, 0.567, 0.551), (0.75, 0.135, 0.659, 0.518), (0.875, 0.267, 0.749, 0.441), (1.0, 0.993, 0.906, 0.144)]
LOWEST_HZ = 20.0


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))


def bessel_i0(x: Column, terms: int = 40) -> Column:
    """The modified Bessel function of order 0 by the first ``terms`` terms of its series (up to k = terms - 1)."""
    series = F.array(*(F.struct(F.lit(2.0 * k).alias("power"), F.lit(math.gamma(k + 1) ** 2).alias("under")) for k in range(terms)))
    return F.aggregate(series, F.lit(0.0), lambda s, t: s + F.pow(x / 2, t["power"]) / t["under"])


def kaiser(position: Column, beta: float) -> Column:
    inside = F.sqrt(F.greatest(F.lit(0.0), 1 - position * position))
    return F.when(F.abs(position) <= 1, bessel_i0(beta * inside) / bessel_i0(F.lit(float(beta)))).otherwise(0.0)


def kaiser_beta(stop_db: Column) -> Column:
    return F.when(stop_db > 50, 0.1102 * (stop_db - 8.7)).when(stop_db >= 21, 0.5842 * F.pow(stop_db - 21, 0.4) + 0.07886 * (stop_db - 21)).otherwise(0.0)


def kaiser_length(stop_db: Column, width: Column) -> Column:
    return F.when(width > 0, (stop_db - 8.0) / (2.285 * 2 * math.pi * width)).otherwise(0.0)


def seconds_of(n: Column, rate: float) -> Column:
    return n / rate


def samples_of(seconds: Column, rate: float) -> Column:
    """The nearest sample, halves away from zero."""
    return F.round(seconds * rate).cast("long")


def onset_seconds(frame: Column, rate: float, size: int, hop: int) -> Column:
    return (frame * hop + size - hop / 2) / rate


def fraction_of(hz: Column, nyquist: float, log: bool) -> Column:
    """Where a frequency lies on an axis, from 0 to 1; a log axis begins at 20 Hz."""
    f = F.log(F.greatest(hz, F.lit(LOWEST_HZ)) / LOWEST_HZ) / math.log(nyquist / LOWEST_HZ) if log else hz / nyquist
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))


def frequency_at(fraction: Column, nyquist: float, log: bool) -> Column:
    return LOWEST_HZ * F.pow(F.lit(nyquist / LOWEST_HZ), fraction) if log else fraction * nyquist


def colour(value: Column, name: str = "magma") -> Column:
    """``#rrggbb`` of a value from 0 to 1, off a table of 256 steps between the stops."""
    v = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 255) / 255
    if name == "grey":
        rgb = [F.round(v * 255).cast("int")] * 3
    else:
        stops = {"magma": MAGMA, "viridis": VIRIDIS}[name]

        def part(k):
            out = F.lit(stops[-1][k])
            for a, b in reversed(list(zip(stops, stops[1:]))):
                out = F.when(v <= b[0], a[k] + (b[k] - a[k]) * ((v - a[0]) / (b[0] - a[0]))).otherwise(out)
            return F.round(out * 255).cast("int")

        rgb = [part(k) for k in (1, 2, 3)]
    return F.format_string("#%02x%02x%02x", *rgb)


def key_reading(name: Column, contrast: Column, strength: Column, cents: Column) -> Column:
    """How sure a key is: none, doubtful or firm."""
    none = (contrast < 0.15) | (strength < 0.2)
    doubtful = (strength < 0.5) | (F.abs(cents) > 25)
    return F.struct(F.when(none, F.lit("no key")).otherwise(name).alias("value"), F.when(none, "none").when(doubtful, "doubtful").otherwise("firm").alias("certainty"))


def tempo_reading(valid: Column, bpm: Column, confidence: Column) -> Column:
    return F.struct(F.when(valid, F.format_string("%.1f BPM", bpm)).otherwise("no tempo").alias("value"), F.when(~valid, "none").when(confidence < 0.35, "doubtful").otherwise("firm").alias("certainty"))


def pitch_reading(median: Column, voiced: Column) -> Column:
    none = median.isNull() | (voiced <= 0)
    return F.struct(F.when(none, "none").otherwise(F.format_string("%.1f Hz", median)).alias("value"), F.when(none, "none").when(voiced < 0.25, "doubtful").otherwise("firm").alias("certainty"))


def room_reading(valid: Column, reach: Column, t20: Column, t30: Column) -> Column:
    return F.struct(F.when(valid, F.format_string("%.1f dB", reach)).otherwise("--").alias("value"), F.when(~valid, "none").when(t20.isNull() | t30.isNull(), "doubtful").otherwise("firm").alias("certainty"))


def container_of(path: Column, bits: Column) -> Column:
    """The container that a file's extension names, and the depth that it can take: what it can't becomes 24 bits."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    kind = F.when(ext.isin("aif", "aiff", "aifc"), "aiff").when(ext == "flac", "flac").otherwise("wav")
    able = F.when(kind == "flac", bits.isin(16, 24)).when(kind == "aiff", bits.isin(16, 24, 32)).otherwise(bits.isin(8, 16, 24, 32))
    return F.struct(kind.alias("container"), F.when(able, bits).otherwise(24).alias("bits"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["db_to_gain"]
