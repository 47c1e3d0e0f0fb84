"""Room acoustics of impulse responses ``(recording, n, x)``: direct sound, noise truncation, backward integration with a tail, decay times and energy splits.

Energies are added up from the end in blocks: sums of blocks first, then within each block, so that no task sees a whole recording.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FLOOR_DB, db
from ..scratch import Scratch

BLOCK = 65536


def remaining(samples: DataFrame, value, block: int = BLOCK) -> DataFrame:
    """``samples`` with ``left``: the sum of ``value`` from each sample of a recording to its end."""
    s = samples.withColumns({"_v": value, "_b": F.floor(F.col("n") / block)})
    sums = s.groupBy("recording", "_b").agg(F.sum("_v").alias("_s"))
    after = sums.select("recording", "_b", (F.sum("_s").over(Window.partitionBy("recording").orderBy(F.desc("_b"))) - F.col("_s")).alias("_after"))
    inside = F.sum("_v").over(Window.partitionBy("recording", "_b").orderBy("n").rowsBetween(0, Window.unboundedFollowing))
    return s.withColumn("_in", inside).join(after, ["recording", "_b"]).withColumn("left", F.col("_in") + F.col("_after")).drop("_v", "_b", "_in", "_after")


def from_direct_sound(impulse: DataFrame) -> DataFrame:
    """``recording, n, x, available, direct`` from the first sample within 20 dB of the peak on; n counts from there."""
    peaks = impulse.groupBy("recording").agg(F.max(F.abs("x")).alias("peak"), F.max("n").alias("last"))
    j = impulse.select("recording", "n", "x").join(peaks, "recording")
    first = j.filter(F.abs("x") >= F.col("peak") * 0.1).groupBy("recording").agg(F.min("n").alias("direct"))
    return j.join(first, "recording").filter("n >= direct").select("recording", (F.col("n") - F.col("direct")).alias("n"), "x", (F.col("last") + 1 - F.col("direct")).alias("available"), "direct")


def usable_frames(y: DataFrame) -> DataFrame:
    """``recording, available, usable``: up to the first window whose energy is less than ten times that of the last tenth."""
    e = F.col("x") * F.col("x")
    tail = F.col("available") - F.floor(F.col("available") / 10)
    noise = y.groupBy("recording", "available").agg(F.avg(F.when(F.col("n") >= tail, e)).alias("noise"))
    window = F.greatest(F.lit(64), F.floor(F.col("available") / 200)).cast("long")
    w = y.withColumn("w", F.floor(F.col("n") / window).cast("long")).groupBy("recording", "available", "w").agg(F.avg(e).alias("energy"), F.count("*").alias("c"))
    low = w.filter(F.col("c") == window).join(noise.select("recording", "noise"), "recording").filter((F.col("noise") > 0) & (F.col("energy") < 10 * F.col("noise")) & (F.col("available") >= 20))
    cut = low.groupBy("recording").agg(F.min(F.col("w") * window).alias("cut"))
    return noise.join(cut, "recording", "left").select("recording", "available", F.coalesce("cut", "available").alias("usable"))


def curve(y: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """``recording, n, level_db``: what is left from each sample on (with the energy of ``tail(recording, tail)`` behind it), in dB of the whole."""
    t = y.join(tail, "recording", "left") if tail is not None else y.withColumn("tail", F.lit(0.0))
    c = remaining(t, F.col("x") * F.col("x")).withColumn("left", F.col("left") + F.coalesce("tail", F.lit(0.0)))
    whole = t.groupBy("recording").agg((F.sum(F.col("x") * F.col("x")) + F.coalesce(F.max("tail"), F.lit(0.0))).alias("whole"))
    c = c.join(whole, "recording")
    return c.filter("whole > 0").select("recording", "n", db(F.least(F.col("left") / F.col("whole"), F.lit(1.0)), 10.0).alias("level_db"))


def slope(decay: DataFrame, top: float, bottom: float) -> DataFrame:
    """``recording, slope``: dB a sample by least squares from the first sample at ``top`` to the first at ``bottom``; nothing without three samples between or a fall."""
    first = decay.groupBy("recording").agg(F.min(F.when(F.col("level_db") <= top, F.col("n"))).alias("a"), F.min(F.when(F.col("level_db") <= bottom, F.col("n"))).alias("b")).filter("b > a + 2")
    part = decay.join(first, "recording").filter("n BETWEEN a AND b").withColumn("i", (F.col("n") - F.col("a")).cast("double"))
    c, i, v = F.count("*"), F.col("i"), F.col("level_db")
    fit = (c * F.sum(i * v) - F.sum(i) * F.sum(v)) / F.nullif(c * F.sum(i * i) - F.sum(i) * F.sum(i), F.lit(0.0))
    return part.groupBy("recording").agg(fit.alias("slope")).filter("slope < 0")


def tail_energy(y: DataFrame, frames: DataFrame) -> DataFrame:
    """``recording, tail``: what a straight decay would still bring after the end, for 64 samples or more."""
    steep = slope(curve(y), -5.0, -20.0)
    j = y.join(frames.select("recording", F.col("frames").alias("_f")), "recording").filter("_f >= 64")
    window = F.greatest(F.lit(32), F.floor(F.col("_f") / 100)).cast("long")
    end = j.filter(F.col("n") >= F.col("_f") - window).groupBy("recording").agg(F.avg(F.col("x") * F.col("x")).alias("end"))
    return end.join(steep, "recording").select("recording", (F.col("end") * (-10.0 / (F.col("slope") * math.log(10.0)))).alias("tail"))


def schroeder_from_direct(impulse: DataFrame) -> DataFrame:
    """The decay curve from the direct sound to the end, with the tail that it points to."""
    y = Scratch(impulse.sparkSession, "room").keep(from_direct_sound(impulse), "direct")
    return curve(y, tail_energy(y, y.select("recording", F.col("available").alias("frames")).distinct()))


def room(impulse: DataFrame, rate: float) -> DataFrame:
    """``recording, valid, edt, t20, t30, c50_db, c80_db, d50, centre_time, usable_range_db, direct``; what has no range is null.

    Samples from the direct sound on, the usable part and its decay are read several times, so each is written once."""
    scratch = Scratch(impulse.sparkSession, "room")
    y = scratch.keep(from_direct_sound(impulse), "direct")
    frames = scratch.keep(usable_frames(y), "frames")
    ok = frames.filter("available >= 16 AND usable >= 16")
    used = scratch.keep(y.join(ok.select("recording", "usable"), "recording").filter("n < usable").drop("usable"), "used")
    decay = scratch.keep(curve(used, tail_energy(used, ok.select("recording", F.col("usable").alias("frames")))), "decay")
    times = ok.select("recording")
    for name, top, bottom in (("edt", 0.0, -10.0), ("t20", -5.0, -25.0), ("t30", -5.0, -35.0)):
        times = times.join(slope(decay, top, bottom).select("recording", (-60 / F.col("slope") / rate).alias(name)), "recording", "left")
    low = decay.groupBy("recording").agg((-F.min("level_db")).alias("usable_range_db")).filter(F.col("usable_range_db") > FLOOR_DB)
    e = F.col("x") * F.col("x")
    early = lambda ms: F.sum(F.when(F.col("n") < int(rate * ms / 1000), e).otherwise(0.0))
    t = y.groupBy("recording", "direct").agg(early(50).alias("e50"), early(80).alias("e80"), F.sum(e).alias("all"), F.sum(e * F.col("n") / rate).alias("moment"))
    late = lambda k: F.col("all") - F.col(k)
    split = lambda k: F.when(late(k) > 1e-15 * F.col("all"), 10 * F.log10(F.col(k) / late(k)))
    out = t.join(times, "recording", "left").join(low, "recording", "left")
    valid = F.col("usable_range_db").isNotNull()
    return out.select("recording", valid.alias("valid"), "edt", "t20", "t30", split("e50").alias("c50_db"), split("e80").alias("c80_db"), (F.col("e50") / F.col("all")).alias("d50"), (F.col("moment") / F.col("all")).alias("centre_time"), "usable_range_db", "direct")


def match_bands(nominal: DataFrame, filters: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Each nominal band with the filter whose centre lies within 2 % of it (none: null)."""
    return nominal.join(F.broadcast(filters), F.abs(F.col("filter_centre") - F.col("centre")) <= F.col("centre") * tolerance, "left")  # some thirty rows each
