"""Multi-resolution roll-ups: peak pyramids, their queries, and folded magnitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import levels


def peak_level(samples: DataFrame, size: int = 256) -> DataFrame:
    """``channel, level, idx, min, max, sq, frames`` of the finest level."""
    return samples.groupBy("channel", F.floor(F.col("n") / size).cast("long").alias("idx")).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("frames")).withColumn("level", F.lit(0))


def peak_pyramid(samples: DataFrame, levels: int = 4, size: int = 256) -> DataFrame:
    """All levels, each half as fine as the one below; parents weigh their children by true sample counts."""
    base = peak_level(samples, size)
    all_ = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("idx", F.expr("shiftright(idx, level)"))
    out = all_.groupBy("channel", "level", "idx").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sq").alias("sq"), F.sum("frames").alias("frames"))
    return out.select("channel", "level", "idx", "min", "max", F.sqrt(F.col("sq") / F.col("frames")).alias("rms"), "frames")


def peak_store(samples: DataFrame, size: int = 256, root: str | None = None) -> levels.Levels:
    """All levels of the peak pyramid of ``recording, channel, n, x`` as a stored table; ``size`` (a power of two) is the width of the finest."""
    if size < 2 or size & (size - 1):
        raise ValueError("the finest bin is a power of two of at least 2 samples")
    base = samples.groupBy("recording", "channel", F.floor(F.col("n") / size).cast("long").alias("idx")).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("frames"))
    fold = lambda g: g.agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sq").alias("sq"), F.sum("frames").alias("frames"))
    return levels.store(base, ["recording", "channel"], fold, size, root)


def peak_columns(stored: levels.Levels, start: int, stop: int, columns: int) -> DataFrame:
    """``recording, channel, column, min, max, rms``: of each column of a range all bins that it touches, of the coarsest level that isn't coarser than a column."""
    own = stored.touched(start, stop, columns)
    return own.groupBy("recording", "channel", "column").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sqrt(F.sum("sq") / F.sum("frames")).alias("rms"))


def peak_query(samples: DataFrame, start: int, stop: int, columns: int) -> DataFrame:
    """Min, max and RMS for each of so many columns of a range."""
    part = samples.filter((F.col("n") >= start) & (F.col("n") < stop))
    col = F.floor((F.col("n") - start) * columns / (stop - start)).cast("long")
    return part.groupBy("channel", col.alias("column")).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def runs(samples: DataFrame, predicate, least: int = 1) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive samples of a recording for which the predicate holds."""
    w = Window.partitionBy("recording").orderBy("n")
    held = samples.filter(predicate).withColumn("island", F.col("n") - F.row_number().over(w))
    out = held.groupBy("recording", "island").agg(F.min("n").alias("start"), F.count("*").alias("length"), F.max(F.abs("x")).alias("peak"))
    return out.filter(F.col("length") >= least).drop("island")


def magnitude_fold(mags: DataFrame, levels: int = 3) -> DataFrame:
    """The overview of ``frame, bin, mag``: the larger of each pair of frames, level by level."""
    out = mags.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("frame", F.expr("shiftright(frame, level)"))
    return out.groupBy("level", "frame", "bin").agg(F.max("mag").alias("mag"))
