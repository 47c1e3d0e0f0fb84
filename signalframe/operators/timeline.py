"""The timeline: rendering as an interval join, and edits as projections.

Joins of intervals go by equal block numbers, so that they hash; the exact bounds are a filter behind that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .channels import fade

BLOCK = 4096


def overlapping(clips: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Clips that overlap ``blocks(block)`` of the given size: the clip names the blocks that it touches."""
    end = F.col("timeline_start") + F.col("length")
    touched = F.explode(F.sequence(F.floor(F.col("timeline_start") / size).cast("long"), F.floor((end - 1) / size).cast("long"))).alias("block")
    return clips.filter("length > 0").select("*", touched).join(blocks, "block")


def render(clips: DataFrame, sources: DataFrame, start: int, stop: int, shape: str = "linear") -> DataFrame:
    """``n, x`` over [start, stop): overlapping clips add up under their gains and fades, a missing source is silence, the region starts as zeros.

    ``clips(clip_id, source_id, source_start, timeline_start, length, gain[, fade_in, fade_out])``, ``sources(source_id, n, x)``.
    Sources are packed into chunks, a clip meets the chunks that it plays, and only samples that sound are laid out."""
    part = clips.filter((F.col("timeline_start") < stop) & (F.col("timeline_start") + F.col("length") > start) & (F.col("length") > 0))
    zero = F.lit(0).cast("long")
    fades = [F.col(c) if c in clips.columns else zero.alias(c) for c in ("fade_in", "fade_out")]
    first, last = F.floor(F.col("source_start") / BLOCK), F.floor((F.col("source_start") + F.col("length") - 1) / BLOCK)
    plays = part.select("source_id", "timeline_start", "gain", "source_start", "length", *fades, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk"))
    chunks = sources.groupBy("source_id", F.floor(F.col("n") / BLOCK).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("xs"))
    # only what the clip plays of a chunk becomes rows
    heard = lambda v: (v["n"] >= F.col("source_start")) & (v["n"] < F.col("source_start") + F.col("length")) & (v["n"] + F.col("timeline_start") - F.col("source_start")).between(start, stop - 1)
    sound = plays.join(chunks, ["source_id", "chunk"]).withColumn("v", F.explode(F.filter("xs", heard)))
    offset = F.col("v.n") - F.col("source_start")
    n = F.col("timeline_start") + offset
    level = clip_gain(offset, F.col("length"), F.col("gain"), F.col("fade_in"), F.col("fade_out"), shape)
    played = sound.select(n.alias("n"), (level * F.col("v.x")).alias("x"))
    grid = clips.sparkSession.range(start, stop).select(F.col("id").alias("n"), F.lit(0.0).alias("x"))
    return grid.unionAll(played).groupBy("n").agg(F.sum("x").alias("x"))


def duration(clips: DataFrame) -> int:
    return clips.agg(F.max(F.col("timeline_start") + F.col("length"))).first()[0] or 0


def clip_gain(offset, length, gain, fade_in, fade_out, shape: str = "linear"):
    """Gain at an offset of a clip: its own, times both fades (a fade-out runs from its start to the clip's end)."""
    rise = F.when((fade_in > 0) & (offset < fade_in), fade(shape, offset / fade_in)).otherwise(1.0)
    left = length - offset
    fall = F.when((fade_out > 0) & (left <= fade_out), fade(shape, left / fade_out)).otherwise(1.0)
    return gain * rise * fall


def split_at(clips: DataFrame, position: int) -> DataFrame:
    """Clips that hold the position strictly inside become two; the right one starts later in its source, and the fades at the cut go."""
    inside = (F.col("timeline_start") < position) & (F.col("timeline_start") + F.col("length") > position)
    cut = F.lit(position) - F.col("timeline_start")
    piece = lambda a, s, n, k: F.struct(a.alias("timeline_start"), s.alias("source_start"), n.alias("length"), F.lit(k).alias("part"))
    whole = piece(F.col("timeline_start"), F.col("source_start"), F.col("length"), 0)
    two = F.array(piece(F.col("timeline_start"), F.col("source_start"), cut, 0), piece(F.lit(position).cast("long"), F.col("source_start") + cut, F.col("length") - cut, 1))
    keep = [c for c in clips.columns if c not in ("timeline_start", "source_start", "length")]
    rows = clips.select(*keep, inside.alias("_inside"), F.explode(F.when(inside, two).otherwise(F.array(whole))).alias("p"))
    inside = F.col("_inside")
    cleared = [F.when(inside & (F.col("p.part") == {"fade_out": 0, "fade_in": 1}[c]), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) if c in ("fade_in", "fade_out") else F.col(c) for c in keep]
    return rows.select(*cleared, "p.*")


def delete_range(clips: DataFrame, start: int, stop: int, ripple: bool = True) -> DataFrame:
    """What is left of each clip outside [start, stop): none, one or two pieces; with ripple, later ones move up."""
    a, n = F.col("timeline_start"), F.col("length")
    b = a + n
    shift = F.lit(stop - start if ripple else 0).cast("long")
    piece = lambda at, s, k, i: F.struct(at.alias("timeline_start"), s.alias("source_start"), k.alias("length"), F.lit(i).alias("part"))
    left = piece(a, F.col("source_start"), F.least(b, F.lit(start)) - a, 0)
    first = F.greatest(a, F.lit(stop))
    right = piece(first - F.when(b > stop, shift).otherwise(0), F.col("source_start") + (first - a), b - first, 1)
    keep = [c for c in clips.columns if c not in ("timeline_start", "source_start", "length")]
    spans, cut = (a < start) & (b > stop), (a < stop) & (b > start)
    rows = clips.select(*keep, spans.alias("_spans"), cut.alias("_cut"), F.explode(F.array(left, right)).alias("p")).filter("p.length > 0")

    def fades(c):
        """Inside a clip the cut clears fades; at a trimmed edge they can't outlast the clip."""
        own = F.col("_cut") & (F.col("p.part") == {"fade_out": 0, "fade_in": 1}[c])
        return F.when(own & F.col("_spans"), F.lit(0).cast("long")).when(own, F.least(F.col(c), F.col("p.length"))).otherwise(F.col(c)).alias(c)

    return rows.select(*(fades(c) if c in ("fade_in", "fade_out") else F.col(c) for c in keep), "p.*")


def insert_silence(clips: DataFrame, position: int, length: int) -> DataFrame:
    out = split_at(clips, position)
    return out.withColumn("timeline_start", F.when(F.col("timeline_start") >= position, F.col("timeline_start") + length).otherwise(F.col("timeline_start")))
