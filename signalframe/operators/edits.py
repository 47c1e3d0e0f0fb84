"""Edits of an edit decision list, all non-destructive, as projections of the clip table.

``clips(clip_id, source_id, source_start, timeline_start, length, gain[, fade_in, fade_out])``; fades are lengths in frames.
An edit table names clips and what to do; what a clip can't bear leaves it as it was, with the reason in ``error``.
New clips and sources share one counter, ``next_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import number
from .timeline import delete_range, insert_silence, render, split_at

MOST_GAIN = 1000.0


def _end() -> Column:
    return F.col("timeline_start") + F.col("length")


def _first(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for wrong, text in reversed(cases):
        out = F.when(wrong, F.lit(text)).otherwise(out)
    return out


def _changed(df: DataFrame, error: Column, new: dict[str, Column]) -> DataFrame:
    """``df`` with the new values where there is no error."""
    df = df.withColumn("error", error)
    return df.withColumns({k: F.when(F.col("error").isNull(), v).otherwise(F.col(k)) for k, v in new.items()})


def append_sources(new: DataFrame, next_id: int, duration: int) -> tuple[DataFrame, DataFrame]:
    """(sources, clips) for ``new(name, frames)`` laid end to end after ``duration``, in the order of names; an id goes to each source and then to its clip."""
    w = Window.orderBy("name")  # what one edit brings in: a list of files
    r = new.withColumn("rank", F.row_number().over(w) - 1).withColumn("before", F.sum("frames").over(w) - F.col("frames"))
    source = (F.lit(next_id) + 2 * F.col("rank")).cast("long")
    sources = r.select(source.alias("source_id"), "name", "frames")
    clips = r.select((source + 1).alias("clip_id"), source.alias("source_id"), F.lit(0).cast("long").alias("source_start"), (F.lit(duration) + F.col("before")).cast("long").alias("timeline_start"), F.col("frames").alias("length"), F.lit(1.0).alias("gain"))
    return sources, clips


def trim(clips: DataFrame, edits: DataFrame, sources: DataFrame) -> DataFrame:
    """``edits(clip_id, new_start, new_length)``: the window moves over the source with the clip's start, so the audio stays put; fades are clipped to the length."""
    j = clips.join(edits, "clip_id", "left").join(sources.select("source_id", F.col("frames").alias("_frames")), "source_id", "left")
    at = F.col("source_start") + F.col("new_start") - F.col("timeline_start")
    error = _first(
        (F.col("new_length") <= 0, "length must be positive"), (F.col("new_start") < 0, "start is negative"), (at < 0, "starts before the source"), (at + F.col("new_length") > F.col("_frames"), "ends after the source")
    )
    wanted = F.col("new_length").isNotNull()
    new = {"source_start": F.when(wanted, at).otherwise(F.col("source_start"))}
    for k in ("fade_in", "fade_out"):
        if k in clips.columns:
            new[k] = F.least(F.col(k), F.coalesce("new_length", k))
    new |= {"timeline_start": F.coalesce("new_start", "timeline_start"), "length": F.coalesce("new_length", "length")}
    out = _changed(j, error, {k: new[k] for k in new if k not in ("timeline_start",)} | {"timeline_start": new["timeline_start"]})
    return out.select(*clips.columns, "error")


def move(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(clip_id, new_start)``."""
    out = _changed(clips.join(edits, "clip_id", "left"), _first((F.col("new_start") < 0, "position is negative")), {"timeline_start": F.coalesce("new_start", "timeline_start")})
    return out.select(*clips.columns, "error")


def duplicate(clips: DataFrame, edits: DataFrame, next_id: int) -> DataFrame:
    """The clips and their copies at ``edits(clip_id, new_start)``; copies are numbered in the order of the clips that they copy."""
    made = edits.filter("new_start >= 0").join(clips, "clip_id")
    made = number(made, ["clip_id", "new_start"], "_rank")  # in ranges: no task gets all copies
    copies = made.withColumn("_id", (F.lit(next_id) + F.col("_rank")).cast("long")).drop("_rank").withColumn("timeline_start", F.col("new_start")).drop("clip_id", "new_start").withColumnRenamed("_id", "clip_id")
    return clips.unionByName(copies.select(*clips.columns))


def set_gain(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(clip_id, new_gain)``, from 0 to 1000."""
    g = F.col("new_gain")
    out = _changed(clips.join(edits, "clip_id", "left"), _first((F.isnan(g) | (g < 0) | (g > MOST_GAIN), "gain must lie between 0 and 1000")), {"gain": F.coalesce(g, F.col("gain"))})
    return out.select(*clips.columns, "error")


def set_fades(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(clip_id, new_in, new_out)``: together no longer than the clip."""
    a, b = F.col("new_in"), F.col("new_out")
    error = _first(((a < 0) | (b < 0), "fades must not be negative"), (a + b > F.col("length"), "fades exceed the clip"))
    return _changed(clips.join(edits, "clip_id", "left"), error, {"fade_in": F.coalesce(a, F.col("fade_in")), "fade_out": F.coalesce(b, F.col("fade_out"))}).select(*clips.columns, "error")


def crossfade(clips: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(first, second, cross)``, each clip in one pair at most: the later clip is pulled back so that the two overlap; its head is trimmed by the same shift, and matching fades are set."""
    side = lambda k: clips.select(F.col("clip_id").alias(k), F.struct(F.col("timeline_start").alias("s"), F.col("length").alias("l"), F.col("clip_id").alias("id")).alias(f"_{k}"))
    j = pairs.join(side("first"), "first").join(side("second"), "second")
    turned = F.col("_first.s") > F.col("_second.s")
    j = j.select("cross", F.when(turned, F.col("_second")).otherwise(F.col("_first")).alias("a"), F.when(turned, F.col("_first")).otherwise(F.col("_second")).alias("b"))
    shift = F.col("b.s") - (F.col("a.s") + F.col("a.l") - F.col("cross"))
    error = _first(
        (F.col("cross") <= 0, "length must be positive"), ((F.col("cross") > F.col("a.l")) | (F.col("cross") > F.col("b.l")), "longer than one of the clips"), (F.col("b.l") - shift <= 0, "would consume the second clip")
    )
    j = j.withColumn("shift", shift).withColumn("error", error)
    per_clip = j.select(F.explode(F.array(F.struct(F.col("a.id").alias("clip_id"), F.lit(True).alias("earlier")), F.struct(F.col("b.id").alias("clip_id"), F.lit(False).alias("earlier")))).alias("v"), "shift", "cross", "error").select("v.*", "shift", "cross", "error")
    k = clips.join(per_clip, "clip_id", "left")
    ok = F.col("earlier").isNotNull() & F.col("error").isNull()
    late = ok & ~F.col("earlier")
    moved = {"timeline_start": -F.col("shift"), "source_start": F.col("shift"), "length": -F.col("shift")}
    k = k.withColumns({c: F.when(late, F.col(c) + d).otherwise(F.col(c)) for c, d in moved.items()} | {"fade_in": F.when(late, F.col("cross")).otherwise(F.col("fade_in")), "fade_out": F.when(ok & F.col("earlier"), F.col("cross")).otherwise(F.col("fade_out"))})
    return k.select(*clips.columns, "error")


def range_gain(clips: DataFrame, start: int, stop: int, factor: float) -> DataFrame:
    """Split at both ends, then multiply the clips inside; a clip whose gain would pass 1000 keeps its own and says so."""
    if stop <= start or not factor >= 0:
        raise ValueError("an empty range or a negative factor")
    cut = _two_splits(clips, start, stop)
    inside = (F.col("timeline_start") >= start) & (_end() <= stop)
    return _changed(cut, _first((inside & (F.col("gain") * factor > MOST_GAIN), "gain must lie between 0 and 1000")), {"gain": F.when(inside, F.col("gain") * factor).otherwise(F.col("gain"))})


def _two_splits(clips: DataFrame, start: int, stop: int) -> DataFrame:
    once = split_at(clips, start).withColumn("_first", F.col("part")).drop("part")
    return split_at(once, stop).withColumn("part", (2 * F.col("_first") + F.col("part")).cast("int")).drop("_first")


def replace_range(clips: DataFrame, start: int, stop: int, source_id: int, clip_id: int) -> DataFrame:
    """What lay in the range goes without a ripple; one clip of a new source takes its place."""
    if start < 0 or stop <= start:
        raise ValueError("nothing to place")
    left = delete_range(clips, start, stop, ripple=False).drop("part")
    fades = ["0L AS fade_in", "0L AS fade_out"] if "fade_in" in clips.columns else []
    new = clips.sparkSession.range(1).selectExpr(f"{clip_id}L AS clip_id", f"{source_id}L AS source_id", "0L AS source_start", f"{start}L AS timeline_start", f"{stop - start}L AS length", "1.0D AS gain", *fades)
    return left.unionByName(new.select(*left.columns))


def flatten_range(clips: DataFrame, sources: DataFrame, start: int, stop: int, source_id: int, clip_id: int) -> tuple[DataFrame, DataFrame]:
    """(clips, sources): the range as it sounds becomes a source of its own and one clip."""
    sound = render(clips, sources, start, stop).select(F.lit(source_id).cast("long").alias("source_id"), (F.col("n") - start).alias("n"), "x")
    return replace_range(clips, start, stop, source_id, clip_id), sources.select("source_id", "n", "x").unionByName(sound)


def range_fade(clips: DataFrame, start: int, stop: int, fading_in: bool) -> tuple[DataFrame, int]:
    """(clips, clips inside): splits at both ends; where one clip lies inside, its fade spans it.  More than one have to be flattened first."""
    cut = _two_splits(clips, start, stop)
    inside = (F.col("timeline_start") >= start) & (_end() <= stop)
    n = cut.filter(inside).count()
    if n != 1:
        return cut, n
    k, other = ("fade_in", "fade_out") if fading_in else ("fade_out", "fade_in")
    fits = inside & (F.col(other) == 0)  # both fades together can't exceed the clip
    return cut.withColumn(k, F.when(fits, F.col("length")).otherwise(F.col(k))), n


def cut_range(clips: DataFrame, sources: DataFrame, start: int, stop: int) -> tuple[DataFrame, DataFrame]:
    """(clips after the cut, clipboard ``n, x``)."""
    board = render(clips, sources, start, stop).select((F.col("n") - start).alias("n"), "x")
    return delete_range(clips, start, stop).drop("part"), board


def paste(clips: DataFrame, at: int, frames: int, source_id: int, clip_id: int) -> DataFrame:
    """Room is made at the position, and a clip of the clipboard's source fills it."""
    return replace_range(insert_silence(clips, at, frames).drop("part"), at, at + frames, source_id, clip_id)


def keep_range(clips: DataFrame, start: int, stop: int, duration: int) -> DataFrame:
    """Trim to a selection: delete behind it, then before it."""
    out = delete_range(clips, stop, duration).drop("part") if stop < duration else clips
    return delete_range(out, 0, start).drop("part") if start > 0 else out


def insert_ordered(clips: DataFrame, more: DataFrame) -> DataFrame:
    """The list with more clips, and each one's place by (timeline start, id) within its source's track."""
    both = clips.unionByName(more)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("timeline_start", "clip_id")).cast("long"))


def intersect(a: DataFrame, b: DataFrame, size: int = 4096) -> DataFrame:
    """``id, other, start, stop``: the common part of each pair of overlapping ranges ``(id, start, stop)``; pairs meet once, in the block where their common part begins."""
    touched = lambda df: df.filter("stop > start").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    j = touched(a).join(touched(b).select("block", F.col("id").alias("other"), F.col("start").alias("s2"), F.col("stop").alias("e2")), "block")
    start, stop = F.greatest("start", "s2"), F.least("stop", "e2")
    return j.filter((start < stop) & (F.floor(start / size) == F.col("block"))).select("id", "other", start.alias("start"), stop.alias("stop"))


def shift_markers(markers: DataFrame, start: int, stop: int | None = None, length: int | None = None) -> DataFrame:
    """Markers under a rippling deletion of [start, stop) (those inside move to its start) or an insertion of ``length`` at ``start``."""
    p = F.col("position")
    if length is not None:
        return markers.withColumn("position", F.when(p >= start, p + length).otherwise(p))
    return markers.withColumn("position", F.when(p >= stop, p - (stop - start)).when(p >= start, F.lit(start).cast("long")).otherwise(p))


def unwritten(sources: DataFrame, folder: str) -> DataFrame:
    """What consolidating has to write: each source that lives in memory only, with the file that it will get beside the session."""
    name = F.concat(F.regexp_replace(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("source")), "[^A-Za-z0-9._-]+", "_"), F.lit("-"), F.col("source_id").cast("string"), F.lit(".wav"))
    return sources.filter(F.coalesce("path", F.lit("")) == "").withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), name))
