"""Sessions as JSON: explicit schemas both ways, warnings in place of lost entries; and undo as versioned snapshots."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
SCHEMA = (
    "format string, version int, sampleRate double, channels int, nextId long, sources array<struct<id:long,name:string,path:string,frameCount:long,sourceSampleRate:double,sourceChannels:int>>, "
    "clips array<struct<id:long,source:long,sourceStart:long,length:long,timelineStart:long,gain:double,fadeIn:struct<length:long,shape:string>,fadeOut:struct<length:long,shape:string>,name:string>>, "
    "markers array<struct<position:long,length:long,label:string>>"
)


def stored_path(path: str, folder: str) -> str:
    """Relative to the session's folder unless it would climb out of it."""
    if not path:
        return ""
    out = posixpath.relpath(path, folder)
    return path if out.startswith("..") else out


def _fades(clips: DataFrame) -> list:
    """Fades as structs of length and shape, as far as the clips have them."""
    shape = lambda c: F.col(f"{c}_shape") if f"{c}_shape" in clips.columns else F.lit("linear")
    return [F.struct(F.col(c).cast("long").alias("length"), shape(c).alias("shape")).alias(k) for c, k in (("fade_in", "fadeIn"), ("fade_out", "fadeOut")) if c in clips.columns]


def save(spark: SparkSession, sources: DataFrame, clips: DataFrame, markers: DataFrame, rate: float, channels: int, format_tag: str = "signalframe-session") -> DataFrame:
    """``session_id, json``: each session in the order of ids, clips by (timeline start, id).  All three tables carry ``session_id``."""
    part = lambda df, order, fields: df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("v")))).alias("a")).select("session_id", F.transform("a", lambda x: x["v"]).alias("a"))
    s = part(sources, ["source_id"], [F.col("source_id").alias("id"), "name", "path", F.col("frame_count").alias("frameCount"), F.col("source_sample_rate").alias("sourceSampleRate"), F.col("source_channels").alias("sourceChannels")])
    c = part(clips, ["timeline_start", "clip_id"], [F.col("clip_id").alias("id"), F.col("source_id").alias("source"), F.col("source_start").alias("sourceStart"), "length", F.col("timeline_start").alias("timelineStart"), "gain", *_fades(clips), *([F.col("name")] if "name" in clips.columns else [])])
    m = part(markers, ["position"], ["position", "length", "label"])
    rows = s.withColumnRenamed("a", "sources").join(c.withColumnRenamed("a", "clips"), "session_id", "full").join(m.withColumnRenamed("a", "markers"), "session_id", "full")
    rows = rows.withColumns({k: F.coalesce(k, F.array().cast(rows.schema[k].dataType)) for k in ("sources", "clips", "markers")})
    last = F.greatest(F.lit(0).cast("long"), F.array_max(F.transform("sources", lambda x: x["id"])), F.array_max(F.transform("clips", lambda x: x["id"])))
    whole = F.struct(F.lit(format_tag).alias("format"), F.lit(VERSION).alias("version"), F.lit(float(rate)).alias("sampleRate"), F.lit(channels).alias("channels"), (last + 1).alias("nextId"), "sources", "clips", "markers")
    return rows.select("session_id", F.to_json(whole).alias("json"))


def load(sessions: DataFrame, known_paths: DataFrame | None = None, format_tag: str = "signalframe-session") -> dict[str, DataFrame]:
    """``sources, clips, markers, warnings`` of ``sessions(session_id, json)``.

    A newer version or another format gives only a warning; clips of unknown sources or without length are dropped with one;
    sources whose path isn't in ``known_paths(path)`` are marked missing (they render as silence)."""
    p = sessions.select("session_id", F.from_json("json", SCHEMA).alias("s"))
    good = p.filter((F.col("s.format") == format_tag) & (F.col("s.version") <= VERSION))
    refused = p.filter(~F.coalesce((F.col("s.format") == format_tag) & (F.col("s.version") <= VERSION), F.lit(False))).select("session_id", F.lit("not a session of this version").alias("warning"))
    sources = good.select("session_id", F.explode("s.sources").alias("x")).select("session_id", F.col("x.id").alias("source_id"), "x.name", "x.path", F.col("x.frameCount").alias("frame_count"), F.col("x.sourceSampleRate").alias("source_sample_rate"), F.col("x.sourceChannels").alias("source_channels"))
    if known_paths is not None:
        sources = sources.join(known_paths.select("path").distinct().withColumn("found", F.lit(True)), "path", "left").withColumn("missing", F.col("found").isNull()).drop("found")
    clips = good.select("session_id", F.explode("s.clips").alias("x")).select("session_id", F.col("x.id").alias("clip_id"), F.col("x.source").alias("source_id"), F.col("x.sourceStart").alias("source_start"), "x.length", F.col("x.timelineStart").alias("timeline_start"), F.coalesce("x.gain", F.lit(1.0)).alias("gain"), *(v for a, b in (("fadeIn", "fade_in"), ("fadeOut", "fade_out")) for v in (F.coalesce(F.col(f"x.{a}.length"), F.lit(0).cast("long")).alias(b), F.coalesce(F.col(f"x.{a}.shape"), F.lit("linear")).alias(f"{b}_shape"))), F.col("x.name").alias("name"))
    whole = clips.filter("length > 0 AND timeline_start >= 0")
    broken = clips.filter("NOT coalesce(length > 0 AND timeline_start >= 0, false)").select("session_id", F.lit("a clip is malformed").alias("warning"))
    keys = sources.select("session_id", "source_id").distinct()
    orphans = whole.join(keys, ["session_id", "source_id"], "left_anti").select("session_id", F.lit("a clip names an unknown source").alias("warning"))
    markers = good.select("session_id", F.explode("s.markers").alias("x")).select("session_id", "x.*")
    return {"sources": sources, "clips": whole.join(keys, ["session_id", "source_id"], "left_semi"), "markers": markers, "warnings": refused.union(broken).union(orphans)}


def commit(history: DataFrame, state: DataFrame, label: str, at: int, depth: int = 128) -> DataFrame:
    """``history(version, label, ...)`` up to ``at`` with the state as the next version; versions beyond the depth go."""
    kept = history.filter((F.col("version") <= at) & (F.col("version") > at + 1 - depth))
    return kept.unionByName(state.withColumns({"version": F.lit(at + 1), "label": F.lit(label)}))


def snapshot(history: DataFrame, version: int) -> DataFrame:
    """Undo and redo are other versions of the same table."""
    return history.filter(F.col("version") == version).drop("version", "label")


def coalesced(edits: DataFrame, depth: int = 128) -> DataFrame:
    """``version, label, edits`` of ``edits(n, label)``: consecutive edits with one label are one version, and the newest ``depth`` stay.

    A version begins where the label before differs; each edit's version is the number of beginnings up to it, counted in
    blocks of edits whose sums are added up first."""
    before = edits.select((F.col("n") + 1).alias("n"), F.col("label").alias("previous"))
    begins = edits.join(before, "n", "left").withColumn("begin", (~F.col("label").eqNullSafe(F.col("previous")) | (F.col("n") == 0)).cast("long")).withColumn("block", F.floor(F.col("n") / 65536))
    sums = begins.groupBy("block").agg(F.sum("begin").alias("s"))
    upto = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("upto"))  # a row for 65,536 edits
    inside = F.sum("begin").over(Window.partitionBy("block").orderBy("n"))
    versions = begins.withColumn("inside", inside).join(F.broadcast(upto), "block").groupBy((F.col("upto") + F.col("inside")).alias("version"), "label").agg(F.count("*").alias("edits"))
    last = versions.agg(F.max("version").alias("last"))
    return versions.join(F.broadcast(last)).filter(F.col("version") > F.col("last") - depth).select("version", "label", "edits")
