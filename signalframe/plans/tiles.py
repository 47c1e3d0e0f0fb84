"""Spectrogram views, tiles and a store of tiles that checks what it reads.

``q(frame, bin, q)`` are eight-bit magnitudes.  Tiles are partitions of a Parquet table; the overview is the fold of
``pyramids.magnitude_fold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import number
from . import levels
from ..scratch import Scratch


PART, SPREAD = 1024, 16  # samples of a block that keys look at, and how many are spread over a recording


def view(q: DataFrame, frames: int, bins: int, columns: int, rows: int) -> DataFrame:
    """``column, row, q``: the largest of the frames of a column and of a row's bins; with less than a bin to a row, between the two nearest bins."""
    column = F.floor(F.col("frame") * columns / frames).cast("long").alias("column")
    spark = q.sparkSession
    if rows <= bins:
        edges = [(r, b) for r in range(rows) for b in range(r * bins // rows, max(r * bins // rows + 1, -(-(r + 1) * bins // rows)))]
        own = spark.createDataFrame(edges, "row int, bin long")  # each bin's rows: at most two
        return q.join(F.broadcast(own), "bin").groupBy(column, "row").agg(F.max("q").alias("q"))
    places = []
    for r in range(rows):
        p = (r + 0.5) * bins / rows - 0.5
        a = int(p // 1)
        clip = lambda b: max(0, min(bins - 1, b))
        places += [(r, clip(a), 1 - (p - a), 0), (r, clip(a + 1), p - a, 1)]
    near = spark.createDataFrame(places, "row int, bin long, w double, side int")
    mixed = q.join(F.broadcast(near), "bin").groupBy("frame", "row").agg(F.floor(F.sum(F.col("q") * F.col("w")) + 0.5).cast("int").alias("q"))
    return mixed.groupBy(column, "row").agg(F.max("q").alias("q"))


def overview(q: DataFrame, root: str | None = None) -> levels.Levels:
    """All levels of ``frame, bin, q`` as a stored table, each frame of a level the louder of two below."""
    base = q.select("bin", F.col("frame").alias("idx"), "q")
    return levels.store(base, ["bin"], lambda g: g.agg(F.max("q").alias("q")), 1, root)


def overview_view(stored: levels.Levels, start: int, stop: int, bins: int, columns: int, rows: int) -> DataFrame:
    """``column, row, q`` of a range of frames, from the frames that its columns touch in one level: the detail itself once a column is a frame wide."""
    edges = [(r, b) for r in range(rows) for b in range(r * bins // rows, max(r * bins // rows + 1, -(-(r + 1) * bins // rows)))]
    own = stored.spark.createDataFrame(edges, "row int, bin long")  # each bin's rows: at most two
    return stored.touched(start, stop, columns).join(F.broadcast(own), "bin").groupBy("column", "row").agg(F.max("q").alias("q"))


def write(q: DataFrame, size: int = 1024) -> DataFrame:
    """``q`` as a table partitioned by tiles of ``size`` frames, read back with ``tile``: a query for some tiles reads their files only."""
    scratch = Scratch(q.sparkSession, "tiles")
    path = f"{scratch.root}/detail"
    q.withColumn("tile", F.floor(F.col("frame") / size).cast("long")).repartition("tile").write.partitionBy("tile").mode("overwrite").parquet(path)
    return q.sparkSession.read.schema(q.schema.add("tile", "long")).parquet(path)


def source_keys(samples: DataFrame, rate: int, layout: int, tag: str = "tiles:1") -> DataFrame:
    """``recording, key``: what a recording's tiles are stored under, from its rate, layout, length and samples as 16-bit codes.

    Of a recording of over ``SPREAD + 1`` blocks of ``PART`` samples only the first and ``SPREAD`` evenly spaced ones are looked at, with their places."""
    ends = samples.groupBy("recording").agg((F.max("n") + 1).alias("frames"))
    last, whole = F.col("frames") - PART, F.col("frames") <= (SPREAD + 1) * PART
    near = F.floor(F.col("n") * SPREAD / last)  # the places around a sample; blocks that are spread lie apart
    place = lambda k: F.when((k >= 0) & (k <= SPREAD), F.floor(k * last / SPREAD)).cast("long")
    starts = F.when(whole, F.array((F.floor(F.col("n") / PART) * PART).cast("long"))).otherwise(F.array(*(place(near + d) for d in (-1, 0, 1))))
    code = F.round(F.col("x") * 32768).cast("long").cast("string")
    # each block's samples make one string, so no cell holds more than a block; a sample lies in two blocks at most
    held = samples.join(ends, "recording").withColumn("start", F.explode(starts)).filter((F.col("n") >= F.col("start")) & (F.col("n") < F.col("start") + PART))
    block = held.groupBy("recording", "frames", "start").agg(F.array_sort(F.collect_list(F.struct("n", code.alias("c")))).alias("s"))
    block = block.select("recording", "frames", F.struct("start", F.sha2(F.array_join(F.transform("s", lambda v: v["c"]), ","), 256).alias("h")).alias("b"))
    by = block.groupBy("recording", "frames").agg(F.array_sort(F.collect_list("b")).alias("b"))  # SPREAD + 1 entries
    said = F.array_join(F.transform("b", lambda v: F.concat_ws(":", v["start"].cast("string"), v["h"])), ",")
    return by.select("recording", F.sha2(F.concat_ws("|", F.lit(tag), F.lit(str(rate)), F.lit(str(layout)), F.col("frames").cast("string"), said), 256).alias("key"))


def pack(q: DataFrame) -> DataFrame:
    """``frame, payload, payload_crc, header_crc``: each frame's codes with checks of the payload and of the entry's header."""
    by = q.groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "q"))), lambda v: F.lpad(F.hex(v["q"]), 2, "0")), "").alias("payload"))
    crc = F.crc32(F.col("payload").cast("binary"))
    return by.withColumn("payload_crc", crc).withColumn("header_crc", _header())


def _header():
    return F.crc32(F.concat_ws("|", F.lit("tile"), F.col("frame").cast("string"), F.col("payload_crc").cast("string")).cast("binary"))


def sound(entries: DataFrame) -> DataFrame:
    """Entries whose header and payload are as they were written; others are thrown away."""
    return entries.filter((F.col("header_crc") == _header()) & (F.col("payload_crc") == F.crc32(F.col("payload").cast("binary"))))


def unpack(entries: DataFrame) -> DataFrame:
    code = lambda i: F.conv(F.substring(F.col("payload"), 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    codes = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("payload") / 2).cast("int") - 1), code)
    return entries.select("frame", F.posexplode(codes).alias("bin", "q"))


def keep_recent(entries: DataFrame, budget: int, order: list[str], block: int = 65536) -> DataFrame:
    """The most recently used entries (by ``order``, latest first) that fit into a budget of ``bytes``; sums go over blocks of entries, then within them."""
    total = entries.count()
    ranked = number(entries, order, "_up").withColumn("_n", F.lit(total - 1) - F.col("_up")).withColumn("_b", F.floor(F.col("_n") / block))
    sums = ranked.groupBy("_b").agg(F.sum("bytes").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))  # a row for 65,536 entries
    upto = F.sum("bytes").over(Window.partitionBy("_b").orderBy("_n")) + F.col("_before")
    return ranked.join(F.broadcast(before), "_b").withColumn("_upto", upto).filter(F.col("_upto") <= budget).drop("_up", "_n", "_b", "_before", "_upto")
