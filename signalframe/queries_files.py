"""Queries that write the driver's signals as files and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import model
from .queries import EVENT, LINE, query, rounded
from .scratch import Scratch
from .sources import files, sink


def _name():
    return F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("recording")


def _written(spark, samples, **options) -> str:
    root = f"{Scratch(spark, 'files').root}/out"
    sink.write(samples, 8000, root, **options)
    return root


def _line(spark, sf_dir):
    return model.whole(model.long(model.line_signal(spark, sf_dir)))


def _users(spark, sf_dir):
    return model.event_signal(spark, sf_dir).withColumn("channel", F.lit(0))


@query("k1_s3_files_in_blocks", f"WITH {LINE} SELECT 0::BIGINT AS recording, CAST(channel AS INT) AS channel, n, round(greatest(-1.0, least(8388607 / 8388608.0, sign(x) * floor(abs(x) * 8388608 + 0.5) / 8388608)), 8) + 0.0::DOUBLE AS x FROM long")
def _(spark, sf_dir):
    """One stereo recording, written by a task for each 4,096 frames and read by ranges of 1,000."""
    blocks = files.read_blocks(spark, _written(spark, _line(spark, sf_dir), block=4096), 1000)
    return rounded(files.samples_of(blocks).select(_name(), "channel", "n", "x"), 8)


@query("k2_s4_aiff_files", f"WITH {EVENT} SELECT recording, 0::INT AS channel, n, round(greatest(-1.0, least(32767 / 32768.0, sign(x) * floor(abs(x) * 32768 + 0.5) / 32768)), 8) + 0.0::DOUBLE AS x FROM ev")
def _(spark, sf_dir):
    root = _written(spark, _users(spark, sf_dir), kind="aiff", fmt="s16")
    return rounded(files.samples_of(files.read_blocks(spark, root)).select(_name(), "channel", "n", "x"), 8)


@query("s12_recordings", f"WITH {EVENT} SELECT recording, 'wav' AS kind, 8000.0::DOUBLE AS rate, 1::INT AS channels, 'f32' AS format, count(*) AS frames, 44 + 4 * count(*) AS length FROM ev GROUP BY 1")
def _(spark, sf_dir):
    """What the headers of files say, without their samples."""
    root = _written(spark, _users(spark, sf_dir), fmt="f32")
    return files.recordings(spark, root).select(_name(), "kind", "rate", "channels", "format", "frames", "length")


@query("s2_data_source", f"WITH {LINE} SELECT CAST(channel AS INT) AS channel, n // 2048 AS block_index, count(*) AS frames, round(min(x), 6) AS lowest, round(max(x), 6) AS highest FROM long GROUP BY ALL")
def _(spark, sf_dir):
    """The data source cuts a recording into partitions of ranges; what a range holds is told by block."""
    root = _written(spark, _line(spark, sf_dir), fmt="f64", block=8192)
    spark.dataSource.register(files.SignalSource)
    got = spark.read.format("signal").option("block", "2048").option("blocks_per_partition", "4").load(root)
    return rounded(got.select("channel", "block_index", F.size("samples").cast("long").alias("frames"), F.array_min("samples").alias("lowest"), F.array_max("samples").alias("highest")))
