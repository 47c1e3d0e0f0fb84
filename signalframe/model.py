"""Signals from the driver's tables, as DataFrames in the engine's shapes.

The long form is ``samples(recording, channel, n, x)``.  Sample order is a column, never the order of rows.
Numbering rows takes no single-task window: ``number`` counts in range partitions, written once, and adds offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, version

RATE = 8000.0
FLOOR_DB = -200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 1 << 19  # of a range: what a task sorts doesn't hang on how well its rows are packed in a shuffle


def number(df: DataFrame, keys: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """0-based position in the order of ``keys``: range partitions are written once with each row's place in them, then shifted by the sizes of those before.

    Both the sizes and the rows come from the written table, so a second sampling of range bounds can't tear them apart."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = Scratch(df.sparkSession, "number").keep(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select(F.col("_part").alias("_of"), (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row per partition
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_of", "_before")


_numbered: dict[tuple, DataFrame] = {}


def numbered(spark: SparkSession, sf_dir: str, name: str, keys: list[str], more: list[str], place: str = "n") -> DataFrame:
    """``number`` of a source table, written once for each session and version of its files: later queries read what the first has written."""
    key = (spark.sparkContext.applicationId, version(spark, f"{sf_dir}/{name}.parquet"), tuple(keys), tuple(more), place)
    if key not in _numbered:
        rows = table(spark, sf_dir, name)
        _numbered[key] = number(rows.select(*keys, *more), keys, place, max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS)))
    return _numbered[key]


def line_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo: ``n, l, r``."""
    return _line(numbered(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_discount", "l_tax"]), "n")


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same signal without positions, for measures that don't depend on the order: ``l, r``."""
    return _line(table(spark, sf_dir, "lineitem"))


def _line(d: DataFrame, *more: str) -> DataFrame:
    return d.select(*more, ((F.col("l_discount") - 0.05) * 10).alias("l"), ((F.col("l_tax") - 0.04) * 12.5).alias("r"))


def long(stereo: DataFrame) -> DataFrame:
    """``n, channel, x`` from ``n, l, r``."""
    kept = [c for c in ("n",) if c in stereo.columns]
    return stereo.select(*kept, F.posexplode(F.array("l", "r")).alias("channel", "x"))


def whole(samples: DataFrame) -> DataFrame:
    """One recording of all frames: ``recording, channel, n, x``."""
    return samples.select(F.lit(0).cast("long").alias("recording"), "channel", "n", "x")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono, one recording per user: ``recording, n, x``."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("recording"), n.cast("long").alias("n"), ((F.col("value") - 250) / 250).alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64 samples: ``frame, samples``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("samples"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit decision list: ``clip_id, source_id, timeline_start, length, gain``."""
    o = numbered(spark, sf_dir, "orders", ["o_orderkey"], ["o_custkey"], "rank")
    return o.select(
        F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("source_id"), (F.col("rank") * 37).alias("timeline_start"), (50 + F.col("o_orderkey") % 100).alias("length"),
        (1 + (F.col("o_custkey") % 5) / 10.0).alias("gain"),
    )


def db(power, factor: float = 20.0):
    """Decibels with the floor of -200 for all that isn't positive."""
    return F.when(power > 0, F.greatest(F.lit(FLOOR_DB), factor * F.log10(power))).otherwise(F.lit(FLOOR_DB))


def db_to_gain(level):
    return F.when(level <= FLOOR_DB, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), level / 20))
