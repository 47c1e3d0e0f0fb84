"""Stored levels: roll-ups by powers of two that queries read one level of, and of that only the tiles in their range.

A store is a Parquet table partitioned by ``level`` and ``tile`` (``TILE`` entries of a level), sorted by recording in its files.  A level is made from
stored ones, ``STEP`` levels in a pass, so building reads the samples once and then rows that get fewer by halves.  The level of a query is the
coarsest whose entries are no wider than a column, so it reads a few entries for each column, whatever the length of the recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

TILE = 4096
STEP = 4


def column_of(place: Column, start: int, stop: int, columns: int) -> Column:
    """Which of so many columns of a range a place falls into."""
    return F.floor((place - start) * columns / F.lit(stop - start)).cast("long")


class Levels:
    """``entries(recording, ..., idx, values)`` of each level below a folder."""

    def __init__(self, spark: SparkSession, root: str, schema, keys: list[str], width: int, top: int):
        self.spark, self.root, self.schema, self.keys, self.width, self.top = spark, root, schema, keys, width, top

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.root)

    def level_for(self, per_column: int) -> int:
        """The coarsest level whose entries cover no more than a column."""
        level = 0
        while level < self.top and self.width << (level + 1) <= per_column:
            level += 1
        return level

    def touched(self, start: int, stop: int, columns: int, level: int | None = None) -> DataFrame:
        """The entries of one level that lie in a range, with each ``column`` that they touch; only their level and tiles are read."""
        if not 0 <= start < stop or columns < 1:
            raise ValueError("a range of samples and at least one column")
        level = self.level_for((stop - start) // columns) if level is None else level
        size = self.width << level
        first, last = start // size, (stop - 1) // size
        own = self.read().filter((F.col("level") == level) & F.col("tile").between(first // TILE, last // TILE) & F.col("idx").between(first, last))
        low = column_of(F.greatest(F.col("idx") * size, F.lit(start)), start, stop, columns)
        high = column_of(F.least((F.col("idx") + 1) * size, F.lit(stop)) - 1, start, stop, columns)
        return own.withColumn("column", F.explode(F.sequence(low, high)))


def store(base: DataFrame, keys: list[str], fold: Callable, width: int, root: str | None = None) -> Levels:
    """Writes all levels of ``base(*keys, idx, values)``, whose entries are ``width`` places wide; ``fold(grouped)`` merges entries.

    The last level has one entry for the longest recording."""
    spark = base.sparkSession
    root = root or f"{Scratch(spark, 'levels').root}/levels"

    def write(rows: DataFrame, mode: str) -> None:
        placed = rows.withColumn("tile", F.floor(F.col("idx") / TILE).cast("long"))
        placed.repartition("level", "tile", *keys).sortWithinPartitions("level", "tile", *keys, "idx").write.partitionBy("level", "tile").mode(mode).parquet(root)

    write(base.withColumn("level", F.lit(0)), "overwrite")
    schema = base.withColumn("level", F.lit(0)).withColumn("tile", F.lit(0).cast("long")).schema
    out = Levels(spark, root, schema, keys, width, 0)
    most = out.read().filter("level = 0").agg(F.max("idx")).first()[0] or 0
    while most >> out.top:
        up = min(STEP, (most >> out.top).bit_length())
        below = out.read().filter(F.col("level") == out.top).withColumn("level", F.explode(F.sequence(F.lit(out.top + 1), F.lit(out.top + up))))
        below = below.withColumn("idx", F.expr(f"shiftright(idx, level - {out.top})"))
        write(fold(below.groupBy(*keys, "level", "idx")).select(*[c for c in schema.names if c != "tile"]), "append")
        out.top += up
    return out
