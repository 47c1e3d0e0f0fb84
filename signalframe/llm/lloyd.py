"""Integer k-means in rounds over a written table: what the vector codes and the centroid clusters share.

A round is one scan.  It rewrites each vector with its new assignment and adds, at the end of each task, what that task's
*moves* put into the sums of the centroids: plus a vector where it went, minus it where it came from.  Only these few rows are
shuffled (a task gives one for each centroid at most); the driver holds the running integer sums, which are as large as the
centroids.  All arithmetic is exact: float64 products where they stay below 2**53, 64-bit integers otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Scratch

#: Columns of a task's contributions, beside those of the vectors.
MOVES = "part int, entry int, sums array<long>, n long"


def reach(width: int) -> int:
    """The largest component for which squared distances of vectors of so many components fit into 64 bits."""
    return math.isqrt((1 << 61) // max(width, 1)) - 1


def sound(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int, most: int) -> Column:
    """``floor(scale * x)`` of each component (exact for a power of two); null if one is beyond ``most``."""
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(1 << 62))), F.lit(-float(1 << 62)))))
    return F.when(F.forall(scaled, lambda x: F.abs(x) <= most), scaled.cast("array<int>"))


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """The vectors of a batch as rows."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``v`` from all rows of ``c``, exactly, as 64-bit integers."""
    most = max((int(np.abs(x).max()) for x in (v, c) if x.size), default=0)
    if 4 * v.shape[1] * most * most < 1 << 53:
        v, c = v.astype(np.float64), c.astype(np.float64)
    else:
        v, c = v.astype(np.int64), c.astype(np.int64)
    out = v @ c.T
    out *= -2
    out += (c * c).sum(1)
    out += (v * v).sum(1)[:, None]
    return out.astype(np.int64)


def squared_pairs(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same between rows of equal places."""
    d = v.astype(np.int64) - c.astype(np.int64)
    return (d * d).sum(1)


class Moves:
    """A task's contributions to the sums of ``parts`` x ``entries`` centroids."""

    def __init__(self, parts: int, entries: int, width: int):
        self.sums, self.counts, self.touched = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries), bool)

    def add(self, part: int, v: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """``before`` is -1 for vectors that had no centroid."""
        moved = before != after
        for of, sign, rows in ((before, -1, moved & (before >= 0)), (after, 1, moved)):
            at = of[rows]
            np.add.at(self.sums[part], at, sign * v[rows].astype(np.int64))
            np.add.at(self.counts[part], at, sign)
            self.touched[part, at] = True

    def rows(self, schema: pa.Schema) -> pa.RecordBatch | None:
        parts, entries = np.nonzero(self.touched)
        if not len(parts):
            return None
        own = {"part": pa.array(parts, pa.int32()), "entry": pa.array(entries, pa.int32()), "sums": pa.array(self.sums[parts, entries].tolist(), pa.list_(pa.int64())), "n": pa.array(self.counts[parts, entries])}
        return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(len(parts), f.type) for f in schema], schema=schema)


class Centroids:
    """Integer centroids with the running sums and counts of what is assigned to them."""

    def __init__(self, start: np.ndarray):
        """``start``: parts x entries x width."""
        self.at = start.astype(np.int64)
        self.sums, self.counts = np.zeros_like(self.at), np.zeros(self.at.shape[:2], np.int64)
        self.moves: list[int] = []  # of each round: assignments that changed

    def update(self, written: DataFrame) -> None:
        """Adds a round's contributions to the sums and moves the centroids to the floors of their means; unused ones stay."""
        rows = written.filter("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
        moved = 0
        for r in rows.groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():  # as many as there are components of centroids
            self.sums[r["part"], r["entry"], r["place"]] += r["x"]
            if r["place"] == 0:
                self.counts[r["part"], r["entry"]] += r["n"]
                moved += abs(r["n"])
        self.moves.append(moved)
        used = self.counts > 0
        self.at[used] = self.sums[used] // self.counts[used][:, None]


class Rounds:
    """The written table of vectors, one version for each round; the one before goes when the next is there."""

    def __init__(self, scratch: Scratch, first: DataFrame):
        self.scratch, self.n, self.now = scratch, 0, first

    def next(self, df: DataFrame) -> DataFrame:
        """Writes a round's rows and contributions; keeps the vectors' rows and returns all."""
        self.n += 1
        written = self.scratch.keep(df, f"round-{self.n}")
        self.scratch.drop(f"round-{self.n - 1}")
        self.now = written.filter("part IS NULL").drop("part", "entry", "sums", "n")
        return written


def total(column: str) -> Column:
    """A sum of 64-bit integers; null if it doesn't fit into one."""
    return F.expr(f"try_cast(sum(CAST({column} AS DECIMAL(38, 0))) AS BIGINT)")
