"""Centroid clusters of integer vectors by Yinyang rounds: bounds let most vectors skip most centroids, with exact results.

The centroids are put into groups once.  Each vector keeps an upper bound of the distance from its own centroid and one lower bound for each
group of the others.  When centroids move, the bounds give way by as much.  A vector whose least lower bound is above its upper bound
stays (global filter, first with the old upper bound and then with the exact one); of the rest, only groups whose bound isn't above are scanned, exactly.
Bounds are rounded outwards and equality never skips, so ties go to the smaller number as in a full scan.

Defined cases: only vectors of ``width`` components, none null or non-finite, are kept; one with a component too large for exact
64-bit distances (``lloyd.reach``) stays as a row without cluster.  Equal ids begin in the order of their vectors; null ids come last.  With fewer vectors than
clusters there are fewer centroids; an empty table gives no rows.  A sum beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Scratch, lean
from .lloyd import MOVES, Centroids, Moves, Rounds, integers, matrix, reach, sound, squared, squared_pairs

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED, GROUPS = 16, 3, 64, 64, 1, 4
OUT = 1e-12  # how far bounds are rounded outwards, relatively
FAR = 1e300  # of a group without another centroid


class Clusters:
    """What ``cluster`` gives: ``rows`` (vec_id, cluster, distance, n_distances), the centroids, each centroid's group, and the number of moves in each round."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, groups: np.ndarray, moves: list[int]):
        self.rows, self.centroids, self.groups, self.moves = rows, centroids, groups, moves

    def sha256(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[k].tolist())).encode()).hexdigest()


def group(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: Lloyd's algorithm on the centroids themselves, from evenly spaced ones."""
    k = len(centroids)
    groups = max(1, min(groups, k))
    middle = centroids[np.arange(groups) * k // groups].astype(np.float64)
    for _ in range(rounds):
        own = ((centroids[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                middle[g] = centroids[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]  # without empty groups


def _down(x: np.ndarray) -> np.ndarray:
    return x - OUT * np.abs(x)


def _up(x: np.ndarray) -> np.ndarray:
    return x + OUT * np.abs(x)


def _scan(v: np.ndarray, centroids: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of a group's centroids (the smallest number of equals), its squared distance, and that of the second (``FAR`` if there is none)."""
    far = squared(v, centroids[members])
    at = far.argmin(1)
    rows = np.arange(len(v))
    best = far[rows, at]
    if len(members) == 1:
        return members[at], best, np.full(len(v), FAR)
    far[rows, at] = np.iinfo(np.int64).max
    return members[at], best, far.min(1).astype(np.float64)


def assign(v: np.ndarray, centroids: np.ndarray, groups: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New assignments, upper and lower bounds, and how many exact distances each vector took.

    ``own`` -1 means no centroid yet (then all groups are scanned); ``drift`` is how far each centroid has moved since."""
    n, t = len(v), int(groups.max()) + 1
    members = [np.flatnonzero(groups == g) for g in range(t)]
    own, used = own.copy(), np.zeros(n, np.int64)
    if drift is None:
        todo = np.arange(n)
        lower = np.zeros((n, t))
    else:
        upper = _up(upper + drift[own])
        lower = _down(lower - np.array([drift[m].max() for m in members]))
        todo = np.flatnonzero(~(lower.min(1) > upper))  # global filter
        upper = upper.copy()
        upper[todo] = _up(np.sqrt(squared_pairs(v[todo], centroids[own[todo]]).astype(np.float64)))
        used[todo] += 1
        todo = todo[~(lower[todo].min(1) > upper[todo])]
    if not len(todo):
        return own, upper, lower, used
    w, m = v[todo], len(todo)
    before, far = own[todo], np.full(m, np.iinfo(np.int64).max)
    held = before >= 0
    far[held] = squared_pairs(w[held], centroids[before[held]])
    best, low = before.copy(), lower[todo]
    top = _up(np.sqrt(far.astype(np.float64)))
    found = []
    for g in range(t):  # filter by group: against the centroid that it had, so that the order of groups doesn't matter
        rows = np.flatnonzero(~held | ~(low[:, g] > top))
        at, d, second = _scan(w[rows], centroids, members[g])
        used[todo[rows]] += len(members[g])
        nearer = (d < far[rows]) | ((d == far[rows]) & ((at < best[rows]) | (best[rows] < 0)))
        best[rows[nearer]], far[rows[nearer]] = at[nearer], d[nearer]
        found.append((rows, at, d, second))
    for g, (rows, at, d, second) in enumerate(found):  # a scanned group's bound is its nearest that isn't the vector's own
        low[rows, g] = _down(np.sqrt(np.where(at == best[rows], second, d.astype(np.float64))))
    left = np.flatnonzero(held & (best != before))
    if len(left):  # the centroid that a vector left counts in its group, also where that wasn't scanned
        g = groups[before[left]]
        low[left, g] = np.minimum(low[left, g], _down(np.sqrt(squared_pairs(w[left], centroids[before[left]]).astype(np.float64))))
    own[todo], lower[todo] = best, low
    if drift is None:
        upper = np.empty(n)
    upper[todo] = _up(np.sqrt(far.astype(np.float64)))
    return own, upper, lower, used


def _round(rows: DataFrame, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    k, width = centroids.shape
    t = int(groups.max()) + 1
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, v array<int>, cluster int, upper double, lower array<double>, distance long, n_distances long, {MOVES}"

    def run(batches):
        moves, form = Moves(1, k, width), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = matrix(batch, "v", width)
            if drift is None:
                before, upper, lower = np.full(n, -1), np.zeros(n), np.zeros((n, t))
            else:
                before, upper, lower = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), matrix(batch, "lower", t)
            own, upper, lower, used = assign(v, centroids, groups, before, upper, lower, drift)
            moves.add(0, v, before, own)
            distance = pa.array(squared_pairs(v, centroids[own])) if last else pa.nulls(n, pa.int64())
            out = pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "v": batch.column("v"), "cluster": pa.array(own, pa.int32()), "upper": pa.array(upper), "lower": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * t, pa.int32()), pa.array(lower.ravel())),
                "distance": distance, "n_distances": pa.array(used + batch.column("n_distances").to_numpy()), "part": pa.nulls(n, pa.int32()), "entry": pa.nulls(n, pa.int32()), "sums": pa.nulls(n, pa.list_(pa.int64())), "n": pa.nulls(n, pa.int64()),
            })
            form = out.schema
            yield out
        if form is not None and (extra := moves.rows(form)) is not None:
            yield extra

    return rows.mapInArrow(lean(run), schema)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, groups: int = GROUPS) -> Clusters:
    """Clusters of ``vec_id, embedding``; the first centroids are the vectors with the smallest SHA-256 of ``seed:vec_id``."""
    scratch = Scratch(vectors.sparkSession, "clusters")
    kept = vectors.filter((F.size("embedding") == width) & sound(F.col("embedding")))
    placed = scratch.keep(kept.select("vec_id", integers(F.col("embedding"), scale, reach(width)).alias("v")), "vectors")
    able = placed.filter("v IS NOT NULL")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begin = able.orderBy(drawn.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    none = placed.filter("v IS NULL").select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("n_distances", "long"))))
    if not begin:
        return Clusters(none, np.zeros((0, width), np.int64), np.zeros(0, np.int64), [])
    middle = Centroids(np.array([[r["v"] for r in begin]], np.int64))
    of = group(middle.at[0], groups)
    state, drift = Rounds(scratch, able.withColumn("n_distances", F.lit(0).cast("long"))), None
    for _ in range(rounds):
        before = middle.at[0].copy()
        middle.update(state.next(_round(state.now, before, of, drift, False)))
        drift = _up(np.sqrt(squared_pairs(middle.at[0], before).astype(np.float64)))
    state.next(_round(state.now, middle.at[0], of, drift, True))
    return Clusters(state.now.select("vec_id", "cluster", "distance", "n_distances").unionByName(none), middle.at[0], of, middle.moves)


def digest(found: Clusters) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark, rows = found.rows.sparkSession, found.rows.drop("n_distances")
    sums = {r["cluster"]: r["s"] for r in rows.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    fit = lambda x: int(x) if x < 1 << 63 else None
    about = spark.createDataFrame([(k, fit(sums.get(k, 0)), found.sha256(k)) for k in range(len(found.centroids))], "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fit(sum(sums.values()))).cast("long").alias("inertia"), "centroid_sha256")
