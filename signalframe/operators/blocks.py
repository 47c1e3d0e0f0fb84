"""Samples in blocks with halos, and linear recurrences that carry their state from block to block.

A recording of any length is dealt out as blocks; a task holds one block at a time.  What looks at neighbours gets a halo;
what has unbounded memory but is linear (filters) runs in three steps: every block's end state from nothing, a scan of
these few numbers along each recording, and the blocks again from their true states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

BLOCK = 1 << 16
KEYS = ["recording", "channel", "block"]
PACKED = "recording long, channel int, block long, start long, lo int, hi int, xs array<double>"
SAMPLES = "recording long, channel int, n long, x double"


def pack(samples: DataFrame, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """One row for each block of ``recording, channel, n, x``: its samples with those around it (``xs``), the ``n`` of the first, and where its own lie (``lo``, ``hi``)."""
    rows = samples.select(F.col("recording").cast("long").alias("recording"), F.col("channel").cast("int").alias("channel"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))
    least = 0 if before or after else np.iinfo(np.int64).min
    return bundle(rows, lambda n: (np.maximum(least, (n - after) // size), (n + before) // size), lambda block: (block * size, (block + 1) * size))


PIECES = "recording long, channel int, block long, at long, ns array<int>, xs array<double>"


def bundle(rows: DataFrame, blocks: Callable | None = None, span: Callable | None = None) -> DataFrame:
    """One row for each ``recording, channel, block`` of ``recording, channel, n, x``, as ``pack`` makes them.

    ``blocks(n)`` gives the first and the last block that samples belong to (else columns ``first`` and ``last`` do); ``span(block)`` tells which places are
    its own (all of them).  Samples are gathered into pieces of blocks before they are shuffled, so a task sorts a few arrays in place of single samples."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r, c, n, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("recording", "channel", "n", "x"))
            first, last = blocks(n) if blocks else (batch.column(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
            times = np.maximum(0, last - first + 1)
            of, ends = np.repeat(np.arange(len(n)), times), np.cumsum(times)
            if not len(of):
                continue
            b = np.arange(len(of)) - np.repeat(ends - times, times) + first[of]
            order = np.lexsort((n[of], b, c[of], r[of]))
            of, b = of[order], b[order]
            r, c, n, x = r[of], c[of], n[of], x[of]
            begins = np.concatenate([[0], np.flatnonzero((r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (b[1:] != b[:-1])) + 1])
            edges = np.append(begins, len(n)).astype(np.int32)
            gap = np.zeros(len(n), bool)
            gap[1:] = n[1:] != n[:-1] + 1
            gap[begins] = False
            broken = np.add.reduceat(gap, begins, dtype=np.int64) > 0
            told = np.repeat(broken, np.diff(edges))
            places = np.concatenate([[0], np.cumsum(np.diff(edges) * broken)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "recording": pa.array(r[begins].astype(np.int64)), "channel": pa.array(c[begins].astype(np.int32)), "block": pa.array(b[begins].astype(np.int64)), "at": pa.array(n[begins].astype(np.int64)),
                "ns": pa.ListArray.from_arrays(pa.array(places), pa.array((n - np.repeat(n[begins], np.diff(edges)))[told].astype(np.int32))), "xs": pa.ListArray.from_arrays(pa.array(edges), pa.array(x)),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, done = None, Gathered(pa.schema([("recording", pa.int64()), ("channel", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("xs", pa.list_(pa.float64()))]))

        def full():
            n, x = (np.concatenate(c) for c in zip(*held))
            if (n[1:] < n[:-1]).any():
                order = np.argsort(n, kind="stable")
                n, x = n[order], x[order]
            lo, hi = np.searchsorted(n, span(key[2])) if span else (0, len(n))
            if hi > lo:
                yield from done.add([*key, int(n[0]), int(lo), int(hi), x])

        for batch in batches:
            for x, ns, (r, c, b, at) in zip(values(batch), values(batch, "ns"), cells(batch, *KEYS, "at")):
                if key is not None and (r, c, b) != key:
                    yield from full()
                    held.clear()
                key = (r, c, b)
                held.append((at + (ns if len(ns) else np.arange(len(x))), np.array(x)))  # a copy: the batch goes
        if held:
            yield from full()
        yield from done.rest()

    return rows.mapInArrow(cut, PIECES).repartition(*KEYS).sortWithinPartitions(*KEYS, "at").mapInArrow(run, PACKED)


class Gathered:
    """Rows on their way out, put together to batches of about 2 MB: a batch for each row is slow where recordings are short."""

    MOST = 1 << 21

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: list) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + sum(v.nbytes for v in row if isinstance(v, np.ndarray))
        if self.size >= self.MOST:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            arrays = [_list_array(list(c), f.type) if pa.types.is_list(f.type) else pa.array(list(c), f.type) for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        self.rows, self.size = [], 0


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind.value_type))


FEW = 10_000


def beside(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", by: str = "block") -> DataFrame:
    """``rows`` with what ``side`` holds of their recording (``keys``): no task gets all rows of a recording.

    A side of up to ``FEW`` rows is broadcast; of more, its rows go to each of 64 parts of a recording, which ``by`` deals out.  Spark takes the size of the side's
    files for that of the 64 copies, so the join of these is told not to broadcast them."""
    side = Scratch(side.sparkSession, "side").keep(side, "side")
    if side.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(side), keys, how)
    parts = side.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("_deal", F.pmod(F.hash(by), F.lit(64))).join(parts.hint("merge"), [*keys, "_deal"], how).drop("_deal")


def along(rows: DataFrame, names: list[str], begin: Callable, step: Callable, field: str, after: bool = False) -> DataFrame:
    """``recording, channel, block`` and the state before each block of ``rows``: ``begin()`` at a recording's first, then ``step(state, *names)``; ``after``: the state after it, under the next block's number.

    A row is a few numbers for a whole block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = now = None
        for batch in batches:
            out = []
            told = [values(batch, k) if pa.types.is_list(batch.column(k).type) else batch.column(k).to_pylist() for k in names]
            for (r, c, b), *more in zip(cells(batch, *KEYS), *told):
                if (r, c) != key:
                    key, now = (r, c), begin()
                then = step(now, *more)
                out.append((r, c, b + after, then if after else now))
                now = then
            if out:
                r, c, b, state = zip(*out)
                state = [v.tolist() if isinstance(v, np.ndarray) else v for v in state]
                yield pa.RecordBatch.from_pydict({"recording": list(r), "channel": pa.array(c, pa.int32()), "block": list(b), field.split()[0]: state})

    rows = rows.select(*KEYS, *names).repartition("recording", "channel").sortWithinPartitions(*KEYS)
    return rows.mapInArrow(run, f"recording long, channel int, block long, {field}")


def values(batch: pa.RecordBatch, column: str = "xs") -> list[np.ndarray]:
    """The arrays of a list column, without copies."""
    col = batch.column(column)
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def cells(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def sample_rows(recording: int, channel: int, start: int, x: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    return pa.RecordBatch.from_pydict({"recording": pa.array(np.full(n, recording)), "channel": pa.array(np.full(n, channel, np.int32)), "n": pa.array(np.arange(start, start + n)), "x": pa.array(np.asarray(x, np.float64))})


def map_blocks(packed: DataFrame, fn: Callable, schema: str | None = None, *more: str) -> DataFrame:
    """``fn(xs, lo, hi, start, *more)`` for each block: its own samples' new values, or with a schema a dict of columns beside recording and channel."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for xs, (r, c, start, lo, hi, *rest) in zip(values(batch), cells(batch, "recording", "channel", "start", "lo", "hi", *more)):
                out = fn(xs, lo, hi, start, *rest)
                if schema is None:
                    held.append(sample_rows(r, c, start + lo, out))
                else:
                    n = len(next(iter(out.values())))
                    held.append(pa.RecordBatch.from_pydict({"recording": pa.array(np.full(n, r)), "channel": pa.array(np.full(n, c, np.int32)), **out}))
                size += held[-1].nbytes
                if size >= Gathered.MOST:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return packed.mapInArrow(run, schema or SAMPLES)


# --- linear recurrences

LANE = 256


@lru_cache(maxsize=256)
def _lane(a1: float, a2: float) -> tuple[np.ndarray, np.ndarray]:
    """What a section puts out in ``LANE`` steps without input from either unit state, and how its state turns."""
    s = np.eye(2)
    out = np.empty((LANE, 2))
    for t in range(LANE):
        out[t] = s[0]
        s = np.stack([s[1] - a1 * s[0], -a2 * s[0]])
    return out, s


def _section(x: np.ndarray, section: tuple, s1: float, s2: float) -> tuple[np.ndarray, float, float]:
    """Transposed direct form II: lanes of ``LANE`` samples side by side from nothing, then each lane's true state on top."""
    b0, b1, b2, a1, a2 = section
    out, m = np.empty(len(x)), len(x) // LANE
    if m:
        cols = np.ascontiguousarray(x[: m * LANE].reshape(m, LANE).T)
        y, e1, e2 = np.empty_like(cols), np.zeros(m), np.zeros(m)
        for t in range(LANE):
            v = cols[t]
            o = b0 * v + e1
            e1, e2 = b1 * v - a1 * o + e2, b2 * v - a2 * o
            y[t] = o
        free, turn = _lane(float(a1), float(a2))
        (p, q), (r, s) = turn.tolist()
        states = np.empty((2, m))
        for k, (d1, d2) in enumerate(zip(e1.tolist(), e2.tolist())):
            states[0, k], states[1, k] = s1, s2
            s1, s2 = p * s1 + q * s2 + d1, r * s1 + s * s2 + d2
        y += free @ states
        out[: m * LANE] = y.T.ravel()
    for i, v in enumerate(x[m * LANE :].tolist(), m * LANE):
        o = b0 * v + s1
        s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
        out[i] = o
    return out, s1, s2


def run_cascade(x: np.ndarray, sections, state=None) -> tuple[np.ndarray, list[float]]:
    """The sections one after another from a state (two numbers for each), and the state at the end."""
    y, end = np.asarray(x, np.float64), []
    state = state if state is not None and len(state) else [0.0] * (2 * len(sections))
    for k, section in enumerate(sections):
        y, s1, s2 = _section(y, section, state[2 * k], state[2 * k + 1])
        end += [s1, s2]
    return y, end


def one_step(sections) -> np.ndarray:
    """The matrix by which a cascade's state turns in a step without input."""
    n = 2 * len(sections)
    out = np.zeros((n, n))
    for j in range(n):
        state, v = np.eye(n)[j], 0.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            o = b0 * v + state[2 * k]
            out[2 * k, j], out[2 * k + 1, j] = b1 * v - a1 * o + state[2 * k + 1], b2 * v - a2 * o
            v = o
    return out


def cascades(samples: DataFrame, sets: list[list[tuple]], finish: Callable, schema: str | None = None, size: int = BLOCK) -> DataFrame:
    """``finish(start, [filtered by each cascade])`` for every block, with all states carried along each recording: a dict of columns, or samples."""
    dims = [2 * len(s) for s in sets]
    edges = np.concatenate([[0], np.cumsum(dims)]).tolist()
    packed = pack(samples, size)

    def ends(batches):
        done = Gathered(pa.schema([("recording", pa.int64()), ("channel", pa.int32()), ("block", pa.int64()), ("tail", pa.list_(pa.float64()))]))
        for batch in batches:
            for xs, (r, c, b) in zip(values(batch), cells(batch, *KEYS)):
                if len(xs) == size:  # a shorter one is a recording's last
                    yield from done.add([r, c, b, np.concatenate([run_cascade(xs, s)[1] for s in sets])])
        yield from done.rest()

    turns = [np.linalg.matrix_power(one_step(s), size) if s else np.zeros((0, 0)) for s in sets]
    carried = lambda now, tail: np.concatenate([t @ now[a:b] for t, a, b in zip(turns, edges, edges[1:])]) + np.asarray(tail)
    tails = packed.mapInArrow(ends, "recording long, channel int, block long, tail array<double>")
    states = along(tails, ["tail"], lambda: np.zeros(edges[-1]), carried, "state array<double>", after=True)

    def run(xs, lo, hi, start, state):
        state = state or [0.0] * edges[-1]
        return finish(start, [run_cascade(xs, s, state[a:b])[0] for s, a, b in zip(sets, edges, edges[1:])])

    return map_blocks(packed.join(states, KEYS, "left"), run, schema, "state")


def cascade(samples: DataFrame, sections: list[tuple], size: int = BLOCK) -> DataFrame:
    """``recording, channel, n, x`` through a cascade of sections."""
    if not sections:
        return samples.select("recording", "channel", "n", "x")
    return cascades(samples, [sections], lambda start, y: y[0], None, size)
