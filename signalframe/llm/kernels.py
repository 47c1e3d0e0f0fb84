"""Vectorised byte kernels shared by the text operators.

A chunk is a run of whole documents held as one flat ``uint8`` buffer plus offsets (zero-copy from
Arrow).  All per-word work is done with numpy on that buffer, so Python never loops over words.
Chunks hold ``CHUNK_BYTES`` of text at most; a longer document is a chunk by itself.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, scratch_root  # noqa: F401

CHUNK_BYTES = 3 << 19
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        p, q = np.full(size, BASE, U64), np.full(size, inverse, U64)
        p[0] = q[0] = 1
        p, q = np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64)
        if size > CHUNK_BYTES:  # a rare long text's powers aren't kept
            return p, q
        _pow, _inv = p, q
    return _pow, _inv


class SpanHash:
    """Polynomial hashes modulo 2**64 of any byte spans of a buffer, by prefix sums."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.empty(len(buf) + 1, U64)
        self.sums[0] = 0
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most so many bytes in ``column`` (or a single row)."""
    buf, offs = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at), buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = table(b" \t\n\x0b\x0c\r")
NON_SPACE = ~SPACE
#: Bytes that words of letters, digits and everything beyond ASCII are made of.
ALNUM = ~table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, which never cross documents."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offs[1:-1]
    before[edges[edges < len(inside)]] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` (one for each item) between the offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def grouped_order(h: np.ndarray) -> np.ndarray:
    """An order that puts equal hashes side by side, earlier items first (several times as fast as ``argsort``)."""
    n = len(h)
    if n < 2:
        return np.arange(n)
    bits = U64(int(n - 1).bit_length())
    packed = (h >> bits) << bits
    packed |= np.arange(n, dtype=U64)
    packed.sort()
    order = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    full, packed = h[order], packed >> bits
    if np.any((packed[1:] == packed[:-1]) & (full[1:] != full[:-1])):
        return np.argsort(h, kind="stable")
    return order


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index of each distinct hash, the class of every item, and the class sizes."""
    order = grouped_order(h)
    full = h[order]
    new = np.ones(len(h), bool)
    new[1:] = full[1:] != full[:-1]
    cls = np.empty(len(h), np.int64)
    cls[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], cls, np.diff(np.append(at, len(h)))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive items, in order."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * U64(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i])
    return out


def lean(fn: Callable) -> Callable:
    """``fn(batches)`` that gives freed memory back at its end: Python workers live on from task to task, and idle ones count too."""

    def run(batches):
        yield from fn(batches)
        give_back()

    return run


BATCH_BYTES = 4 << 20
BATCH_ROWS = 512  # that the Parquet reader decodes together


def set_small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> dict[str, str]:
    """Texts go to Python in Arrow batches of about ``most`` bytes from here on, in place of Spark's 64 MB, and are read in batches of few rows: the JVM holds both, and the worker the former, for each core.  Returns what was set."""
    to = {"spark.sql.execution.arrow.maxBytesPerBatch": most, "spark.sql.parquet.columnarReaderBatchSize": BATCH_ROWS}
    before = {k: spark.conf.get(k) for k in to}
    for k, v in to.items():
        spark.conf.set(k, str(v))
    return before


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """``set_small_batches`` for what runs inside."""
    before = set_small_batches(spark, most)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def give_back() -> None:
    """Freed memory goes back to the system (what the driver collected in blocks, too)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_chunks(df: DataFrame, fn: Callable, schema: str, column: str = "text", setup: Callable | None = None, most: int = CHUNK_BYTES) -> DataFrame:
    """``fn(batch, buf, offs[, what setup() gave])`` over every chunk; it returns a RecordBatch, a dict of columns or None."""

    def run(batches):
        own = [setup()] if setup else []
        for batch in batches:
            for part, buf, offs in chunks(batch, column, most):
                out = fn(part, buf, offs, *own)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_pydict(out)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(lean(run), schema)


def groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def full():
        return pa.Table.from_batches(held)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.zeros(n, bool)
        for c in cols:
            cuts[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield full()
            held = []
        edges = [0, *np.flatnonzero(cuts).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if a:
                yield full()
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield full()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A broadcast hint only where the (kept) table has so few rows; otherwise Spark's own choice of join."""
    return F.broadcast(df) if len(df.limit(most + 1).take(most + 1)) <= most else df


def fresh(df: DataFrame, stem: str) -> str:
    """A name that no column of the table begins with (Spark's names don't tell cases apart)."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem


def split_join(many: DataFrame, one: DataFrame, keys: list[str], count: str, total: int, parts: int = 1000) -> DataFrame:
    """``many`` joined to ``one`` (unique keys, ``count`` rows of ``many`` each), with hot keys apart.

    At most ``parts`` keys can hold more than ``total / parts`` rows each; these are broadcast, all others shuffled."""
    hot = F.col(count) * parts > max(total, 1)
    few, rest = F.broadcast(one.filter(hot)), one.filter(~hot)
    return many.join(few, keys).unionByName(many.join(few.select(*keys), keys, "left_anti").join(rest, keys))


def with_rows(df: DataFrame, columns: list[str], scratch: Scratch, name: str = "row", most_files: int = 100_000) -> DataFrame:
    """``columns`` and a number of each row that every scan gives again, however the files are split.

    For a table read from files it is made of the file's place in order and the row's place in the file; any other table
    (or one of more than ``most_files`` files, whose list the driver would hold) is written once with its numbers."""
    file, index, at = fresh(df, "_file"), fresh(df, "_index"), fresh(df, "_order")
    try:
        placed = df.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
        files = [r[0] for r in placed.select(file).distinct().limit(most_files + 1).collect()]
    except AnalysisException:
        files = None
    if files is None or len(files) > most_files:
        return scratch.keep(df.select(*columns).withColumn(name, F.monotonically_increasing_id()), "numbered")
    order = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(sorted(files))], f"{file} string, {at} long")
    return placed.join(F.broadcast(order), file).select(*columns, (F.shiftleft(at, 40) + F.col(index)).alias(name))


def without_rows(docs: DataFrame, judge: Callable, scratch: Scratch) -> DataFrame:
    """``docs``, with all their columns, less the rows that ``judge`` names: it gets them with ``doc_id`` as ``id`` and each row's own number as ``doc_id``, and returns the numbers of those to go.

    What shares a ``doc_id`` (or has none) is told apart by row, so no row goes for another's sake."""
    own = fresh(docs, "_row")
    rows = with_rows(docs, docs.columns, scratch, own)
    told = rows.select(F.col(own).alias("doc_id"), F.col("doc_id").alias("id"), *(c for c in ("text", "lang") if c in docs.columns))
    gone = small(scratch.keep(judge(told).toDF(own), "gone"), 500_000)
    return rows.join(gone, own, "left_anti").select(*docs.columns)
