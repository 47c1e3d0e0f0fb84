"""Repeated passages by distributed prefix doubling over a sparse suffix array.

Suffixes are ranked at anchors only: places whose ``Q``-byte hash is the smallest within ``W`` bytes on both sides.  Whether a
place is an anchor depends on the bytes around it alone, so equal passages have equal anchors, about one in 2 W + 1 bytes.

1. An anchor's rank is its block (the bytes up to the next anchor).  Spark joins position-rank pairs at offsets 1, 2, ...
   and reranks them by a hash of each pair; what is unique drops out in every round.
2. A window of ``least`` bytes belongs to its first anchor that lies ``W`` bytes or more inside.  A family of windows (one
   anchor) can only repeat where the blocks that all its windows hold have repeated ranks; one whose windows hold no block
   in common always may.
3. Families that survive are compared as a whole (the bytes of all their windows).  Where that is unique but other
   families have the same anchor, their windows are compared one by one; so are windows without any anchor.
4. Every byte of a window that occurs again is removed.

So each comparison is exact up to 64-bit hashes, whatever the anchors are; they only save work.  Texts travel compressed
and only where a fixed-size bitmap of rows says that they may be needed.

Defined cases: null texts are empty; texts shorter than ``least`` keep all; rows that share a ``doc_id`` are documents of their
own (and copies of each other); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Scratch, SpanHash, chunks, flat, lean, map_chunks, with_rows
from .neardup import id_bitmap, seen

LEAST = 400
W, Q = 24, 8
LEVELS = 3  # ranks over 1, 2 and 4 blocks
CHUNK = 3 << 18  # bytes of text at once; several 8-byte values stand for each
SHARED = 16  # beside a level: another row has two blocks from here on too
SPANS = 4_000  # families whose windows are written out at once


def anchors(buf: np.ndarray, offs: np.ndarray, hashes: SpanHash) -> np.ndarray:
    """Places of a chunk whose hash is a strict minimum on the left and a minimum on the right, with all its context in its document."""
    n = len(buf) - Q + 1
    if n <= 2 * W:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    h = hashes(at, at + Q) >> U64(1)

    def ahead(k):  # min of h[i .. i + k - 1]
        out, have = h.copy(), 1
        while have < k:
            step = min(have, k - have)
            out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
            have += step
        return out

    low = ahead(W)
    ok = np.zeros(n, bool)
    i = np.arange(W, n - W)
    ok[i] = (low[i - W] > h[i]) & (low[i + 1] >= h[i])
    found = np.flatnonzero(ok)
    doc = np.searchsorted(offs, found, "right") - 1
    return found[(found - W >= offs[doc]) & (found + W + Q <= offs[doc + 1])]


class Families:
    """The anchors of a chunk and the windows that each one stands for."""

    def __init__(self, buf, offs, least):
        self.hashes = SpanHash(buf)
        self.at = a = anchors(buf, offs, self.hashes)
        self.doc = d = np.searchsorted(offs, a, "right") - 1
        first = np.append(True, d[1:] != d[:-1]) if len(a) else np.zeros(0, bool)
        starts = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else a
        self.j = np.arange(len(a)) - starts
        prev = np.where(first, -(1 << 60), np.append(0, a[:-1])) if len(a) else a
        begin, end = offs[:-1][d], offs[1:][d]
        self.low = np.maximum(np.maximum(begin, prev - W + 1), a - (least - W - Q))
        self.high = np.minimum(a - W, end - least)
        last = np.append(d[1:] != d[:-1], True) if len(a) else first
        self.next = np.where(last, -1, np.append(a[1:], 0)) if len(a) else a
        self.block = self.hashes(a, np.where(last, a, self.next)) if len(a) else np.zeros(0, U64)
        # blocks that every window of the family holds with the next anchor's context
        limit = self.low + least - W - Q
        self.held = np.maximum(np.searchsorted(a, limit, "right") - 1 - np.arange(len(a)), 0)
        self.held = np.minimum(self.held, np.searchsorted(d, d, "right") - 1 - np.arange(len(a)))
        self.some = self.high >= self.low

    def bare(self, offs, least):
        """Starts of windows that no family covers."""
        size = int(offs[-1]) + 1
        cover = np.zeros(size + 1, np.int64)
        np.add.at(cover, self.low[self.some], 1)
        np.add.at(cover, self.high[self.some] + 1, -1)
        valid = np.zeros(size + 1, np.int64)
        long = np.flatnonzero(np.diff(offs) >= least)
        np.add.at(valid, offs[:-1][long], 1)
        np.add.at(valid, offs[1:][long] - least + 1, -1)
        return np.flatnonzero((np.cumsum(valid) > 0) & (np.cumsum(cover) == 0))


def _blocks(batch, buf, offs, least):
    f = Families(buf, offs, least)
    ok = f.next >= 0
    row = batch.column("row").to_numpy()
    return {"row": pa.array(row[f.doc[ok]]), "j": pa.array(f.j[ok]), "rank": pa.array((f.block[ok] >> U64(1)).astype(np.int64))}


def _family_columns(f, ok, row, offs, least):
    a, low, high, doc = f.at[ok], f.low[ok], f.high[ok], f.doc[ok]
    return {
        "row": pa.array(row[doc]), "low": pa.array((low - offs[doc]).astype(np.int64)), "high": pa.array((high - offs[doc]).astype(np.int64)),
        "anchor": pa.array(f.hashes(a - W, a + W + Q).astype(np.int64)), "whole": pa.array((f.hashes(low, high + least) + (a - low).astype(U64) * U64(0xD1B54A32D192ED03)).astype(np.int64)),
    }


def _direct(batch, buf, offs, least):
    """What can repeat without a repeated block: windows without an anchor (``start, h``) and families that hold no block (``low, high, anchor, whole``)."""
    f = Families(buf, offs, least)
    at = f.bare(offs, least)
    doc = np.searchsorted(offs, at, "right") - 1
    row = batch.column("row").to_numpy()
    out = _family_columns(f, f.some & (f.held == 0), row, offs, least)
    n, k = len(at), len(out["row"])
    out = {c: pa.concat_arrays([pa.nulls(n, pa.int64()), x]) for c, x in out.items()}
    out["row"] = pa.concat_arrays([pa.array(row[doc], pa.int64()), out["row"].slice(n)])
    out["start"] = pa.concat_arrays([pa.array(at - offs[doc], pa.int64()), pa.nulls(k, pa.int64())])
    out["h"] = pa.concat_arrays([pa.array(f.hashes(at, at + least).astype(np.int64)), pa.nulls(k, pa.int64())])
    return {c: out[c] for c in ("row", "start", "h", "low", "high", "anchor", "whole")}


def _rerank(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Positions whose keys occur again, with a 64-bit hash of the keys as their rank and whether another row has them."""
    classes = pairs.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("row") < F.max("row")).alias("shared")).filter("n > 1").drop("n")
    return pairs.join(classes, keys).select("row", "j", F.xxhash64(*keys).alias("rank"), "shared")


def prefix_doubling(blocks: DataFrame, scratch: Scratch, levels: int = LEVELS) -> DataFrame:
    """``row, j, level, shared``: the largest level (2**level blocks) at which the sequence from a position occurs again, and whether two blocks from there on occur in another row."""
    now = scratch.keep(_rerank(blocks, ["rank"]), "rank-0")
    deepest = now.select("row", "j", F.lit(0).alias("level"), F.lit(False).alias("shared"))
    for k in range(1, levels):
        ahead = now.select("row", (F.col("j") - (1 << (k - 1))).alias("j"), F.col("rank").alias("ahead"))
        now = scratch.keep(_rerank(now.drop("shared").join(ahead, ["row", "j"]), ["rank", "ahead"]), f"rank-{k}")
        deepest = deepest.union(now.select("row", "j", F.lit(k).alias("level"), (F.col("shared") & F.lit(k == 1)).alias("shared")))
    return deepest.groupBy("row", "j").agg(F.max("level").alias("level"), F.max("shared").alias("shared"))


def _pack(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Compressed texts of the rows that may be among ``ids(row)``."""
    held = texts.sparkSession.sparkContext.broadcast(id_bitmap(ids))

    def run(batch, buf, offs, own):
        ok = np.flatnonzero(seen(own[0], batch.column("hash").to_numpy()) & (np.diff(offs) > 0))
        if not len(ok):
            return None
        raw = buf.tobytes()
        return {"row": batch.column("row").take(pa.array(ok)), "packed": pa.array([own[1].compress(raw[offs[i] : offs[i + 1]]) for i in ok.tolist()], pa.binary())}

    return map_chunks(texts.withColumn("hash", F.xxhash64("row")), run, "row long, packed binary", setup=lambda: (held.value, zstandard.ZstdCompressor(level=1)), most=CHUNK)


def _unpacked(batches, most=CHUNK):
    """Chunks of texts again: (batch, buffer, offsets)."""
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        a = 0
        while a < batch.num_rows:
            texts, size, b = [], 0, a
            while b < batch.num_rows and (not texts or size < most):
                texts.append(d.decompress(batch.column("packed")[b].as_py()))
                size += len(texts[-1])
                b += 1
            yield batch.slice(a, b - a), *flat(pa.array(texts, pa.large_binary()))
            a = b


def _family_rows(least):
    def run(batches):
        for batch, buf, offs in _unpacked(batches):
            f = Families(buf, offs, least)
            level = np.full(len(f.at) + 1, -1, np.int64)
            begin = np.searchsorted(f.doc, np.arange(len(offs)))
            known = batch.column("levels")
            data, at = flat(known)
            info = np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at) // 8)
            level[begin[owner] + info[:, 0]] = info[:, 1] & (SHARED - 1)
            n = np.minimum(f.held, 1 << (LEVELS - 1))
            need = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
            here = np.arange(len(f.at))
            back = np.minimum(here + np.maximum(f.held - (1 << need), 0), len(f.at))
            ok = f.some & (f.held > 0) & (level[here] >= need) & (level[back] >= need)
            if not ok.any():
                continue
            yield pa.RecordBatch.from_pydict(_family_columns(f, ok, batch.column("row").to_numpy(), offs, least))

    return run


def _window_rows(least):
    def run(batches):
        for batch, buf, offs in _unpacked(batches):
            hashes = SpanHash(buf)
            row = batch.column("row").to_numpy()
            data, at = flat(batch.column("spans"))
            info = np.frombuffer(data.tobytes(), "<i8").reshape(-1, 3)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at) // 24)
            n = info[:, 1] - info[:, 0] + 1
            for a in range(0, len(n), SPANS):
                k = n[a : a + SPANS]
                of = np.repeat(np.arange(a, a + len(k)), k)
                start = info[of, 0] + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                place = offs[doc[of]] + start
                yield pa.RecordBatch.from_pydict({"row": pa.array(row[doc[of]]), "start": pa.array(start), "h": pa.array(hashes(place, place + least).astype(np.int64)), "weight": pa.array(info[of, 2])})

    return run


def _joined(values: DataFrame, name: str, *cols: str, kind: str = "bigint") -> DataFrame:
    """``row, name``: each row's tuples as packed integers; a document bounds them."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("list"):
                v = x.values
                out.append(np.stack([v.field(c).to_numpy() for c in cols], 1).astype("<i4" if kind == "int" else "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), name: pa.array(out, pa.binary())})

    return values.groupBy("row").agg(F.collect_list(F.struct(*(F.col(c).cast(kind).alias(c) for c in cols))).alias("list")).mapInArrow(run, f"row long, {name} binary")


def repeated(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(texts with ``row, doc_id, text``; ``row, marks, n_shared_blocks``): the byte ranges of windows that occur again, packed; places that share 3 blocks with other rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    own = with_rows(docs, ["doc_id", "text"], scratch).select("doc_id", "row", "text")
    ranks = prefix_doubling(map_chunks(own, lambda *a: _blocks(*a, least), "row long, j long, rank long", most=CHUNK), scratch)
    flagged = ranks.select("row", "j", (F.col("level") + F.when(F.col("shared"), SHARED).otherwise(0)).alias("level"))
    levels = scratch.keep(_joined(flagged, "levels", "j", "level", kind="int"), "levels")
    packed = _pack(own, levels.select("row")).join(levels, "row")
    direct = map_chunks(own, lambda *a: _direct(*a, least), "row long, start long, h long, low long, high long, anchor long, whole long", most=CHUNK)
    direct = scratch.keep(direct, "direct")
    families = packed.mapInArrow(lean(_family_rows(least)), "row long, low long, high long, anchor long, whole long")
    families = scratch.keep(families.union(direct.filter("start IS NULL").select(*families.columns)), "families")
    for k in range(LEVELS):
        scratch.drop(f"rank-{k}")
    wholes = families.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "low", "high")).alias("f"))
    wholes = scratch.keep(wholes.select("anchor", "whole", "n", "f.row", "f.low", "f.high"), "wholes")
    mixed = wholes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).filter("kinds > 1 AND fewest = 1").select("anchor")
    open_ = wholes.join(mixed, "anchor").select("row", "low", "high", F.least("n", F.lit(2)).alias("weight"))
    spans = scratch.keep(_joined(open_, "spans", "low", "high", "weight"), "spans")
    windows = _pack(own, spans.select("row")).join(spans, "row").mapInArrow(lean(_window_rows(least)), "row long, start long, h long, weight long")
    bare = direct.filter("start IS NOT NULL").select("row", "start", "h", F.lit(1).cast("long").alias("weight"))
    windows = scratch.keep(windows.union(bare), "windows")
    again = windows.groupBy("h").agg(F.sum("weight").alias("w"), F.min("weight").alias("one")).filter("w > 1 AND one = 1").select("h")
    single = windows.filter("weight = 1").join(again, "h").select("row", "start", (F.col("start") + least).alias("end"))
    whole = families.join(wholes.filter("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("row", F.col("low").alias("start"), (F.col("high") + least).alias("end"))
    marks = _joined(single.union(whole), "marks", "start", "end")
    return own, scratch.keep(marks.join(levels.mapInArrow(_shared, "row long, n_shared_blocks long").filter("n_shared_blocks > 0"), "row", "full"), "marks")


def _shared(batches):
    for batch in batches:
        data, at = flat(batch.column("levels"))
        info = np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2).astype(np.int64)
        own = np.repeat(np.arange(len(at) - 1), np.diff(at) // 8)
        flagged = info[:, 1] >= SHARED
        key = np.sort((own[flagged] << 33) | info[flagged, 0])
        twice = key[:-1][np.diff(key) == 1] >> 33
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "n_shared_blocks": pa.array(np.bincount(twice, minlength=len(at) - 1).astype(np.int64))})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_blocks long"


def _cut(buf, offs, marks):
    """Kept bytes of each text, how many go, in how many runs."""
    data, at = flat(marks)
    info = np.frombuffer(data.tobytes(), "<i8").reshape(-1, 2)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at) // 16)
    edges = np.zeros(len(buf) + 2, np.int64)
    np.add.at(edges, offs[doc] + info[:, 0], 1)
    np.add.at(edges, offs[doc] + info[:, 1], -1)
    gone = np.cumsum(edges[: len(buf)]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    begins[first] = gone[first]
    return [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], gone, begins


def _results(ids, buf, offs, marks, shared):
    kept, gone, begins = _cut(buf, offs, marks)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs]).astype(np.int64)
    return pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(sums(gone)), "n_spans": pa.array(sums(begins)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "n_shared_blocks": pa.compute.fill_null(shared, 0)})


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """What is left of every document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    ``n_shared_blocks`` counts the anchors whose next three blocks (some 150 bytes) other documents hold as well, two by two; so
    it also tells of shared passages that are too short to go."""
    own, marks = repeated(docs, least)
    held = docs.sparkSession.sparkContext.broadcast(id_bitmap(marks.select("row")))
    hashed = own.withColumn("hash", F.xxhash64("row"))

    def untouched(batch, buf, offs, bits):
        part = batch.filter(pa.array(~seen(bits, batch.column("hash").to_numpy())))
        none = pa.array([b""] * part.num_rows, pa.binary())
        return _results(part.column("doc_id"), *flat(part.column("text")), none, pa.nulls(part.num_rows, pa.int64()))

    def maybe(batch, buf, offs, bits):
        ok = seen(bits[0], batch.column("hash").to_numpy())
        part = batch.filter(pa.array(ok))
        raw, at = flat(part.column("text"))
        raw = raw.tobytes()
        return {"row": part.column("row"), "doc_id": part.column("doc_id"), "packed": pa.array([bits[1].compress(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())}

    def cut(batches):
        for batch, buf, offs in _unpacked(batches):
            yield _results(batch.column("doc_id"), buf, offs, batch.column("marks"), batch.column("n_shared_blocks"))

    direct = map_chunks(hashed, untouched, RESULT, setup=lambda: held.value, most=CHUNK)
    texts = map_chunks(hashed, maybe, "row long, doc_id long, packed binary", setup=lambda: (held.value, zstandard.ZstdCompressor(level=1)), most=CHUNK)
    return direct.union(texts.join(marks, "row", "left").mapInArrow(lean(cut), RESULT))
