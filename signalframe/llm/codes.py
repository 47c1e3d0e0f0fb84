"""Codes of vectors (product quantisation) by delta-maintained Lloyd rounds on integers.

Vectors are cut into equal consecutive parts; each part position has a codebook, and a vector's code is the number of the nearest
entry of each.  Rounds keep the assignments of the round before beside the vectors, so that only the contributions of parts
that *changed* their entry travel (``lloyd``).

Defined cases: vectors that are null or hold null or non-finite components are dropped.  The length of the vectors is that of the
smallest kept ``vec_id``; a vector of another length, or with a component too large for exact 64-bit distances (``lloyd.reach``),
stays as a row without code and error and takes no part; so do all if the parts can't be equal.  Equal ids begin in the
order of their vectors; null ids come last.  With fewer vectors than entries the codebooks are shorter; an empty table gives no rows.
Null labels are one label; a sum of errors beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Scratch, lean, split_join
from .lloyd import MOVES, Centroids, Moves, Rounds, integers, matrix, reach, sound, squared, total

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


class Codes:
    """What ``compress`` gives: ``rows`` (vec_id, label, code, error), the codebooks (part x entry x component) and the number of moves in each round."""

    def __init__(self, rows: DataFrame, codebooks: np.ndarray, moves: list[int]):
        self.rows, self.codebooks, self.moves = rows, codebooks, moves

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def decode(self, scale: int = SCALE) -> DataFrame:
        """``vec_id, embedding``: the vectors that the codes stand for (the middle of each integer's range)."""
        books = self.codebooks

        def run(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
                out = np.concatenate([books[p][codes[:, p]] for p in range(len(books))], 1)
                flat = pa.array(((out + 0.5) / scale).ravel())
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * out.shape[1], pa.int32()), flat)})

        kept = self.rows.filter("code IS NOT NULL").select("vec_id", "code")
        return kept.mapInArrow(lean(run), f"vec_id {dict(kept.dtypes)['vec_id']}, embedding array<double>")


def _round(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Every vector with the numbers of its nearest entries and its squared distance from them; then the task's contributions."""
    parts, entries, width = books.shape
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, code binary, error long, {MOVES}"

    def run(batches):
        moves, form = Moves(parts, entries, width), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v, old = matrix(batch, "v", parts * width), batch.column("code")
            before = np.full((n, parts), -1) if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            code, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
            for p in range(parts):
                own = v[:, p * width : (p + 1) * width]
                far = squared(own, books[p])
                code[:, p] = far.argmin(1)  # the first of equals
                error += far[np.arange(n), code[:, p]]
                moves.add(p, own, before[:, p], code[:, p])
            new = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            none = {"part": pa.nulls(n, pa.int32()), "entry": pa.nulls(n, pa.int32()), "sums": pa.nulls(n, pa.list_(pa.int64())), "n": pa.nulls(n, pa.int64())}
            out = pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": batch.column("v"), "code": new, "error": pa.array(error), **none})
            form = out.schema
            yield out
        if form is not None and (last := moves.rows(form)) is not None:
            yield last

    return rows.mapInArrow(lean(run), schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codebooks and codes of ``vec_id, embedding, label``; at most 256 entries (a byte for each part)."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    kept = vectors.filter(sound(F.col("embedding"))).select("vec_id", "label", "embedding")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).select(F.size("embedding").alias("d")).limit(1).collect()
    d = first[0]["d"] if first else 0
    fits = d > 0 and d % parts == 0
    v = F.when(F.size("embedding") == d, integers(F.col("embedding"), scale, reach(d))) if fits else F.lit(None).cast("array<int>")
    placed = scratch.keep(kept.select("vec_id", "label", v.alias("v")), "vectors")
    able, unable = placed.filter("v IS NOT NULL"), placed.filter("v IS NULL")
    begin = able.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect() if fits else []
    none = unable.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not begin:
        return Codes(none, np.zeros((parts, 0, 0), np.int64), [])
    books = Centroids(np.array([r["v"] for r in begin], np.int64).reshape(len(begin), parts, d // parts).transpose(1, 0, 2))
    state = Rounds(scratch, able.withColumn("code", F.lit(None).cast("binary")))
    for _ in range(rounds):
        books.update(state.next(_round(state.now, books.at)))
    state.next(_round(state.now, books.at))
    return Codes(state.now.select("vec_id", "label", "code", "error").unionByName(none), books.at, books.moves)


def digest(codes: Codes) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: codes in hex, errors also summed over equal labels."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = codes.rows.withColumn("_label", key)
    sums = Scratch(rows.sparkSession, "labels").keep(rows.groupBy("_label").agg(total("error").alias("label_error"), F.count("*").alias("_n")), "sums")
    out = split_join(rows, sums, ["_label"], "_n", sums.agg(F.sum("_n")).first()[0] or 0)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
