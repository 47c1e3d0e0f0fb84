"""Sound files written by many tasks: every task puts its blocks at their own place in a file.

A header's size and a recording's length are known before the first block, so a block's place follows from its number.  Blocks are dealt out whatever the
recording; a task that is run again writes the same bytes to the same places.  Files grow in a hidden folder beside their own, and the commit moves them.
That takes a folder that all executors share and that allows writing at offsets (local, NFS and the like; object stores don't).

``append`` does the same for a stream's batches: frames have absolute numbers, so a batch that comes twice changes nothing, and headers are set after the data,
so that a reader always finds a whole file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..operators.blocks import BLOCK
from ..scratch import Scratch
from .containers import FORMATS, _pack, aiff_header, wav_header

RUNS = "recording long, start long, frames long, channels int, content binary"


def local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError("files are written in blocks to folders that allow writing at offsets; other stores take tables of blocks")
    return path


def header(kind: str, channels: int, rate: int, fmt: str, frames: int) -> bytes:
    return (aiff_header if kind == "aiff" else wav_header)(channels, rate, fmt, frames)


def frame_runs(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """``RUNS``: for each block of a recording the frames that are there, in runs without gaps, as interleaved doubles; a channel that a frame lacks is silent."""
    rows = samples.select(F.col("recording").cast("long").alias("recording"), F.floor(F.col("n") / block).cast("long").alias("block"), F.col("n").cast("long").alias("n"), F.col("channel").cast("int").alias("channel"), F.col("x").cast("double").alias("x"))
    rows = rows.repartition("recording", "block").sortWithinPartitions("recording", "block", "n")

    def whole(key: tuple, held: list) -> Iterator[pa.RecordBatch]:
        n, c, x = (np.concatenate(v) for v in zip(*held))
        channels, first = int(c.max()) + 1, np.append(True, n[1:] != n[:-1])
        at = np.cumsum(first) - 1
        out = np.zeros((at[-1] + 1, channels))
        out[at, c] = x
        places = n[first]
        edges = [0, *(np.flatnonzero(np.diff(places) > 1) + 1).tolist(), len(places)]
        for a, b in zip(edges, edges[1:]):
            yield pa.RecordBatch.from_pydict({"recording": [key[0]], "start": [int(places[a])], "frames": [b - a], "channels": pa.array([channels], pa.int32()), "content": [out[a:b].tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            r, b, n, c, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("recording", "block", "n", "channel", "x"))
            cuts = np.flatnonzero((r[1:] != r[:-1]) | (b[1:] != b[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]):
                now = (int(r[i]), int(b[i]))
                if held and now != key:
                    yield from whole(key, held)
                    held = []
                key = now
                held.append((n[i:j], c[i:j], x[i:j]))
        if held:
            yield from whole(key, held)

    return rows.mapInArrow(run, RUNS)


def layout(samples: DataFrame) -> DataFrame:
    """``recording, of_channels, of_frames``."""
    return samples.groupBy(F.col("recording").cast("long").alias("recording")).agg((F.max("channel") + 1).cast("int").alias("of_channels"), (F.max("n") + 1).alias("of_frames"))


def dense(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """``recording, start, frames, channels, content, of_channels, of_frames``: all blocks of all recordings, also those without samples."""
    sizes = Scratch(samples.sparkSession, "sink").keep(layout(samples), "layout")
    grid = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("of_frames") - 1) / block))))
    runs = frame_runs(samples, block).withColumn("block", F.floor(F.col("start") / block)).groupBy("recording", "block").agg(F.collect_list(F.struct("start", "frames", "channels", "content")).alias("runs"))
    return grid.join(runs, ["recording", "block"], "left").select("recording", (F.col("block") * block).alias("start"), F.least(F.lit(block), F.col("of_frames") - F.col("block") * block).alias("frames"), "of_channels", "of_frames", "runs")


def place(path: str, offset: int, content: bytes) -> None:
    """Writes at an offset; the file grows where it must."""
    fd = os.open(path, os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        at = 0
        while at < len(content):
            at += os.pwrite(fd, content[at:], offset + at)
    finally:
        os.close(fd)


def encode(x: np.ndarray, kind: str, fmt: str) -> bytes:
    return _pack(x, fmt, kind == "aiff")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class SignalWriter(DataSourceArrowWriter):
    """Writes the rows of ``dense`` below ``path``, a file for each recording."""

    def __init__(self, path: str, rate: int, kind: str, fmt: str, overwrite: bool):
        if kind not in ("wav", "aiff") or fmt not in FORMATS:
            raise ValueError(f"no encoder for {kind} of {fmt}")
        self.path, self.rate, self.kind, self.fmt, self.overwrite = local(path).rstrip("/"), rate, kind, fmt, overwrite
        header(kind, 1, rate, fmt, 0)  # a depth that the container can't hold is refused before anything runs
        self.hidden = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        names = set()
        for batch in iterator:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i] for k in ("recording", "start", "frames", "of_channels", "of_frames", "runs")}
                recording, start, frames, channels, total = (r[k].as_py() for k in ("recording", "start", "frames", "of_channels", "of_frames"))
                x = np.zeros((frames, channels))
                for run in r["runs"].as_py() or []:
                    own = np.frombuffer(run["content"]).reshape(run["frames"], run["channels"])
                    x[run["start"] - start : run["start"] - start + run["frames"], : run["channels"]] = own
                head, name = header(self.kind, channels, self.rate, self.fmt, total), f"{recording}.{self.kind}"
                body, size = encode(x, self.kind, self.fmt), FORMATS[self.fmt][1] // 8 * channels
                if start + frames == total:
                    body += b"\0" * (total * size % 2)
                place(f"{self.hidden}/{name}", len(head) + start * size, body)
                if start == 0:
                    place(f"{self.hidden}/{name}", 0, head)
                names.add(name)
        return Written(sorted(names))

    def commit(self, messages: list) -> None:
        if self.overwrite and os.path.isdir(self.path):
            shutil.rmtree(self.path)
        os.makedirs(self.hidden, exist_ok=True)
        if not os.path.exists(self.path):
            os.rename(self.hidden, self.path)
            return
        for name in {n for m in messages if m is not None for n in m.names}:
            os.replace(f"{self.hidden}/{name}", f"{self.path}/{name}")
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def write(samples: DataFrame, rate: int, path: str, kind: str = "wav", fmt: str = "s24", mode: str = "overwrite", block: int = BLOCK) -> None:
    """``recording, channel, n, x`` as a file for each recording below ``path``; frames that no row has are silent."""
    from .files import SignalSource

    spark = samples.sparkSession
    spark.dataSource.register(SignalSource)
    dense(samples, block).write.format("signal").option("rate", str(rate)).option("kind", kind).option("depth", fmt).mode(mode).save(path)


def append(path: str, rate: int, channels: int, fmt: str = "s24", block: int = BLOCK) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that lets WAV files grow by each batch of ``recording, channel, n, x``.

    The number of channels is fixed for all batches.  Frames between batches that never come are silent."""
    if fmt not in FORMATS or fmt == "u8":
        raise ValueError("16, 24 or 32-bit integers or floats")
    folder, head, size = local(path).rstrip("/"), len(wav_header(channels, rate, fmt, 0, grows=True)), FORMATS[fmt][1] // 8 * channels

    def data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.zeros((r["frames"], channels))
                x[:, : r["channels"]] = np.frombuffer(r["content"]).reshape(r["frames"], r["channels"])
                place(f"{folder}/{r['recording']}.wav", head + r["start"] * size, encode(x, "wav", fmt))
                yield pa.RecordBatch.from_pydict({"recording": [r["recording"]], "end": [r["start"] + r["frames"]]})

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{folder}/{r['recording']}.wav"
                frames = max(r["end"], (os.path.getsize(name) - head) // size)
                place(name, 0, wav_header(channels, rate, fmt, frames, grows=True))
                if frames * size % 2:
                    place(name, head + frames * size, b"\0")
            yield pa.RecordBatch.from_pydict({"recording": batch.column("recording")})

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.filter(F.col("channel") >= channels).limit(1).count():
            raise ValueError(f"there are {channels} channels")
        os.makedirs(folder, exist_ok=True)
        ends = Scratch(batch.sparkSession, "sink").keep(frame_runs(batch, block).mapInArrow(data, "recording long, end long"), "ends")
        ends.groupBy("recording").agg(F.max("end").alias("end")).mapInArrow(heads, "recording long").write.format("noop").mode("overwrite").save()

    return run
