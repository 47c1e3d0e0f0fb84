"""Sound files as distributed tables: headers by a scan that reads no samples, samples by ranges of frames.

``recordings`` lists files through Spark and reads a few kilobytes of each (chunk headers are walked by seeking), giving a row of format, texts,
broadcast information and markers.  ``read_blocks`` turns these rows into (file, range) rows, deals them out and reads each range by itself, so
a long file is read by as many tasks as it has blocks.  ``SignalSource`` is the same plan as a data source (``spark.read.format("signal")``).

Ranges need a store with random access that pyarrow knows (a local or mounted folder, S3, GCS, HDFS); ``containers.read_blocks`` takes whole files
from any store that Spark reads.  A file that can't be read is a row with its ``error``, one that is cut short has the frames that are there, and empty files are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scratch import Scratch
from .containers import BLOCK, FORMATS, _integers, sniff

MOST_CHUNK = 16 << 20  # of a chunk of texts or markers that is read
MOST_CHANNELS = 64
TASK_BYTES = 64 << 20  # of decoded samples that a task reads, about
#: Fixed names: text chunks of the two containers, and places in the broadcast chunk.
WAV_TEXTS = {b"INAM": "title", b"IART": "artist", b"ICMT": "comment", b"ISFT": "software", b"ICRD": "date"}
AIFF_TEXTS = {b"NAME": "title", b"AUTH": "artist", b"ANNO": "comment", b"(c) ": "copyright"}
BEXT = [("description", 0, 256), ("originator", 256, 288), ("originatorReference", 288, 320), ("originationDate", 320, 330), ("originationTime", 330, 338)]
AIFF_KINDS = {b"NONE": (1, True), b"twos": (1, True), b"sowt": (1, False), b"fl32": (3, True), b"FL32": (3, True), b"fl64": (3, True), b"FL64": (3, True)}

INFO = "path string, length long, kind string, rate double, channels int, format string, frames long, data_offset long, big_endian boolean, texts map<string,string>, broadcast map<string,string>, time_reference long, markers array<struct<position:long,length:long,label:string>>, error string"
BLOCKS = "path string, channel int, block_index long, start_frame long, rate double, samples array<double>, error string"


def open_file(path: str) -> pa.NativeFile:
    """A file for random access; paths are as Spark writes them."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class Ranges:
    """Reads of a file at offsets; small ones are answered from a window."""

    def __init__(self, file: pa.NativeFile, window: int = 1 << 14):
        self.file, self.size, self.window = file, file.size(), window
        self.at, self.held = 0, b""
        self.bytes_read = 0

    def __call__(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not self.at <= offset or offset + n > self.at + len(self.held):
            self.file.seek(offset)
            self.at, self.held = offset, self.file.read(max(n, self.window))
            self.bytes_read += len(self.held)
        return self.held[offset - self.at : offset - self.at + n]


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip()


def _chunks(read: Ranges, at: int, order: str, long: dict) -> Iterator[tuple[bytes, int, int]]:
    """(tag, offset, size) of chunks that follow each other; sizes never reach beyond the file.  A size of all ones stands in ``long``."""
    while at + 8 <= read.size:
        tag, size = struct.unpack(f"{order}4sI", read(at, 8))
        size = long.get(tag, size) if size == 0xFFFFFFFF else size
        size = min(size, read.size - at - 8)
        yield tag, at + 8, size
        at += 8 + size + size % 2


def _body(read: Ranges, offset: int, size: int) -> bytes:
    return read(offset, size) if size <= MOST_CHUNK else b""


def _format(code: int, bits: int, eight: str) -> str:
    name = eight if code == 1 and bits == 8 else f"{'f' if code == 3 else 's'}{bits}"
    if FORMATS.get(name, (0, 0))[0] != code:
        raise ValueError(f"no decoder for format {code} of {bits} bits")
    return name


def _wav(read: Ranges) -> dict:
    out = {"texts": {}, "broadcast": {}, "time_reference": None, "big_endian": False}
    cues, labels, data, long, known = {}, [], None, {}, None
    for tag, at, size in _chunks(read, 12, "<", long):
        if tag == b"ds64" and size >= 16:
            long[b"data"] = struct.unpack("<Q", read(at + 8, 8))[0]
        elif tag == b"fmt " and size >= 16:
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at, 16))
            if code == 0xFFFE and size >= 40:
                code, valid = struct.unpack("<H", read(at + 24, 2))[0], struct.unpack("<H", read(at + 18, 2))[0]
                bits = -(-valid // 8) * 8 if 0 < valid <= bits and valid <= 24 else bits
            known = (channels, rate, _format(code, bits, "u8"))
        elif tag == b"data":
            data = (at, size)
        elif tag == b"bext" and size >= 346:
            body = read(at, 346)
            out["broadcast"] = {name: _text(body[a:b]) for name, a, b in BEXT}
            out["time_reference"] = min(struct.unpack_from("<Q", body, 338)[0], (1 << 63) - 1)
        elif tag == b"cue " and size >= 4:
            body = _body(read, at, size)
            for i in range(min(struct.unpack_from("<I", body)[0] if body else 0, max(0, len(body) - 4) // 24)):
                number, place = struct.unpack_from("<I", body, 4 + 24 * i)[0], struct.unpack_from("<I", body, 24 + 24 * i)[0]
                cues[i] = (number, place)
        elif tag == b"LIST" and size >= 4:
            body = _body(read, at, size)
            p, which = 4, body[:4]
            while p + 8 <= len(body):
                k, n = struct.unpack_from("<4sI", body, p)
                if n > len(body) - p - 8:
                    break
                if which == b"INFO" and k in WAV_TEXTS:
                    out["texts"][WAV_TEXTS[k]] = _text(body[p + 8 : p + 8 + n])
                elif which == b"adtl" and k == b"labl" and n >= 4:
                    labels.append(_text(body[p + 12 : p + 8 + n]))
                p += 8 + n + n % 2
    if known is None or data is None:
        raise ValueError(f"no {'fmt' if known is None else 'data'} chunk")
    # labels belong to cue points in their order
    out["markers"] = [{"position": cues[i][1] if i in cues else 0, "length": 0, "label": labels[i] if i < len(labels) else ""} for i in range(max(len(cues), len(labels)))]
    return out | {"channels": known[0], "rate": float(known[1]), "format": known[2], "data_offset": data[0], "_bytes": data[1]}


def _aiff(read: Ranges) -> dict:
    out = {"texts": {}, "broadcast": {}, "time_reference": None, "markers": [], "big_endian": True}
    known = data = None
    for tag, at, size in _chunks(read, 12, ">", {}):
        if tag == b"COMM" and size >= 18:
            body = read(at, min(size, 22))
            channels, _, bits, exponent, mantissa = struct.unpack_from(">HIhHQ", body)
            kind = body[18:22] if read(8, 4) == b"AIFC" else b"NONE"
            if kind not in AIFF_KINDS:
                raise ValueError(f"no decoder for {kind!r}")
            code, out["big_endian"] = AIFF_KINDS[kind]
            bits = int(kind[2:]) if code == 3 else -(-bits // 8) * 8
            known = (channels, float(round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63))), _format(code, bits, "s8"))
        elif tag == b"SSND" and size >= 8:
            skip = struct.unpack(">I", read(at, 4))[0]
            data = (at + 8 + skip, max(0, size - 8 - skip))
        elif tag in AIFF_TEXTS:
            out["texts"][AIFF_TEXTS[tag]] = _text(_body(read, at, size))
        elif tag == b"MARK" and size >= 2:
            body, p = _body(read, at, size), 2
            for _ in range(struct.unpack_from(">H", body)[0] if body else 0):
                if p + 7 > len(body):
                    break
                _, place, n = struct.unpack_from(">HIB", body, p)
                out["markers"].append({"position": place, "length": 0, "label": _text(body[p + 7 : p + 7 + n])})
                p += 7 + n + (n + 1) % 2
    if known is None or data is None:
        raise ValueError(f"no {'COMM' if known is None else 'SSND'} chunk")
    return out | {"channels": known[0], "rate": known[1], "format": known[2], "data_offset": data[0], "_bytes": data[1]}


def probe(path: str) -> dict:
    """What a file's headers say, as a row of ``recordings``."""
    row = {k: None for k in ("length", "kind", "rate", "channels", "format", "frames", "data_offset", "big_endian", "texts", "broadcast", "time_reference", "markers", "error")} | {"path": path}
    try:
        with open_file(path) as file:
            read = Ranges(file)
            row["length"], row["kind"] = read.size, sniff(read(0, 4096))
            if row["kind"] not in ("wav", "aiff"):
                raise ValueError(f"no decoder for {row['kind'] or 'this file'}")
            row |= {"wav": _wav, "aiff": _aiff}[row["kind"]](read)
        if not 0 < row["channels"] <= MOST_CHANNELS or not row["rate"] > 0:
            raise ValueError("no such number of channels or rate")
        row["frames"] = row.pop("_bytes") // frame_bytes(row["format"], row["channels"])
    except (OSError, ValueError, struct.error) as e:
        row["error"] = str(e) or type(e).__name__
    row.pop("_bytes", None)
    return row


def frame_bytes(fmt: str, channels: int) -> int:
    return (8 if fmt == "s8" else FORMATS[fmt][1]) // 8 * channels


def decode(raw: bytes, fmt: str, channels: int, big: bool) -> np.ndarray:
    """Frames x channels."""
    bits = 8 if fmt == "s8" else FORMATS[fmt][1]
    x = np.frombuffer(raw, f"{'>' if big else '<'}f{bits // 8}").astype(np.float64) if fmt[0] == "f" else _integers(raw, bits, big or fmt == "s8")
    return x.reshape(-1, channels)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below a path (``INFO``); Spark lists them, and no more than the headers is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [probe(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: list(v.items()) if isinstance(v, dict) else v for k, v in r.items()} for r in rows], _arrow())

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.mapInArrow(run, INFO)


def _arrow() -> pa.Schema:
    text = pa.map_(pa.string(), pa.string())
    kinds = [("path", pa.string()), ("length", pa.int64()), ("kind", pa.string()), ("rate", pa.float64()), ("channels", pa.int32()), ("format", pa.string()), ("frames", pa.int64()), ("data_offset", pa.int64()), ("big_endian", pa.bool_()), ("texts", text), ("broadcast", text), ("time_reference", pa.int64())]
    return pa.schema([*kinds, ("markers", pa.list_(pa.struct([("position", pa.int64()), ("length", pa.int64()), ("label", pa.string())]))), ("error", pa.string())])


def _block_rows(path: str, rate: float, start: int, block: int, x: np.ndarray, error: str | None = None) -> pa.RecordBatch:
    frames, channels = x.shape
    n = max(channels, 1)
    samples = pa.ListArray.from_arrays(pa.array(np.arange(channels + 1) * frames, pa.int32()), pa.array(np.ascontiguousarray(x.T).ravel())) if channels else pa.nulls(1, pa.list_(pa.float64()))
    none = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([
        pa.array([path] * n), pa.array(np.arange(channels), pa.int32()) if channels else none(pa.int32()), pa.array([start // block] * n, pa.int64()) if channels else none(pa.int64()),
        pa.array([start] * n, pa.int64()) if channels else none(pa.int64()), pa.array([rate] * n, pa.float64()), samples, pa.array([error] * n, pa.string()),
    ], names=["path", "channel", "block_index", "start_frame", "rate", "samples", "error"])


def _read(file: pa.NativeFile, fmt: str, channels: int, big: bool, offset: int, start: int, frames: int) -> np.ndarray:
    size = frame_bytes(fmt, channels)
    file.seek(offset + start * size)
    raw = file.read(frames * size)
    return decode(raw[: len(raw) // size * size], fmt, channels, big)


def blocks_of(info: DataFrame, block: int = BLOCK) -> DataFrame:
    """``BLOCKS`` of the files of ``recordings`` (or of some of them): each row of (file, range) is read where it is dealt."""
    info = Scratch(info.sparkSession, "files").keep(info, "recordings")  # headers are read once
    sound = info.filter("error IS NULL AND frames > 0").select("path", "rate", "channels", "format", "big_endian", "data_offset", "frames")
    size = sound.agg(F.sum(F.col("frames") * F.col("channels") * 8)).first()[0] or 0
    # rows of ranges are small and what they stand for is not, so their number of tasks is given
    tasks = max(info.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    parts = sound.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(block).cast("long")))).repartition(int(tasks), "path", "start").sortWithinPartitions("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = name = None
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    if name != r["path"]:
                        if file is not None:
                            file.close()
                        name, file = r["path"], open_file(r["path"])
                    x = _read(file, r["format"], r["channels"], r["big_endian"], r["data_offset"], r["start"], min(block, r["frames"] - r["start"]))
                    yield _block_rows(r["path"], r["rate"], r["start"], block, x)
                except OSError as e:
                    name = None
                    yield _block_rows(r["path"], r["rate"], r["start"], block, np.zeros((0, 0)), str(e))
        if file is not None:
            file.close()

    bad = info.filter("error IS NOT NULL").selectExpr("path", "cast(null AS int) AS channel", "cast(null AS long) AS block_index", "cast(null AS long) AS start_frame", "rate", "cast(null AS array<double>) AS samples", "error")
    return parts.mapInArrow(run, BLOCKS).unionByName(bad)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    return blocks_of(recordings(spark, path), block)


def samples_of(blocks: DataFrame) -> DataFrame:
    """``path, channel, n, x`` of blocks."""
    return blocks.filter("error IS NULL").select("path", "channel", "start_frame", F.posexplode("samples").alias("i", "x")).select("path", "channel", (F.col("start_frame") + F.col("i")).alias("n"), "x")


# --- the same plan as a data source


class Range(InputPartition):
    def __init__(self, info: dict, start: int, frames: int, block: int):
        self.info, self.start, self.frames, self.block = info, start, frames, block


class SignalReader(DataSourceReader):
    """Partitions are (file, frames) ranges; the driver reads headers only, of ``most_files`` files at most."""

    def __init__(self, path: str, block: int, per_partition: int, most_files: int):
        self.path, self.block, self.per_partition, self.most_files = path, block, max(1, per_partition) * block, most_files

    def files(self) -> list[str]:
        local = self.path.startswith("file:") or "://" not in self.path
        inner = "/" + self.path.removeprefix("file:").lstrip("/") if self.path.startswith("file:") else self.path
        system, inner = (pafs.LocalFileSystem(), inner) if local else pafs.FileSystem.from_uri(self.path)
        scheme = "" if local else self.path.split("://")[0] + "://"
        top = system.get_file_info(inner)
        found = [top] if top.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        return sorted(scheme + f.path for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Range]:
        names = self.files()
        if len(names) > self.most_files:
            raise ValueError(f"{len(names)} files: read them with files.read_blocks, whose headers are read by tasks")
        with ThreadPoolExecutor(16) as pool:
            known = list(pool.map(probe, names))
        return [Range(k, s, min(self.per_partition, k["frames"] - s), self.block) for k in known if not k["error"] for s in range(0, k["frames"], self.per_partition)] + [Range(k, 0, 0, self.block) for k in known if k["error"]]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        k = partition.info
        if k["error"]:
            yield _block_rows(k["path"], k["rate"], 0, partition.block, np.zeros((0, 0)), k["error"])
            return
        with open_file(k["path"]) as file:
            for s in range(partition.start, partition.start + partition.frames, partition.block):
                x = _read(file, k["format"], k["channels"], k["big_endian"], k["data_offset"], s, min(partition.block, partition.start + partition.frames - s))
                yield _block_rows(k["path"], k["rate"], s, partition.block, x)


class SignalSource(DataSource):
    """``spark.read.format("signal").option("block", 65536).load(path)`` after ``spark.dataSource.register(SignalSource)``; writing is ``sink.SignalWriter``'s."""

    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> SignalReader:
        o = self.options
        return SignalReader(o["path"], int(o.get("block", BLOCK)), int(o.get("blocks_per_partition", 16)), int(o.get("most_files", 10_000)))

    def writer(self, schema, overwrite: bool):
        from .sink import SignalWriter

        o = self.options
        return SignalWriter(o["path"], int(float(o["rate"])), o.get("kind", "wav"), o.get("depth", "s24"), overwrite)
