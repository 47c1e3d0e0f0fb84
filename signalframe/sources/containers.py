"""WAV and AIFF containers as Spark tables: ``recordings`` (one row a file) and ``signal_blocks`` (arrays of samples).

Files come through Spark's ``binaryFile`` reader, so any store that Spark reads will do.  ``write_wav`` gives each
recording's bytes as a row; the caller chooses where they go.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK = 65536
FORMATS = {"u8": (1, 8), "s16": (1, 16), "s24": (1, 24), "s32": (1, 32), "f32": (3, 32), "f64": (3, 64)}


def sniff(head: bytes) -> str | None:
    """wav, aiff, flac, mp3 or nothing, from the first bytes."""
    if head[:4] in (b"RIFF", b"RF64") and head[8:12] == b"WAVE":
        return "wav"
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    if head[:3] == b"ID3" and len(head) >= 10:
        size = (head[6] & 127) << 21 | (head[7] & 127) << 14 | (head[8] & 127) << 7 | head[9] & 127
        return sniff(head[10 + size :]) if len(head) > 14 + size else "mp3"
    if head[:4] == b"fLaC":
        return "flac"
    if len(head) > 3 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0 and head[1] & 0x06 and head[2] >> 4 not in (0, 15):
        return "mp3"
    return None


def _integers(raw: bytes, bits: int, big: bool) -> np.ndarray:
    if bits == 8:
        return (np.frombuffer(raw, np.int8 if big else np.uint8).astype(np.float64) - (0 if big else 128)) / 128
    if bits == 24:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if big else b
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    return np.frombuffer(raw, f"{'>' if big else '<'}i{bits // 8}") / float(1 << (bits - 1))


def read_wav(data: bytes) -> dict:
    """Rate, channels, format, markers, texts, and samples (frames x channels) of a WAV file."""
    if sniff(data[:16]) != "wav":
        raise ValueError("not a WAV file")
    at, out, size64 = 12, {"markers": {}, "texts": {}, "labels": {}}, None
    names = {b"INAM": "title", b"IART": "artist", b"ICMT": "comment", b"ISFT": "software", b"ICRD": "date"}
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if tag == b"ds64":
            size64 = struct.unpack_from("<Q", data, body + 8)[0]
        elif tag == b"fmt ":
            code, out["channels"], out["rate"], _, out["align"], out["bits"] = struct.unpack_from("<HHIIHH", data, body)
            out["code"] = struct.unpack_from("<H", data, body + 24)[0] if code == 0xFFFE else code
        elif tag == b"data":
            size = size64 if size == 0xFFFFFFFF and size64 is not None else size
            out["raw"] = data[body : body + size]
        elif tag == b"LIST" and data[body : body + 4] == b"INFO":
            p = body + 4
            while p + 8 <= body + size:
                k, n = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
                if k in names:
                    out["texts"][names[k]] = data[p + 8 : p + 8 + n].split(b"\0")[0].decode("utf-8", "replace")
                p += 8 + n + n % 2
        elif tag == b"cue ":
            for i in range(struct.unpack_from("<I", data, body)[0]):
                k, *_, place = struct.unpack_from("<II4sIII", data, body + 4 + 24 * i)
                out["markers"][k] = place
        at = body + size + size % 2
    bits, code = out["bits"], out["code"]
    raw = out.pop("raw", b"")
    raw = raw[: len(raw) // out["align"] * out["align"]]
    x = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64) if code == 3 else _integers(raw, bits, False)
    return out | {"samples": x.reshape(-1, out["channels"]), "format": f"f{bits}" if code == 3 else "u8" if bits == 8 else f"s{bits}"}


def read_aiff(data: bytes) -> dict:
    """The same for AIFF and AIFF-C (NONE, sowt, fl32, fl64)."""
    if sniff(data[:16]) != "aiff":
        raise ValueError("not an AIFF file")
    at, out, raw, kind = 12, {"markers": {}, "texts": {}}, b"", b"NONE"
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        body = at + 8
        if tag == b"COMM":
            out["channels"], _, out["bits"], exponent, mantissa = struct.unpack_from(">hIhHQ", data, body)
            out["rate"] = int(round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)))
            kind = data[body + 18 : body + 22] if data[8:12] == b"AIFC" else b"NONE"
        elif tag == b"SSND":
            raw = data[body + 8 + struct.unpack_from(">I", data, body)[0] : body + size]
        elif tag in (b"NAME", b"AUTH", b"ANNO"):
            out["texts"][{b"NAME": "title", b"AUTH": "artist", b"ANNO": "comment"}[tag]] = data[body : body + size].rstrip(b"\0").decode("utf-8", "replace")
        at = body + size + size % 2
    float_bits = {b"fl32": 4, b"FL32": 4, b"fl64": 8, b"FL64": 8}.get(kind)
    width = (float_bits or (out["bits"] + 7) // 8) * out["channels"]
    raw = raw[: len(raw) // width * width]
    x = np.frombuffer(raw, f">f{float_bits}").astype(np.float64) if float_bits else _integers(raw, out["bits"], kind != b"sowt")
    return out | {"samples": x.reshape(-1, out["channels"]), "format": f"f{float_bits * 8}" if float_bits else f"s{out['bits']}"}


def read_any(data: bytes) -> dict:
    kind = sniff(data[:4096])
    if kind not in ("wav", "aiff"):
        raise ValueError(f"no decoder for {kind or 'this file'}")
    return {"wav": read_wav, "aiff": read_aiff}[kind](data)


def _pack(x: np.ndarray, fmt: str, big: bool = False) -> bytes:
    code, bits = FORMATS[fmt]
    if code == 3:
        return x.astype(f"{'>' if big else '<'}f{bits // 8}").tobytes()
    top = 1 << (bits - 1)
    scaled = x * top
    v = np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), -top, top - 1).astype(np.int64)
    if bits == 8:
        return (v + (0 if big else 128)).astype(np.uint8 if not big else np.int8).tobytes()
    if bits == 24:
        b = (v.ravel() & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return (b[:, ::-1] if big else b).tobytes()
    return v.astype(f"{'>' if big else '<'}i{bits // 8}").tobytes()


def wav_header(channels: int, rate: int, fmt: str, frames: int, texts: dict | None = None, broadcast: dict | None = None, grows: bool = False) -> bytes:
    """All that stands before the samples; RF64 where 32 bits can't hold the sizes.  ``broadcast`` has the texts of ``files.BEXT`` and ``timeReference``.

    The header of a file that ``grows`` is as long in either form: a chunk without meaning keeps the place."""
    code, bits = FORMATS[fmt]
    ch, data = channels, frames * channels * bits // 8
    tags = {"title": b"INAM", "artist": b"IART", "comment": b"ICMT", "software": b"ISFT", "date": b"ICRD"}
    info = b"".join(tags[k] + struct.pack("<I", len(v.encode()) + 1) + v.encode() + b"\0" + b"\0" * ((len(v.encode()) + 1) % 2) for k, v in (texts or {}).items() if v)
    parts = b"fmt " + struct.pack("<IHHIIHH", 16, code, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    if broadcast:
        fields = b"".join(str(broadcast.get(k, "")).encode()[:n].ljust(n, b"\0") for k, n in (("description", 256), ("originator", 32), ("originatorReference", 32), ("originationDate", 10), ("originationTime", 8)))
        parts += b"bext" + struct.pack("<I", 602) + fields + struct.pack("<QH", int(broadcast.get("timeReference", 0)), 1) + bytes(254)
    if info:
        parts += b"LIST" + struct.pack("<I", 4 + len(info)) + b"INFO" + info
    size = 4 + len(parts) + 8 + data + data % 2
    if grows and size + 36 < 1 << 32:
        parts, size = b"JUNK" + struct.pack("<I", 28) + bytes(28) + parts, size + 36
    if size < 1 << 32:
        return b"RIFF" + struct.pack("<I", size) + b"WAVE" + parts + b"data" + struct.pack("<I", data)
    return b"RF64" + struct.pack("<I", (1 << 32) - 1) + b"WAVEds64" + struct.pack("<IQQQI", 28, size + 36, data, frames, 0) + parts + b"data" + struct.pack("<I", (1 << 32) - 1)


def wav_bytes(x: np.ndarray, rate: int, fmt: str = "s24", texts: dict | None = None) -> bytes:
    """A WAV file of ``x`` (frames x channels)."""
    body = _pack(x, fmt)
    return wav_header(x.shape[1], rate, fmt, len(x), texts) + body + b"\0" * (len(body) % 2)


def aiff_header(channels: int, rate: int, fmt: str, frames: int) -> bytes:
    """All that stands before the samples of an AIFF file of 16, 24 or 32-bit integers."""
    if fmt not in ("s16", "s24", "s32"):
        raise ValueError("AIFF takes 16, 24 or 32-bit integers")
    bits = FORMATS[fmt][1]
    data = frames * channels * bits // 8
    if data >= (1 << 32) - 64:
        raise ValueError("an AIFF file holds at most 4 GiB")
    shift = 63 - (rate.bit_length() - 1)
    comm = struct.pack(">hIhHQ", channels, frames, bits, 16383 + 63 - shift, rate << shift)
    parts = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", data + 8, 0, 0)
    return b"FORM" + struct.pack(">I", 4 + len(parts) + data + data % 2) + b"AIFF" + parts


def aiff_bytes(x: np.ndarray, rate: int, fmt: str = "s24") -> bytes:
    body = _pack(x, fmt, True) if fmt in ("s16", "s24", "s32") else b""
    return aiff_header(x.shape[1], rate, fmt, len(x)) + body + b"\0" * (len(body) % 2)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``path, channel, block_index, start_frame, rate, samples, error`` of all files below a path; what can't be read gives one row with its error."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    got = read_any(bytes(content))
                except (ValueError, KeyError, struct.error) as e:
                    yield pd.DataFrame({"path": [name], "channel": [None], "block_index": [None], "start_frame": [None], "rate": [None], "samples": [None], "error": [str(e)]})
                    continue
                x = got["samples"]
                for s in range(0, len(x), block):
                    yield pd.DataFrame({"path": name, "channel": range(x.shape[1]), "block_index": s // block, "start_frame": s, "rate": float(got["rate"]), "samples": [c for c in x[s : s + block].T], "error": None})

    schema = "path string, channel int, block_index long, start_frame long, rate double, samples array<double>, error string"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, schema)


def kind_of(path: str) -> str:
    """The container that a path's extension names: aiff or, for all others, wav."""
    ext = path.rpartition(".")[2].lower()
    if ext == "flac":
        raise ValueError("there is no FLAC encoder here")
    return "aiff" if ext in ("aif", "aiff", "aifc") else "wav"


def write_files(samples: DataFrame, rate: int, kind: str = "wav", fmt: str = "s24") -> DataFrame:
    """``recording, content``: each recording as the bytes of a file.  A depth that AIFF can't hold becomes 24 bits.

    A file's bytes are one cell, so a recording must fit into a task; the native store of long ones is a table of blocks."""
    fmt = "s24" if kind == "aiff" and fmt not in ("s16", "s24", "s32") else fmt
    make = aiff_bytes if kind == "aiff" else wav_bytes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="n", columns="channel", values="x").sort_index().fillna(0.0).to_numpy()
        return pd.DataFrame({"recording": [pdf["recording"].iloc[0]], "content": [make(x, rate, fmt)]})

    return samples.groupBy("recording").applyInPandas(run, "recording long, content binary")


def write_wav(samples: DataFrame, rate: int, fmt: str = "s24") -> DataFrame:
    return write_files(samples, rate, "wav", fmt)
