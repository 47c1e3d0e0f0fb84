"""Files in ranges and blocks against serial readers and writers."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.sources import containers, files, sink


def stereo(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.clip(rng.normal(0, 0.4, (n, 2)), -1.2, 1.2)


def rows(spark, x, recording=0):
    return spark.createDataFrame([(recording, c, n, float(v)) for n, f in enumerate(x) for c, v in enumerate(f)], "recording long, channel int, n long, x double")


def folder(tmp_path):
    return f"file://{tmp_path}/out"


def serial(path):
    return containers.read_any(open(path, "rb").read())["samples"]


def together(blocks, path):
    got = sorted((r["start_frame"], r["channel"], r["samples"]) for r in blocks.filter(F.col("path").endswith(path)).collect())
    channels = max(c for _, c, _ in got) + 1
    return np.stack([np.concatenate([s for _, k, s in got if k == c]) for c in range(channels)], 1)


@pytest.mark.parametrize("kind,fmt", [("wav", "u8"), ("wav", "s16"), ("wav", "s24"), ("wav", "s32"), ("wav", "f32"), ("wav", "f64"), ("aiff", "s16"), ("aiff", "s24"), ("aiff", "s32")])
def test_blocks_make_the_serial_file(spark, tmp_path, kind, fmt):
    """Byte for byte what one writer makes of the whole, from several tasks; odd sizes are padded."""
    x, mono = stereo(1003), stereo(777, 1)[:, :1]
    sink.write(rows(spark, x).unionByName(rows(spark, mono, 7)).repartition(5), 44100, folder(tmp_path), kind, fmt, block=100)
    make = containers.aiff_bytes if kind == "aiff" else containers.wav_bytes
    for name, want in (("0", x), ("7", mono)):
        assert open(f"{tmp_path}/out/{name}.{kind}", "rb").read() == make(want, 44100, fmt)
    assert sorted(os.listdir(tmp_path)) == ["out"]
    # ranges of any size give what a reader of whole files gives
    blocks = files.read_blocks(spark, folder(tmp_path), 64)
    assert (together(blocks, f"/0.{kind}") == serial(f"{tmp_path}/out/0.{kind}")).all() and (together(blocks, f"/7.{kind}") == serial(f"{tmp_path}/out/7.{kind}")).all()


def test_gaps_are_silent_and_appending_keeps_other_files(spark, tmp_path):
    x = stereo(400)
    some = rows(spark, x).filter("n < 50 OR n >= 230").filter("NOT (channel = 1 AND n = 300)")
    want = x.copy()
    want[50:230], want[300, 1] = 0, 0
    sink.write(some, 8000, folder(tmp_path), fmt="u8", block=64)
    assert open(f"{tmp_path}/out/0.wav", "rb").read() == containers.wav_bytes(want, 8000, "u8")
    sink.write(rows(spark, x[:9], 1), 8000, folder(tmp_path), fmt="u8", mode="append")
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["0.wav", "1.wav"]
    sink.write(rows(spark, x[:9], 2), 8000, folder(tmp_path), fmt="u8")
    assert os.listdir(f"{tmp_path}/out") == ["2.wav"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    sink.write(rows(spark, stereo(9)), 8000, folder(tmp_path))
    bad = rows(spark, stereo(9)).withColumn("x", F.expr("CASE WHEN n = 5 THEN raise_error('broken') ELSE x END"))
    with pytest.raises(Exception):
        sink.write(bad, 8000, folder(tmp_path), mode="append")
    assert os.listdir(tmp_path) == ["out"] and os.listdir(f"{tmp_path}/out") == ["0.wav"]
    with pytest.raises(ValueError):
        sink.SignalWriter(folder(tmp_path), 8000, "aiff", "f32", True)
    with pytest.raises(ValueError):
        sink.local("s3://bucket/x")


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    """Two hours at 8 kHz: many ranges, each reads its own bytes."""
    frames = 2 * 3600 * 8000
    x = (np.arange(frames) * 7919 % 65536 - 32768).astype("<i2")
    os.makedirs(f"{tmp_path}/out")
    with open(f"{tmp_path}/out/long.wav", "wb") as f:
        f.write(containers.wav_header(1, 8000, "s16", frames) + x.tobytes())
    info = files.recordings(spark, folder(tmp_path))
    assert [tuple(r) for r in info.select("frames", "channels", "rate", "format", "data_offset").collect()] == [(frames, 1, 8000.0, "s16", 44)]
    got = files.blocks_of(info).select("start_frame", F.spark_partition_id().alias("task"), F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * 32768).alias("sum"), F.col("samples")[0].alias("first")).collect()
    assert len({r["task"] for r in got}) > 3 and sum(r["n"] for r in got) == frames
    for r in got:
        own = x[r["start_frame"] : r["start_frame"] + r["n"]].astype(float)
        assert (r["sum"], r["first"]) == (own.sum(), own[0] / 32768)
    # the data source plans the same ranges from the header alone
    spark.dataSource.register(files.SignalSource)
    df = spark.read.format("signal").option("blocks_per_partition", "100").load(folder(tmp_path))
    assert df.rdd.getNumPartitions() == -(-frames // (100 * files.BLOCK))
    assert df.agg(F.sum(F.size("samples"))).first()[0] == frames


def test_headers_are_read_without_samples(tmp_path):
    path = f"{tmp_path}/a.wav"
    with open(path, "wb") as f:
        f.write(containers.wav_header(2, 48000, "s24", 4_000_000))
        f.truncate(44 + 24_000_000)
        f.seek(0, 2)
        f.write(b"LIST" + struct.pack("<I", 16) + b"INFOINAM" + struct.pack("<I", 4) + b"End\0")
    with files.open_file(path) as file:
        read = files.Ranges(file)
        got = files._wav(read)
    assert got["texts"] == {"title": "End"} and read.bytes_read < 100_000


def chunk(tag, body):
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def test_texts_markers_and_broadcast_information(spark, tmp_path):
    os.makedirs(f"{tmp_path}/out/deeper")
    said = {"description": "A take", "originator": "Desk", "originatorReference": "R1", "originationDate": "2024-05-06", "originationTime": "07:08:09", "timeReference": 123456789012}
    head = containers.wav_header(1, 48000, "s16", 10, {"title": "Näme", "comment": "odd"}, said)
    cue = struct.pack("<I", 3) + b"".join(struct.pack("<II4sIII", i, 0, b"data", 0, 0, p) for i, p in ((1, 5), (2, 7), (3, 9)))
    labels = b"adtl" + chunk(b"labl", struct.pack("<I", 1) + b"first\0") + chunk(b"labl", struct.pack("<I", 2) + b"2nd\0")
    open(f"{tmp_path}/out/a.wav", "wb").write(head + bytes(20) + chunk(b"cue ", cue) + chunk(b"LIST", labels))
    mark = struct.pack(">H", 2) + struct.pack(">HIB", 1, 3, 4) + b"four\0" + struct.pack(">HIB", 2, 6, 3) + b"abc"
    aiff = containers.aiff_bytes(stereo(8), 44100, "s16")
    open(f"{tmp_path}/out/deeper/b.aiff", "wb").write(aiff + b"MARK" + struct.pack(">I", len(mark)) + mark + b"NAME" + struct.pack(">I", 4) + b"Song")
    for name, content in (("c.wav", b"RIFF\0\0\0\0WAVEfmt "), ("d.txt", b"no sound"), ("e.wav", b""), ("f.flac", b"fLaC" + bytes(40)), ("g.wav", head[:30]), ("h.wav", containers.wav_bytes(stereo(50), 8000, "s16")[:-60])):
        open(f"{tmp_path}/out/{name}", "wb").write(content)
    got = {r["path"].rpartition("/")[2]: r for r in files.recordings(spark, folder(tmp_path)).collect()}
    a = got["a.wav"]
    assert a["texts"] == {"title": "Näme", "comment": "odd"} and a["time_reference"] == said["timeReference"] and a["broadcast"] == {k: v for k, v in said.items() if k != "timeReference"}
    assert [(m["position"], m["label"]) for m in a["markers"]] == [(5, "first"), (7, "2nd"), (9, "")] and a["frames"] == 10
    b = got["b.aiff"]
    assert b["texts"] == {"title": "Song"} and [(m["position"], m["label"]) for m in b["markers"]] == [(3, "four"), (6, "abc")] and (b["frames"], b["channels"], b["rate"]) == (8, 2, 44100.0)
    assert all(got[n]["error"] for n in ("c.wav", "d.txt", "f.flac", "g.wav")) and got["h.wav"]["frames"] == 35
    blocks = files.read_blocks(spark, folder(tmp_path))
    assert {r["path"].rpartition("/")[2] for r in blocks.filter("error IS NOT NULL").collect()} == {"c.wav", "d.txt", "f.flac", "g.wav"}
    assert together(blocks, "/h.wav").shape == (35, 2)
    spark.dataSource.register(files.SignalSource)
    again = spark.read.format("signal").load(folder(tmp_path))
    pick = lambda df: sorted((r["path"].rpartition("/")[2], r["channel"], r["samples"]) for r in df.filter("error IS NULL").collect())
    assert pick(again) == pick(blocks)


def test_sizes_beyond_32_bits(tmp_path):
    frames = 1 << 30
    head = containers.wav_header(2, 48000, "s24", frames)
    assert head[:4] == b"RF64" and containers.wav_header(2, 48000, "s24", 10)[:4] == b"RIFF"
    path = f"{tmp_path}/big.wav"
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + frames * 6)
        f.seek(0, 2)
        f.write(b"LIST" + struct.pack("<I", 16) + b"INFOINAM" + struct.pack("<I", 4) + b"End\0")
    got = files.probe(path)
    assert (got["frames"], got["texts"], got["error"]) == (frames, {"title": "End"}, None)
    with pytest.raises(ValueError):
        containers.aiff_header(2, 48000, "s24", frames)
    short, long = containers.wav_header(2, 48000, "s24", 10, grows=True), containers.wav_header(2, 48000, "s24", frames, grows=True)
    assert len(short) == len(long) and containers.read_wav(short + bytes(60))["samples"].shape == (10, 2)


def test_a_stream_lets_files_grow(spark, tmp_path):
    """Batches in any order, one of them twice; after each the file is whole as far as it goes."""
    x = stereo(500)
    grow = sink.append(folder(tmp_path), 8000, 2, "s16", block=64)
    df = rows(spark, x).cache()
    parts = [df.filter(f"n >= {a} AND n < {b}") for a, b in ((0, 130), (200, 301), (130, 200), (200, 301), (301, 500))]
    for i, (part, upto) in enumerate(zip(parts, (130, 301, 301, 301, 500))):
        grow(part, i)
        got = serial(f"{tmp_path}/out/0.wav")
        assert len(got) == upto
    quantised = containers.read_wav(containers.wav_bytes(x, 8000, "s16"))["samples"]
    assert (got == quantised).all()
    with pytest.raises(ValueError):
        grow(df.withColumn("channel", F.lit(2)), 9)


def test_a_streaming_query_writes_files(spark, tmp_path):
    x = stereo(300)
    df = rows(spark, x).withColumn("part", F.floor(F.col("n") / 100))
    for k in range(3):
        df.filter(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("recording long, channel int, n long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(sink.append(folder(tmp_path), 8000, 2, "f64")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and np.array_equal(serial(f"{tmp_path}/out/0.wav"), x) and math.isfinite(x.sum())
