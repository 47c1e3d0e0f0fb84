"""Known answers for the signal operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe import model
from signalframe.operators import channels, filters, loudness, measure, repair, spectral, statistics, timeline
from signalframe.sources import containers

RATE = 8000


def signal(spark, x, recording=0):
    x = np.atleast_2d(np.asarray(x, float))
    rows = [(recording, c, n, float(v)) for c, ch in enumerate(x) for n, v in enumerate(ch)]
    return spark.createDataFrame(rows, "recording long, channel int, n long, x double")


def tone(hz, seconds, amplitude=0.5, rate=RATE):
    return amplitude * np.sin(2 * math.pi * hz * np.arange(int(seconds * rate)) / rate)


def back(df):
    return np.array([r["x"] for r in df.orderBy("channel", "n").collect()])


def test_statistics(spark):
    r = statistics.signal_statistics(signal(spark, tone(1000, 1))).first()
    assert r["sample_peak_db"] == pytest.approx(-6.02, abs=0.05) and r["rms_db"] == pytest.approx(-9.03, abs=0.05)
    r = statistics.signal_statistics(signal(spark, [[-0.5, -0.5], [0.5, 0.5]])).first()
    assert r["dc_offset"] == -0.5  # a tie keeps the first channel
    r = statistics.signal_statistics(signal(spark, [0.0, 0.0])).first()
    assert r["crest_db"] == 0 and r["rms_db"] == -200


@pytest.mark.parametrize("l,r,corr", [([1.0, -1, 1], [1.0, -1, 1], 1), ([1.0, -1, 1], [-1.0, 1, -1], -1), ([1.0, -1, 1], [0.0, 0, 0], 0), ([0.0, 0, 0], [0.0, 0, 0], None)])
def test_stereo(spark, l, r, corr):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(l, r))], "n long, l double, r double")
    got = statistics.stereo_field(df).first()["correlation"]
    assert got == corr if corr is None else got == pytest.approx(corr)


def test_bits(spark):
    x = np.round(tone(300, 0.1) * 128) / 128
    assert statistics.effective_bits(signal(spark, x)).first()["effective_bits"] == 8
    assert statistics.effective_bits(signal(spark, [0.0])).first()[0] == 0


def test_loudness_of_a_sine(spark):
    df = signal(spark, [tone(1000, 5, 10 ** (-23 / 20), 48000)] * 2)
    r = loudness.programme(df, 48000).first()
    assert r["integrated"] == pytest.approx(-23, abs=0.1) and r["max_momentary"] == pytest.approx(-23, abs=0.1) and r["lra"] == 0


def test_k_weighting_needs_8_khz():
    with pytest.raises(ValueError):
        loudness.k_weighting(4000)


def test_fades(spark):
    r = spark.range(1).select(*(channels.fade(s, F.lit(0.5)).alias(s) for s in channels.SHAPES)).first()
    assert r["linear"] == 0.5 and r["exponential"] == 0.25 and r["s_curve"] == 0.5 and r["equal_power"] == pytest.approx(math.sqrt(0.5))


def test_channel_edits(spark):
    s = signal(spark, [[1, 2, 3], [4, 5, 6]])
    assert back(channels.channel_edit(s, "reverse", 3)).tolist() == [3, 2, 1, 6, 5, 4]
    assert back(channels.channel_edit(s, "swap", 3)).tolist() == [4, 5, 6, 1, 2, 3]
    with pytest.raises(ValueError):
        channels.channel_edit(s, "other", 3)


def test_filters(spark):
    low = filters.design("low_pass", RATE, 500)
    assert filters.stable(low)
    assert np.abs(back(filters.apply_sections(signal(spark, tone(3000, 0.5)), [low])))[1000:].max() < 0.02
    flat = filters.parametric_eq(signal(spark, tone(300, 0.1)), RATE, [{"kind": "peaking", "hz": 300.0, "gain_db": 9.0, "enabled": False}])
    assert np.allclose(back(flat), tone(300, 0.1))
    assert len(filters.butterworth("low_pass", RATE, 500, 8)) == 4


def test_dynamics(spark):
    x = np.concatenate([tone(400, 0.5, 0.9), tone(400, 0.5, 0.001)])
    assert np.abs(back(filters.limit(signal(spark, x), RATE, -6.0))).max() <= 10 ** (-6 / 20) + 1e-9
    assert np.abs(back(filters.compress(signal(spark, x), RATE)))[2000:4000].max() < 0.7
    gated = back(filters.gate(signal(spark, x), RATE, -40.0))
    assert np.abs(gated[-1000:]).max() < 1e-5 and np.abs(gated[2000:4000]).max() > 0.85


def test_resample_and_stretch(spark):
    y = back(filters.resample(signal(spark, tone(400, 0.5)), RATE, 16000))
    assert len(y) == 8000 and np.abs(y[500:7500] - tone(400, 0.5, 0.5, 16000)[500:7500]).max() < 1e-3
    z = back(repair.stretch(signal(spark, tone(400, 1)), 1.5))
    assert len(z) == 12000


def test_true_peak(spark):
    x = np.sin(2 * math.pi * 0.25 * np.arange(400) + math.pi / 4)  # samples miss the crest by 3 dB
    assert filters.true_peak(signal(spark, x)).first()["true_peak"] == pytest.approx(1, abs=0.03)


def test_stft_round_trip():
    x = np.random.default_rng(1).normal(size=5000)
    assert np.allclose(repair.istft(repair.stft(x, 512, 128), 512, 128, len(x)), x)


def test_repairs(spark):
    clean = tone(440, 1)
    x = clean.copy()
    x[4000] += 0.8
    assert abs(back(repair.declick(signal(spark, x)))[4000] - clean[4000]) < 0.01
    hum = clean + 0.3 * np.sin(2 * math.pi * 50 * np.arange(len(clean)) / RATE)
    assert np.abs(back(repair.dehum(signal(spark, hum), RATE, 50, 3)) - clean).max() < 0.05
    loud = np.clip(clean * 2, -0.8, 0.8)
    assert np.abs(back(repair.declip(signal(spark, loud), keep_level=True))).max() > 0.9


def test_null_test(spark):
    x = np.random.default_rng(7).normal(size=2000)
    y = np.concatenate([np.zeros(137), -0.5 * x])
    r = measure.null_test(signal(spark, x), signal(spark, y)).first()
    assert r["lag"] == 137 and r["gain"] == pytest.approx(-2) and r["residual_db"] < -120


def test_decay(spark):
    t60, n = 0.5, 8000
    x = 0.9 * np.exp(-6.9078 * np.arange(n) / RATE / t60) * np.random.default_rng(17).normal(size=n)
    curve = measure.schroeder(signal(spark, x))
    assert measure.decay_time(curve, RATE, -5, -25).first()["seconds"] == pytest.approx(t60, rel=0.05)


@pytest.mark.parametrize("hz", [110, 220, 441])
def test_pitch(hz):
    got, _, voiced = measure.yin(tone(hz, 0.256), RATE)
    assert voiced and got == pytest.approx(hz, rel=0.005)
    assert not measure.yin(np.random.default_rng(23).normal(size=2048), RATE)[2]


def test_key(spark):
    folded = spark.createDataFrame([(d, w) for d, w in zip((7, 11, 2, 9), (0.4, 0.25, 0.25, 0.1))], "pitch_class int, weight double")
    assert spectral.best_key(spectral.key_scores(spark, folded)).first()["key"] == "G major"


def test_render(spark):
    src = spark.createDataFrame([(1, n, float(n)) for n in range(10)], "source_id long, n long, x double")
    clips = spark.createDataFrame([(1, 1, 2, 0, 5, 1.0), (2, 1, 0, 3, 4, 2.0), (3, 9, 0, 0, 5, 1.0)], "clip_id long, source_id long, source_start long, timeline_start long, length long, gain double")
    x = [r["x"] for r in timeline.render(clips, src, 0, 8).orderBy("n").collect()]
    assert x == [2, 3, 4, 5, 6 + 0 + 2, 4, 6, 0] or x == [2, 3, 4, 5 + 0, 6 + 2, 4, 6, 0]
    cut = timeline.delete_range(clips, 2, 4).filter("clip_id = 1").orderBy("part").collect()
    assert [(r["timeline_start"], r["source_start"], r["length"]) for r in cut] == [(0, 2, 2), (2, 6, 1)]


@pytest.mark.parametrize("fmt", ["u8", "s16", "s24", "s32", "f32", "f64"])
def test_wav_round_trip(fmt):
    x = np.round(np.stack([tone(300, 0.01), tone(500, 0.01)], 1) * 64) / 64
    got = containers.read_wav(containers.wav_bytes(x, RATE, fmt, {"title": "a"}))
    assert np.array_equal(got["samples"], x) and got["rate"] == RATE and got["texts"]["title"] == "a"


def test_aiff_round_trip():
    x = np.round(tone(300, 0.01)[:, None] * 64) / 64
    got = containers.read_aiff(containers.aiff_bytes(x, 44100, "s24"))
    assert np.array_equal(got["samples"], x) and got["rate"] == 44100


def test_read_blocks(spark, tmp_path):
    x = np.round(tone(300, 0.05)[:, None] * 64) / 64
    (tmp_path / "a.wav").write_bytes(containers.wav_bytes(x, RATE, "s16"))
    (tmp_path / "b.bin").write_bytes(b"nothing")
    rows = containers.read_blocks(spark, str(tmp_path), 128).orderBy("path", "block_index").collect()
    assert np.array_equal(np.concatenate([r["samples"] for r in rows if r["samples"]]), x[:, 0]) and rows[-1]["error"]


def test_streaming_equals_batch(spark, tmp_path):
    from signalframe.streaming import meters

    x = tone(500, 2.05)
    blocks = [(0, 0, i, x[s : s + 700].tolist()) for i, s in enumerate(range(0, len(x), 700))]
    schema = "recording long, channel int, block_index long, samples array<double>"
    for part in (blocks[::2], blocks[1::2]):  # out of order
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = meters.loudness_meter(stream, RATE).writeStream.format("memory").queryName("meter").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["sub"]: r["sq"] for r in spark.table("meter").collect()}
    want = {r["sub"]: r["sq"] for r in loudness.sub_blocks(signal(spark, x), RATE).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_number(spark):
    """Places and values stay together however the rows are dealt: the sizes of the partitions come from the rows themselves."""
    df = spark.range(600_000).select((F.col("id") * 7919 % 600_000).alias("k"), F.rand(3).alias("v"), F.col("id").cast("string").alias("w"))
    for parts in ("4", "37"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = model.number(df, ["k"]).select("n", "k", "v")
        row = got.agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.sum((F.col("n") != F.col("k")).cast("int")).alias("wrong"), F.count("v").alias("v")).first()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert (row.c, row.d, row.wrong, row.v) == (600_000, 600_000, 0, 600_000)


@pytest.mark.parametrize("name", ["cascade", "compress", "limit", "denoise", "dereverb", "attenuate", "dehum", "resample", "true_peak", "exact", "multiband"])
def test_blocks_change_nothing(spark, name, monkeypatch):
    """However a recording is cut into blocks, the result is that of one block."""
    from signalframe.operators import advanced, blocks

    rng = np.random.default_rng(7)
    x = 0.3 * rng.standard_normal((2, 9000)) + np.sin(np.arange(9000) * 0.05)
    run = {
        "cascade": lambda s: blocks.cascade(s, filters.butterworth("low_pass", RATE, 700.0, 4)), "compress": lambda s: filters.compress(s, RATE, attack=0.002, release=0.01), "limit": lambda s: filters.limit(s, RATE, -6.0, release=0.01),
        "denoise": lambda s: repair.denoise(s, 0, 3000), "dereverb": lambda s: repair.dereverb(s, RATE), "attenuate": lambda s: repair.attenuate(s, RATE, 0.2, 0.6, 300.0, 900.0, -20.0),
        "dehum": lambda s: repair.dehum(s, RATE, 50.0, 3, 512), "resample": lambda s: filters.resample(s, RATE, 11025.0), "true_peak": filters.true_peak, "exact": advanced.exact_true_peak,
        "multiband": lambda s: advanced.multiband_compress(s, RATE, (800.0, 2000.0), release=0.01),
    }[name]
    s = signal(spark, x).repartition(3).cache()
    got = []
    for size in (1 << 16, 2048):
        for m in (blocks, filters, advanced):
            monkeypatch.setattr(m, "BLOCK", size)
        monkeypatch.setattr(repair, "SPAN", size)
        monkeypatch.setattr(blocks.cascades, "__defaults__", (None, size))
        monkeypatch.setattr(blocks.cascade, "__defaults__", (size,))
        monkeypatch.setattr(filters, "LEAST_SPAN", size)
        out = run(s)
        got.append(out.orderBy(*[c for c in out.columns if c not in ("x", "true_peak")]).toPandas())
    a, b = got
    assert len(a) == len(b) and (name in ("true_peak", "exact") or len(a) >= 18000)
    value = "true_peak" if "true_peak" in a else "x"
    assert np.abs(a[value] - b[value]).max() < 1e-9, np.abs(a[value] - b[value]).max()


def test_dither_draws_are_the_sequence(spark):
    from signalframe.operators import advanced

    state, want = advanced.SEED, []
    for _ in range(3000):
        state ^= state >> 12
        state ^= state << 25 & (1 << 64) - 1
        state ^= state >> 27
        want.append((state * advanced.SCRAMBLE % (1 << 64) >> 11) / 2**53 - 0.5)
    assert np.array_equal(advanced.uniforms(0, 3000), want)
    assert np.array_equal(advanced.uniforms(1234, 1500), want[1234:2734])
    got = {(r["channel"], r["n"]): r["x"] for r in advanced.dither(signal(spark, np.zeros((2, 50))), 8).collect()}
    assert all(got[c, n] * 128 == np.round(want[4 * n + 2 * c] + want[4 * n + 2 * c + 1]) for c in (0, 1) for n in range(50))
