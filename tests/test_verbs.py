"""The verbs against known answers."""

import math

import numpy as np
import pytest

from signalframe import verbs
from signalframe.operators import edits, filters, repair, room, timeline
from tests.test_signal import RATE, signal


def test_normalise_meets_its_target(spark):
    rng = np.random.default_rng(1)
    s = signal(spark, 0.02 * rng.standard_normal((1, 40_000)))
    got = verbs.analyse(verbs.normalise(spark, s, RATE, "ebu R128"), RATE).first()
    assert got["integratedLufs"] == pytest.approx(-23.0, abs=0.11) and got["truePeakDbtp"] <= -1
    assert list(got.asDict()) == verbs.ANALYSIS
    with pytest.raises(ValueError):
        verbs.normalise(spark, s, RATE, "nowhere")


def test_tempo_of_clicks(spark):
    x = np.zeros(RATE * 20)
    x[:: RATE // 2] = 1.0  # 120 beats a minute
    got = verbs.tempo(signal(spark, x), RATE).first()
    assert got["valid"] and abs(got["bpm"] - 120) < 1


def test_pitch_of_a_period(spark):
    t = np.arange(RATE)
    s = signal(spark, np.sign(np.sin(2 * np.pi * 220.0 * t / RATE)) * 0.5)
    summary, contour = verbs.pitch_of(s, RATE)
    assert abs(summary.first()["medianHz"] - 220) < 1.1 and summary.first()["voicedFraction"] > 0.9
    assert contour.count() == (RATE - 2048) // 256 + 1


def test_deconvolved_sweep_is_an_impulse(spark):
    n = 4000
    tone = np.array([r["x"] for r in verbs.sweep(spark, RATE, 50.0, 3500.0, 0.5, -6.0206).orderBy("n").collect()])
    recorded = np.concatenate([np.zeros(137), 0.5 * tone, np.zeros(1000)])
    got = verbs.deconvolve(signal(spark, recorded), RATE, 50.0, 3500.0, n / RATE, level=10 ** (-6.0206 / 20))
    y = np.array([r["x"] for r in got.orderBy("n").collect()])
    assert np.abs(y).argmax() == 137 and np.abs(y).max() == pytest.approx(0.5, rel=0.02)


def test_room_recovers_a_decay(spark):
    rng = np.random.default_rng(3)
    n, t60 = 8000, 0.4
    x = rng.standard_normal(n) * 10 ** (-3 * np.arange(n) / RATE / t60)
    got = room.room(signal(spark, np.concatenate([np.zeros(200), x])).select("recording", "n", "x"), RATE).first()
    assert got["valid"] and got["direct"] in range(200, 210)
    assert got["t20"] == pytest.approx(t60, rel=0.05) and got["t30"] == pytest.approx(t60, rel=0.05)


def test_hum_is_found_and_goes(spark):
    t = np.arange(2 * RATE)
    rng = np.random.default_rng(4)
    hum = 0.2 * np.cos(2 * np.pi * 50.3 * t / RATE)
    s = signal(spark, hum + 0.01 * rng.standard_normal(len(t)))
    found = repair.hum_search(s, RATE).first()
    assert found["hz"] == pytest.approx(50.3, abs=0.11) and found["prominence"] >= 3
    left = np.array([r["x"] for r in verbs.dehum(s, RATE, 50.3, 1).orderBy("n").collect()])
    assert (left[4000:-4000] ** 2).mean() < 0.02 * (hum**2).mean()


def test_null_of_a_delayed_inverted_copy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(3000)
    got = verbs.null(signal(spark, x), signal(spark, np.concatenate([np.zeros(137), -0.5 * x])), RATE).first()
    assert (got["delaySamples"], got["polarityInverted"], got["verdict"]) == (137, True, "null")
    same = verbs.null(signal(spark, x), signal(spark, x), RATE).first()
    assert same["verdict"] == "identical"


def test_linked_channels_keep_the_image(spark):
    x = np.stack([np.ones(400) * 0.9, np.ones(400) * 0.09])
    got = {(r["channel"], r["n"]): r["x"] for r in verbs.compress(signal(spark, x), RATE).collect()}
    assert all(got[0, n] / got[1, n] == pytest.approx(10) for n in range(0, 400, 37))
    alone = {(r["channel"], r["n"]): r["x"] for r in verbs.compress(signal(spark, x), RATE, link=False).collect()}
    assert alone[0, 399] / alone[1, 399] < 9


def test_offline_limiter_stays_below_its_ceiling(spark):
    t = np.arange(2000)
    s = signal(spark, np.sin(2 * np.pi * 0.4 * t + 0.5))
    got = np.array([r["x"] for r in filters.offline_limit(s, RATE, -3.0).collect()])
    assert np.abs(got).max() <= 10 ** (-3 / 20) + 1e-12 and len(got) == 2000


def test_range_eq_leaves_the_rest(spark):
    x = np.sin(np.arange(9000) * 0.7)
    bands = [{"kind": "peaking", "hz": 900.0, "gain_db": 12.0}]
    got = np.array([r["x"] for r in filters.eq_on_range(signal(spark, x), RATE, 4000, 6000, bands).orderBy("n").collect()])
    assert np.array_equal(got[:4000], x[:4000]) and np.array_equal(got[6000:], x[6000:]) and np.abs(got[4500:5500] - x[4500:5500]).max() > 0.1


def test_bad_options(spark):
    s = signal(spark, np.zeros(10))
    for call in (lambda: verbs.stretch(s, RATE, 5), lambda: verbs.pitch(s, RATE, 40), lambda: verbs.channels(s, RATE, "upside-down"), lambda: verbs.convert(s, RATE, fmt="12"), lambda: verbs.compress(s, RATE, ratio=0.5), lambda: verbs.contour(s, RATE, 0.0), lambda: verbs.run("nothing")):
        with pytest.raises(ValueError):
            call()


def test_swap_takes_stereo_only(spark):
    assert verbs.channels(signal(spark, np.zeros(5)), RATE, "swap").count() == 0
    got = {(r["channel"], r["n"]): r["x"] for r in verbs.channels(signal(spark, [[1, 2], [3, 4]]), RATE, "swap").collect()}
    assert got[0, 0] == 3 and got[1, 1] == 2


def test_delete_keeps_or_clears_fades(spark):
    clips = spark.createDataFrame([(1, 1, 0, 0, 100, 1.0, 10, 10), (2, 1, 0, 150, 100, 1.0, 10, 10)], "clip_id long, source_id long, source_start long, timeline_start long, length long, gain double, fade_in long, fade_out long")
    inside = {r["part"]: r for r in timeline.delete_range(clips.limit(1), 40, 60).collect()}
    assert (inside[0]["fade_out"], inside[1]["fade_in"], inside[0]["fade_in"], inside[1]["fade_out"]) == (0, 0, 10, 10)
    trimmed = timeline.delete_range(clips.limit(1), 5, 200).first()
    assert (trimmed["length"], trimmed["fade_out"]) == (5, 5)


def test_crossfade_trims_the_later_head(spark):
    clips = spark.createDataFrame([(1, 1, 0, 0, 100, 1.0, 0, 0), (2, 1, 0, 150, 100, 1.0, 0, 0)], "clip_id long, source_id long, source_start long, timeline_start long, length long, gain double, fade_in long, fade_out long")
    pairs = spark.createDataFrame([(2, 1, 20)], "first long, second long, cross long")
    got = {r["clip_id"]: r for r in edits.crossfade(clips, pairs).collect()}
    assert (got[2]["timeline_start"], got[2]["source_start"], got[2]["length"], got[2]["fade_in"]) == (80, 70, 30, 20) and got[1]["fade_out"] == 20


assert math
