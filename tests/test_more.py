"""Tempo, sweeps, sessions and reports."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from signalframe import queries
from signalframe.operators import filters, measure, statistics
from signalframe.plans import reports, session


@pytest.mark.parametrize("bpm", [90, 120, 140])
def test_tempo_of_clicks(bpm):
    rate = 8000 / 64
    e = np.zeros(int(20 * rate))
    e[np.round(np.arange(0.5, 19.9, 60 / bpm) * rate).astype(int)] = 1
    got = measure.tempo(e, rate)
    assert got["valid"] and got["bpm"] == pytest.approx(bpm, abs=1)


def test_no_tempo():
    assert not measure.tempo(np.ones(1000), 125.0)["valid"]
    assert not measure.tempo(np.zeros(1000), 125.0)["valid"]


def test_sweep_round_trip(spark):
    x = np.array([r["x"] for r in filters.sweep(spark, 8000.0, 1.0, 50.0, 3500.0).orderBy("n").collect()])
    room = np.zeros(200)
    room[[0, 100]] = 1, 0.5
    played = np.convolve(x, room)
    rows = [(0, 0, n, float(v)) for n, v in enumerate(played)] + [(1, 0, n, float(v)) for n, v in enumerate(x[:10])]
    got = {r["n"]: r["x"] for r in measure.deconvolve(spark.createDataFrame(rows, "recording long, channel int, n long, x double"), x, 8000.0, 50.0, 3500.0).collect()}
    assert got[0] == pytest.approx(1, abs=0.1) and got[100] == pytest.approx(0.5, abs=0.1) and len(got) == len(played)


def test_session_warnings(spark):
    good = '{"format":"signalframe-session","version":1,"sources":[{"id":1,"name":"a","path":"x.wav"}],"clips":[{"id":2,"source":1,"sourceStart":0,"length":5,"timelineStart":0},{"id":3,"source":9,"sourceStart":0,"length":5,"timelineStart":0},{"id":4,"source":1,"length":0,"timelineStart":0}],"markers":[]}'
    rows = [(1, good), (2, '{"format":"signalframe-session","version":2}'), (3, "nonsense")]
    known = spark.createDataFrame([("other.wav",)], "path string")
    got = session.load(spark.createDataFrame(rows, "session_id int, json string"), known)
    assert [r["clip_id"] for r in got["clips"].collect()] == [2]
    assert got["warnings"].count() == 4
    assert got["sources"].first()["missing"]


def test_stored_paths():
    assert session.stored_path("/a/b/c.wav", "/a") == "b/c.wav" and session.stored_path("/x/c.wav", "/a") == "/x/c.wav" and session.stored_path("", "/a") == ""


def test_history(spark):
    one = spark.createDataFrame([(1,)], "v int")
    h = session.commit(spark.createDataFrame([], "v int, version int, label string"), one, "first", 0)
    h = session.commit(h, spark.createDataFrame([(2,)], "v int"), "second", 1)
    assert session.snapshot(h, 1).first()["v"] == 1 and session.snapshot(h, 2).first()["v"] == 2


def test_reports(spark):
    df = spark.createDataFrame([('a "b", c', 1.23456, None)], "file string, integrated double, lra double")
    assert reports.csv_lines(df).first()["line"] == '"a ""b"", c",1.235,'
    assert reports.json_lines(df).first()["json"] == '{"file":"a \\"b\\", c","integrated":1.235,"lra":null}'


def test_bands_add_up_flat():
    from signalframe.operators import advanced

    impulse = np.zeros(20000)
    impulse[0] = 1
    h = np.abs(np.fft.rfft(sum(advanced.split_bands(impulse, 48000, [200.0, 2000.0, 8000.0]))))
    assert 20 * np.log10(h.max() / h.min()) < 1e-5


def test_exact_peak():
    from signalframe.operators import advanced

    x = np.sin(2 * np.pi * 0.25 * np.arange(20000) + np.pi / 4)
    assert advanced.exact_peak(x) == pytest.approx(1, abs=0.02) and advanced.exact_peak(x[:100]) == np.abs(x[:100]).max()


def test_dither_stays_within_two_steps(spark):
    from signalframe.operators import advanced

    x = 0.5 * np.sin(np.arange(500) / 9)
    df = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(x)], "recording long, channel int, n long, x double")
    got = np.array([r["x"] for r in advanced.dither(df, 8).orderBy("n").collect()])
    assert np.abs(got - x).max() <= 1.5 / 128 and np.allclose(got * 128, np.round(got * 128))


def test_line_queries_never_cut_the_recording(spark, monkeypatch):
    from signalframe import queries

    long_signal = lambda s, d: s.range(70_000).selectExpr("id AS n", "sin(id * 0.3D) AS l", "cos(id * 0.3D) AS r")
    monkeypatch.setattr(queries, "_line", long_signal)
    got = queries.QUERIES["m5_exact_true_peak"](spark, "").collect()
    assert {r["recording"] for r in got} == {0} and len(got) == 2


def test_clarity_of_short_and_silent_recordings(spark, tmp_path):
    """A recording that ends before the split has no late energy: its clarity is that of the SQL, and no recording is left out."""
    values = {1: [300.0] * 60, 2: [300.0] * 30, 3: [300.0] * 10, 4: [250.0] * 45, 5: [250.0] * 30 + [300.0] * 5, 6: [250.0] * 45 + [300.0], 7: [None] * 3, 8: [300.0] * 30 + [None] * 20}
    rows = [(100 * u + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), u, v) for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cell = lambda v: "nan" if v is not None and v != v else v
    cols = ["recording", "c50_db", "c80_db", "d50", "centre_time"]
    got = {r[0]: [cell(v) for v in r] for r in queries.QUERIES["a17_clarity"](spark, str(tmp_path)).select(*cols).collect()}
    want = {r[0]: [cell(v) for v in r] for r in con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL['a17_clarity']})").fetchall()}
    assert got == want and got[2][2] == math.inf and got[6][1] == -math.inf


def test_means_are_summed_in_order(spark):
    """Ties in the last written digit hang on the last bit of the sum."""
    x = np.array([1e16, 1.0, -1e16, 1.0, 0.1, 0.2, 0.3] * 3)
    rows = spark.createDataFrame([(r, 0, n, float(x[n])) for n in reversed(range(len(x))) for r in (0, 1)], "recording long, channel int, n long, x double").repartition(3)
    want = 0.0
    for v in x.tolist():
        want += v
    assert want != x[::-1].cumsum()[-1]
    assert [r["dc_offset"] for r in statistics.by_recording(rows).collect()] == [want / len(x)] * 2


def test_ties_are_written_by_their_exact_value(spark):
    df = spark.createDataFrame([(v, 0.0075) for v in (-0.7760725, 0.1234565, 0.0000005, 2.5)], "dcOffset double, seconds double")
    assert [r["line"] for r in reports.csv_lines(df).collect()] == ["%.6f,0.008" % v for v in (-0.7760725, 0.1234565, 0.0000005, 2.5)]


def test_pitch_adds_differences_from_the_last(spark):
    """A frame of steps of 0.1 whose confidence is a tie in the fifth decimal."""
    lows = 0
    for seed in range(400):
        x = (np.random.default_rng(seed).integers(0, 11, 64) / 100 - 0.05) * 10
        d = []
        for k in range(1, 28):
            total = 0.0
            for i in reversed(range(37)):
                total += (x[i] - x[i + k]) ** 2
            d.append(total)
        v = np.array(d) * np.arange(1, 28) / np.cumsum(d)
        if (v < 0.15).any():
            continue
        lows += 1
        assert measure.yin(x, 8000.0, 300.0, 2000.0)[1] == max(0.0, 1 - v.min())
    assert lows > 300
