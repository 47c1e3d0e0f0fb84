"""Time-stretch and pitch-shift: blocks of any size against a plain loop over all frames, and known answers."""

import numpy as np
import pandas as pd
import pytest

from signalframe import verbs
from signalframe.operators import repair

RATE = 8000


def frame(spark, *signals):
    parts = [pd.DataFrame({"recording": r, "channel": 0, "n": np.arange(len(x)), "x": np.asarray(x, float)}) for r, x in enumerate(signals)]
    return spark.createDataFrame(pd.concat(parts), "recording long, channel int, n long, x double")


def back(df, recording=0):
    pdf = df.toPandas()
    own = pdf[pdf["recording"] == recording].sort_values("n")
    assert own["n"].tolist() == list(range(len(own)))
    return own["x"].to_numpy()


def wrap(p):
    return (p + np.pi) % (2 * np.pi) - np.pi


def plain_stretch(x, factor, size, hop):
    """Frame after frame with phases that add up."""
    spec = repair.stft(x, size, hop)
    out = max(1, int(np.floor(len(x) * factor + 0.5)))
    frames, bins = (size - hop + out - 1) // hop + 1, size // 2 + 1
    expected, phase, got = 2 * np.pi * hop * np.arange(bins) / size, None, np.empty((frames, bins), complex)
    for f in range(frames):
        place = f * (len(spec) - 1) / (frames - 1) if frames > 1 else 0.0
        left = int(place)
        a, b, t = spec[left], spec[min(left + 1, len(spec) - 1)], place - left
        mag = (1 - t) * np.abs(a) + t * np.abs(b)
        if f == 0:
            phase = np.angle(a)
        else:
            phase = phase + expected + wrap(np.angle(b) - np.angle(a) - expected)
            peaks = [k for k in range(1, bins - 1) if mag[k] > mag[k - 1] and mag[k] > mag[k + 1]]
            near, owner = np.angle(a if t < 0.5 else b), np.full(bins, -1)
            if peaks:
                owner[: peaks[0] + 1] = peaks[0]
                for p, q in zip(peaks, peaks[1:]):
                    valley = min(range(p + 1, q), key=lambda k: (mag[k], k))
                    owner[p + 1 : valley + 1], owner[valley + 1 : q + 1] = p, q
                owner[peaks[-1] + 1 :] = peaks[-1]
                phase = np.array([phase[k] if owner[k] == k else phase[owner[k]] + near[k] - near[owner[k]] for k in range(bins)])
        phase = wrap(phase)
        got[f] = mag * np.exp(1j * phase)
    return repair.istft(got, size, hop, out)


@pytest.mark.parametrize("factor", [0.4, 1.0, 1.7, 3.1])
def test_blocks_of_any_size(spark, factor):
    rng = np.random.default_rng(5)
    n = np.arange(6000)
    x = np.sin(2 * np.pi * (300 * n / RATE + 40 * (n / RATE) ** 2)) + 0.3 * np.sin(2 * np.pi * 1100 * n / RATE) + 0.05 * rng.normal(size=len(n))
    signals = [x, rng.normal(size=700), np.zeros(300), [1.0]]
    df = frame(spark, *signals)
    want = [plain_stretch(np.asarray(s, float), factor, 256, 64) for s in signals]
    for frames in (7, 4096):
        got = repair.stretch(df, factor, 256, 64, frames)
        got = spark.createDataFrame(got.toPandas())
        for k, w in enumerate(want):
            y = back(got, k)
            assert len(y) == len(w) and np.abs(y - w).max() < 1e-7


def test_length_and_pitch(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(80_000) / RATE)
    df = frame(spark, x)
    loudest = lambda y: np.fft.rfftfreq(1 << 15, 1 / RATE)[np.abs(np.fft.rfft(y[8000 : 8000 + (1 << 15)] * np.hanning(1 << 15))).argmax()]
    y = back(verbs.stretch(df, RATE, 125.0))
    assert len(y) == 100_000 and loudest(y) == pytest.approx(440, abs=0.3)
    assert np.sqrt((y[5000:-5000] ** 2).mean()) == pytest.approx(np.sqrt(0.5), rel=0.02)
    z = back(verbs.pitch(df, RATE, 7.0))
    assert abs(len(z) - 80_000) <= 1 and loudest(z) == pytest.approx(440 * 2 ** (7 / 12), abs=0.5)
