"""Filter design on the driver; filters in blocks that carry their state, dynamics in blocks with a run-up."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import db
from ..scratch import Scratch
from .blocks import BLOCK, KEYS, SAMPLES, along, cascade, cascades, cells, map_blocks, pack, values

LEAST_SPAN = 1 << 18  # frames of a block with a run-up
KINDS = ("low_pass", "high_pass", "band_pass", "notch", "all_pass", "peaking", "low_shelf", "high_shelf")


def design(kind: str, rate: float, hz: float, q: float = math.sqrt(0.5), gain_db: float = 0.0) -> tuple[float, float, float, float, float]:
    """Normalised (b0, b1, b2, a1, a2) of the eight cookbook responses."""
    if kind not in KINDS:
        raise ValueError(f"unknown filter {kind!r}")
    if not 0 < hz < rate / 2 or q <= 0:
        raise ValueError("the frequency must lie below half the rate and Q above 0")
    w = 2 * math.pi * hz / rate
    c, alpha, a = math.cos(w), math.sin(w) / (2 * q), 10 ** (gain_db / 40)
    root = 2 * math.sqrt(a) * alpha
    plain = (1 + alpha, -2 * c, 1 - alpha)
    b, d = {
        "low_pass": (((1 - c) / 2, 1 - c, (1 - c) / 2), plain), "high_pass": (((1 + c) / 2, -(1 + c), (1 + c) / 2), plain), "band_pass": ((alpha, 0.0, -alpha), plain), "notch": ((1.0, -2 * c, 1.0), plain),
        "all_pass": ((1 - alpha, -2 * c, 1 + alpha), plain), "peaking": ((1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)),
        "low_shelf": ((a * ((a + 1) - (a - 1) * c + root), 2 * a * ((a - 1) - (a + 1) * c), a * ((a + 1) - (a - 1) * c - root)), ((a + 1) + (a - 1) * c + root, -2 * ((a - 1) + (a + 1) * c), (a + 1) + (a - 1) * c - root)),
        "high_shelf": ((a * ((a + 1) + (a - 1) * c + root), -2 * a * ((a - 1) + (a + 1) * c), a * ((a + 1) + (a - 1) * c - root)), ((a + 1) - (a - 1) * c + root, 2 * ((a - 1) - (a + 1) * c), (a + 1) - (a - 1) * c - root)),
    }[kind]
    return tuple(v / d[0] for v in (*b, d[1], d[2]))


def stable(section) -> bool:
    *_, a1, a2 = section
    return abs(a2) < 1 and abs(a1) < 1 + a2


def butterworth(kind: str, rate: float, hz: float, order: int) -> list[tuple]:
    """An even order as a cascade of sections."""
    if order < 2 or order > 32 or order % 2:
        raise ValueError("the order must be even, from 2 to 32")
    return [design(kind, rate, hz, 0.5 / math.cos((2 * k + 1) * math.pi / (2 * order))) for k in range(order // 2)]


def response(spark: SparkSession, sections: dict[str, tuple], rate: float, points: int = 256) -> DataFrame:
    """``name, i, hz, gain_db`` of each section in closed form."""
    coef = spark.createDataFrame([(k, *map(float, v)) for k, v in sections.items()], "name string, b0 double, b1 double, b2 double, a1 double, a2 double")
    w = math.pi * F.col("i") / points
    c1, c2, s1, s2 = F.cos(w), F.cos(2 * w), F.sin(w), F.sin(2 * w)
    up = F.pow(F.col("b0") + F.col("b1") * c1 + F.col("b2") * c2, 2) + F.pow(F.col("b1") * s1 + F.col("b2") * s2, 2)
    down = F.pow(1 + F.col("a1") * c1 + F.col("a2") * c2, 2) + F.pow(F.col("a1") * s1 + F.col("a2") * s2, 2)
    grid = coef.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.select("name", "i", (F.col("i") * rate / 2 / points).alias("hz"), F.when(up > 0, F.greatest(F.lit(-200.0), 10 * F.log10(up / down))).otherwise(-200.0).alias("gain_db"))


def run_up(rate: float, *seconds: float) -> int:
    """Frames before a block after which nothing is left of what came before them: 30 of the slowest time constant, 0.2 s at least."""
    return int(math.ceil(rate * max(0.2, 30 * max(seconds))))


def _with_run_up(samples: DataFrame, rate: float, times: tuple[float, ...], fn, after: int = 0) -> DataFrame:
    """``fn`` of each block with its run-up; only the block's own samples stay."""
    before = run_up(rate, *times)
    return map_blocks(pack(samples, max(LEAST_SPAN, 4 * before), before, after), lambda xs, lo, hi, start: fn(xs)[lo:hi])


def _per_channel(samples: DataFrame, fn, extra: str = "") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"recording": pdf["recording"], "channel": pdf["channel"], "n": pdf["n"], "x": fn(pdf["x"].to_numpy(np.float64))})

    return samples.select("recording", "channel", "n", "x").groupBy("recording", "channel").applyInPandas(run, "recording long, channel int, n long, x double")


def apply_sections(samples: DataFrame, sections: list[tuple]) -> DataFrame:
    """A cascade over each recording and channel, in blocks that carry its state."""
    return cascade(samples, sections)


def parametric_eq(samples: DataFrame, rate: float, bands: list[dict]) -> DataFrame:
    """Up to 16 bands; a disabled band passes everything."""
    if len(bands) > 16:
        raise ValueError("at most 16 bands")
    on = [design(b["kind"], rate, b["hz"], b.get("q", math.sqrt(0.5)), b.get("gain_db", 0.0)) for b in bands if b.get("enabled", True)]
    return apply_sections(samples, on)


def band_pass(rate: float, low: float, high: float, order: int = 6) -> list[tuple]:
    """A Butterworth band-pass between two edges: the analogue low-pass of half the order, turned into a band-pass at pre-warped edges, pole by pole into sections."""
    if order < 2 or order % 2 or order > 32:
        raise ValueError("the order is even and lies between 2 and 32")
    n = order // 2
    a, b = math.tan(math.pi * low / rate), math.tan(math.pi * high / rate)
    width, middle = b - a, a * b

    def section(linear: float, constant: float) -> tuple:
        """Of width * s / (s^2 + linear * s + constant) by the bilinear transform."""
        whole = 1 + linear + constant
        return tuple(float(v) for v in (width / whole, 0.0, -width / whole, 2 * (constant - 1) / whole, (1 - linear + constant) / whole))

    poles = np.exp(1j * np.pi * (2 * np.arange(n // 2) + n + 1) / (2 * n)) * width / 2
    split = np.sqrt(poles * poles - middle)
    found = [section(-2 * r.real, abs(r) ** 2) for p, s in zip(poles, split) for r in (p + s, p - s)]
    return found + [section(width, middle)] * (n % 2)


def band_layout(rate: float, thirds: bool = False, order: int = 6, lowest: float = 20.0, highest: float = 20000.0) -> list[dict]:
    """``band, centre, low, high, sections, reason`` of octaves or third-octaves of base ten; a band has either sections or a reason for having none."""
    step, half, near = (0.1, 1 / 6, 1.02) if thirds else (0.3, 0.5, 1.02)  # a nominal name may be 2 % off its centre
    out = []
    for k in range(math.ceil(math.log10(lowest / near / 1000) / step), math.floor(math.log10(highest * near / 1000) / step) + 1):
        centre = 1000 * 10 ** (step * k)
        band = {"band": k, "centre": centre, "low": centre * 2**-half, "high": centre * 2**half, "sections": None, "reason": None}
        if band["high"] >= rate / 2:
            band["reason"] = "above Nyquist"
        else:
            sections = band_pass(rate, band["low"], band["high"], order)
            if all(abs(a2) < 1 and abs(a1) < 1 + a2 for *_, a1, a2 in sections):
                band["sections"] = sections
            else:
                band["reason"] = "unstable"
        out.append(band)
    return out


def filter_bank(samples: DataFrame, rate: float, order: int = 6, thirds: bool = False) -> DataFrame:
    """Level of each band: ``recording, channel, centre, low, high, level_db, reason``; a band that can't be made has no level and a reason."""
    layout = band_layout(rate, thirds, order)
    made = [b for b in layout if b["sections"]]
    sums = cascades(samples, [b["sections"] for b in made], lambda start, ys: {"band": pa.array([b["band"] for b in made], pa.int32()), "sq": pa.array([float((y**2).sum()) for y in ys]), "frames": pa.array([len(y) for y in ys])}, "recording long, channel int, band int, sq double, frames long")
    levels = sums.groupBy("recording", "channel", "band").agg(db(F.sqrt(F.sum("sq") / F.sum("frames"))).alias("level_db"))
    rows = samples.sparkSession.createDataFrame([(b["band"], b["centre"], b["low"], b["high"], b["reason"]) for b in layout], "band int, centre double, low double, high double, reason string")
    heard = samples.select(F.col("recording").cast("long").alias("recording"), F.col("channel").cast("int").alias("channel")).distinct()
    return heard.join(F.broadcast(rows)).join(levels, ["recording", "channel", "band"], "left").select("recording", "channel", "centre", "low", "high", "level_db", "reason")  # 31 bands


def split_bank(samples: DataFrame, rate: float, thirds: bool = False, order: int = 6) -> DataFrame:
    """``recording, channel, band, n, x``: every band that can be made, in one pass."""
    made = [b for b in band_layout(rate, thirds, order) if b["sections"]]

    def rows(start: int, ys: list[np.ndarray]) -> dict:
        n = len(ys[0])
        return {"band": pa.array(np.repeat([b["band"] for b in made], n), pa.int32()), "n": pa.array(np.tile(np.arange(start, start + n), len(made))), "x": pa.array(np.concatenate(ys))}

    return cascades(samples, [b["sections"] for b in made], rows, "recording long, channel int, band int, n long, x double")


def _coefficient(seconds: float, rate: float) -> float:
    return math.exp(-1 / (seconds * rate)) if seconds > 0 else 0.0


def follow(levels: np.ndarray, attack: float, release: float, rate: float) -> np.ndarray:
    """One-pole smoothing that rises by the attack and falls by the release."""
    a, r, s, out = _coefficient(attack, rate), _coefficient(release, rate), 0.0, np.empty(len(levels))
    for i, v in enumerate(levels.tolist()):
        s = v + (a if v > s else r) * (s - v)
        if abs(s) < 1e-25:
            s = 0.0
        out[i] = s
    return out


def envelope(samples: DataFrame, rate: float, attack: float = 0.01, release: float = 0.1, rms: bool = False) -> DataFrame:
    """Envelope of magnitudes, or the root of that of squares."""
    level = (lambda x: np.sqrt(follow(x * x, attack, release, rate))) if rms else (lambda x: follow(np.abs(x), attack, release, rate))
    return _with_run_up(samples, rate, (attack, release), level)


def most_reduction(before: DataFrame, after: DataFrame, least: float = 1e-20) -> DataFrame:
    """``recording, channel, most_db``: the deepest cut between two signals, over samples that are not as good as silent."""
    keys = ["recording", "channel", "n"]
    j = before.filter(F.abs("x") >= least).select(*keys, "x").join(after.select(*keys, F.col("x").alias("y")), keys)
    cut = F.when(F.col("y") != 0, -20 * F.log10(F.abs(F.col("y") / F.col("x"))))
    return j.groupBy("recording", "channel").agg(F.max(cut).alias("most_db"))


def linked(samples: DataFrame, amount: float = 1.0, combine: str = "max") -> DataFrame:
    """``samples`` with ``level``: each channel's magnitude, drawn towards the largest (or mean) of its frame by ``amount``."""
    if not 0 <= amount <= 1 or combine not in ("max", "mean"):
        raise ValueError("the amount lies between 0 and 1; channels combine by max or mean")
    both = samples.groupBy("recording", "n").agg((F.max if combine == "max" else F.avg)(F.abs("x")).alias("both"))
    own = F.abs("x")
    return samples.join(both, ["recording", "n"]).withColumn("level", own + amount * (F.col("both") - own)).drop("both")


def linked_compress(samples: DataFrame, rate: float, threshold: float = -20.0, ratio: float = 4.0, attack: float = 0.01, release: float = 0.1, knee: float = 6.0, makeup: float = 0.0, amount: float = 1.0, combine: str = "max") -> DataFrame:
    """A compressor whose channels hear each other, so that the image stays where it is: the reduction follows the linked level."""
    keys = ["recording", "channel", "n"]
    levels = linked(samples, amount, combine)
    cut = _with_run_up(levels.select(*keys, F.col("level").alias("x")), rate, (attack, release), lambda v: follow(compression_curve(_db(v), threshold, ratio, knee), attack, release, rate))
    return samples.join(cut.withColumnRenamed("x", "cut"), keys).select(*keys, (F.col("x") * F.pow(F.lit(10.0), (makeup - F.col("cut")) / 20)).alias("x"))


def on_range(samples: DataFrame, start: int, stop: int, process, run_up_frames: int | None = None, blend: int = 0) -> DataFrame:
    """``process`` applied to [start, stop) of each recording: it hears the run-up before, and at both ends its output is blended in over ``blend`` frames."""
    keys = ["recording", "channel", "n"]
    before = start if run_up_frames is None else min(start, run_up_frames)
    base = samples.select("recording", F.col("channel").cast("int").alias("channel"), "n", "x")
    near = base.filter((F.col("n") >= start - before) & (F.col("n") < stop))
    ends = near.groupBy("recording", "channel").agg((F.max("n") + 1).alias("end"))
    shifted = near.withColumn("n", F.col("n") - (start - before))
    done = process(shifted).select("recording", "channel", (F.col("n") + (start - before)).alias("n"), F.col("x").alias("y"))
    j = base.join(done.filter(F.col("n") >= start), keys, "left").join(ends, ["recording", "channel"], "left")
    w = F.least(F.lit(1.0), (F.col("n") - start + 1) / (blend + 1.0), (F.col("end") - F.col("n")) / (blend + 1.0)) if blend else F.lit(1.0)
    return j.select(*keys, F.when(F.col("y").isNotNull(), F.col("x") * (1 - w) + F.col("y") * w).otherwise(F.col("x")).alias("x"))


def offline_limit(samples: DataFrame, rate: float, ceiling: float = -1.0, factor: int = 4, ahead: float = 0.005, release: float = 0.1) -> DataFrame:
    """Limit between the samples too: raise the rate, limit, lower it again and clamp to the ceiling."""
    up = resample(samples, rate, rate * factor)
    down = resample(limit(up, rate * factor, ceiling, ahead, release), rate * factor, rate)
    top = 10 ** (ceiling / 20)
    keys = ["recording", "channel", "n"]
    base = samples.select("recording", F.col("channel").cast("int").alias("channel"), "n")
    return base.join(down, keys, "left").select(*keys, F.greatest(F.lit(-top), F.least(F.lit(top), F.coalesce("x", F.lit(0.0)))).alias("x"))


def eq_on_range(samples: DataFrame, rate: float, start: int, stop: int, bands: list[dict], blend: int = 64) -> DataFrame:
    """An equaliser on a range: a run-up of a quarter second or twenty periods of its lowest band, and blended edges."""
    lowest = min((b["hz"] for b in bands if b.get("enabled", True)), default=rate)
    return on_range(samples, start, stop, lambda part: parametric_eq(part, rate, bands), int(rate * max(0.25, 20 / lowest)), blend)


def _db(x: np.ndarray) -> np.ndarray:
    return np.where(x > 1e-10, 20 * np.log10(np.maximum(x, 1e-10)), -200.0)


def compression_curve(level: np.ndarray, threshold: float, ratio: float, knee: float = 6.0) -> np.ndarray:
    """Reduction in dB (positive) of the static curve with a soft knee."""
    over, slope = level - threshold, 1 - 1 / ratio
    inside = np.abs(over) * 2 <= knee
    bent = slope * (over + knee / 2) ** 2 / (2 * knee) if knee > 0 else np.zeros_like(over)
    return np.where(inside & (knee > 0), bent, np.where(over > 0, slope * over, 0.0))


def compress(samples: DataFrame, rate: float, threshold: float = -20.0, ratio: float = 4.0, attack: float = 0.01, release: float = 0.1, knee: float = 6.0, makeup: float = 0.0) -> DataFrame:
    def run(x):
        reduction = follow(compression_curve(_db(np.abs(x)), threshold, ratio, knee), attack, release, rate)
        return x * 10 ** ((makeup - reduction) / 20)

    return _with_run_up(samples, rate, (attack, release), run)


def expand(samples: DataFrame, rate: float, threshold: float = -40.0, ratio: float = 2.0, attack: float = 0.001, release: float = 0.1, knee: float = 6.0) -> DataFrame:
    """Downward expansion below the threshold; the detector holds peaks with a release of 10 ms."""

    def run(x):
        under = threshold - _db(follow(np.abs(x), 0.0, 0.01, rate))
        slope = ratio - 1
        bent = slope * (under + knee / 2) ** 2 / (2 * knee) if knee > 0 else np.zeros_like(under)
        cut = np.where((np.abs(under) * 2 <= knee) & (knee > 0), bent, np.where(under > 0, slope * under, 0.0))
        return x * 10 ** (-follow(cut, attack, release, rate) / 20)

    return _with_run_up(samples, rate, (0.01, attack, release), run)


def held_peaks(v: np.ndarray, keep: float, lane: int = 256) -> np.ndarray:
    """Magnitudes that rise at once and fall towards the signal by ``keep`` a sample: s = max(v, (1 - keep) v + keep s).

    Such steps compose to steps of the same form, so lanes run side by side twice: for what they make of any state, and from their true states.  A short signal
    goes step by step, which takes less than its lanes would."""
    if len(v) <= 64 * lane:
        now, rest, out = 0.0, 1 - keep, []
        for x in v.tolist():
            now = max(x, rest * x + keep * now)
            out.append(now)
        return np.array(out)
    m = -(-len(v) // lane)
    cols = np.zeros(m * lane)
    cols[: len(v)] = v
    cols = cols.reshape(m, lane).T
    top, add, gain = np.full(m, -np.inf), np.zeros(m), np.ones(m)
    for x in cols:
        top, add, gain = np.maximum(x, (1 - keep) * x + keep * top), (1 - keep) * x + keep * add, gain * keep
    now, states = 0.0, np.empty(m)
    for i, (a, b, c) in enumerate(zip(top.tolist(), add.tolist(), gain.tolist())):
        states[i] = now
        now = max(a, b + c * now)
    out = np.empty_like(cols)
    for t, x in enumerate(cols):
        states = np.maximum(x, (1 - keep) * x + keep * states)
        out[t] = states
    return out.T.ravel()[: len(v)]


def _left_open(hot: np.ndarray, cold: np.ndarray, hold: int, left: int) -> np.ndarray:
    """After each sample, for how many quiet ones more a gate stays open (-1: closed), if it stood at ``left`` before the first."""
    quiet, last = np.cumsum(cold), np.where(hot, np.arange(len(hot)), -1)
    last = np.maximum.accumulate(last)
    since = quiet - np.where(last >= 0, quiet[np.maximum(last, 0)], 0)
    return np.maximum(-1, np.where(last >= 0, hold, left) - since)


def _glide(open_: np.ndarray, depth: float, attack: float, release: float, state: float) -> np.ndarray:
    """Gains in dB that glide to 0 while open and to ``depth`` while closed: run by run in closed form."""
    edges = [0, *(np.flatnonzero(open_[1:] != open_[:-1]) + 1).tolist(), len(open_)]
    out = np.empty(len(open_))
    for a, b in zip(edges, edges[1:]):
        target, keep = (0.0, attack) if open_[a] else (depth, release)
        out[a:b] = target + (state - target) * keep ** np.arange(1, b - a + 1)
        state = out[b - 1]
    return out


def gate(
    samples: DataFrame, rate: float, threshold: float = -50.0, hysteresis: float = 6.0, hold: float = 0.01, depth: float = -80.0, attack: float = 0.001, release: float = 0.1, detector: float = 0.01, size: int = BLOCK
) -> DataFrame:
    """Opens where the detected level is strictly above the threshold, and closes when it has been below threshold less hysteresis for longer than ``hold``; it starts closed.

    A gate has no finite memory, but a block does to it one of two things: it leaves it in a state of its own (if it opens it anywhere) or it uses up so much of the hold.
    These compose, so blocks take their entry states from a scan of two numbers each; the gains that glide behind go by a scan of their own.  Only the
    detector has a run-up (30 of its time constants)."""
    keep, a, r, held = _coefficient(detector, rate), _coefficient(attack, rate), _coefficient(release, rate), int(hold * rate + 0.5)
    before = run_up(rate, detector)
    packed = Scratch(samples.sparkSession, "gate").keep(pack(samples, size, before), "packed")  # read three times
    keys = "recording long, channel int, block long"

    def flags(xs, lo, hi):
        level = _db(held_peaks(np.abs(xs), keep)[lo:hi])
        return level > threshold, level < threshold - hysteresis

    def summed(make, schema):
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for batch in batches:
                more = [n for n in ("left",) if n in batch.schema.names]
                out = [(rec, c, b, *make(*flags(xs, lo, hi), *given)) for xs, (rec, c, b, lo, hi, *given) in zip(values(batch), cells(batch, *KEYS, "lo", "hi", *more))]
                if out:
                    rec, c, b, *made = zip(*out)
                    yield pa.RecordBatch.from_pydict({"recording": list(rec), "channel": pa.array(c, pa.int32()), "block": list(b), **dict(zip(names, map(list, made)))})

        return lambda df: df.mapInArrow(run, f"{keys}, {schema}")

    def told(hot, cold):
        return bool(hot.any()), int(_left_open(hot, cold, held, held)[-1] if hot.any() else cold.sum())

    lefts = along(summed(told, "fixed boolean, value long")(packed), ["fixed", "value"], lambda: -1, lambda left, fixed, value: value if fixed else max(-1, left - value), "left long")
    opened = Scratch(samples.sparkSession, "gate").keep(packed.join(lefts, KEYS), "opened")

    def glides(hot, cold, left):
        open_ = _left_open(hot, cold, held, left) >= 0
        ends = [float(_glide(open_, depth, a, r, s)[-1]) for s in (0.0, 1.0)]  # an affine map of the state
        return ends[0], ends[1] - ends[0]

    begun = along(summed(glides, "add double, gain double")(opened), ["add", "gain"], lambda: float(depth), lambda state, add, gain: add + gain * state, "state double")

    def run(xs, lo, hi, start, left, state):
        hot, cold = flags(xs, lo, hi)
        return xs[lo:hi] * 10 ** (_glide(_left_open(hot, cold, held, left) >= 0, depth, a, r, state) / 20)

    return map_blocks(opened.join(begun, KEYS), run, None, "left", "state")


DETECTOR_TAPS, DETECTOR_BETA = 33, 5.0  # fixed values


def detected(x: np.ndarray, oversampling: int) -> np.ndarray:
    """At each sample the largest magnitude of the waveform between its neighbours, never less than its own."""
    half = DETECTOR_TAPS // 2
    phases = interpolator(oversampling, DETECTOR_TAPS, lambda u: kaiser(u, DETECTOR_BETA))
    return np.maximum(between(np.concatenate([x, np.zeros(half)]), phases)[half:], np.abs(x))


def detect_true_peak(samples: DataFrame, oversampling: int = 4) -> DataFrame:
    """``recording, channel, n, x``: the true-peak level at each sample, for a side chain; a meter's reading is ``true_peak``."""
    if not 2 <= oversampling <= 16:
        raise ValueError("oversampling lies between 2 and 16")
    return map_blocks(pack(samples, BLOCK, DETECTOR_TAPS, DETECTOR_TAPS), lambda xs, lo, hi, start: detected(xs, oversampling)[lo:hi])


def limit(samples: DataFrame, rate: float, ceiling: float = -1.0, ahead: float = 0.005, release: float = 0.1, true_peak: bool = False, oversampling: int = 8) -> DataFrame:
    """Look-ahead limiter: the window's largest need, smoothed; never above the ceiling, with ``true_peak`` between the samples either (as far as the detector sees)."""
    if not 2 <= oversampling <= 16:
        raise ValueError("oversampling lies between 2 and 16")
    n, top = max(1, int(ahead * rate)), 10 ** (ceiling / 20)

    def run(x):
        level = detected(x, oversampling) if true_peak else np.abs(x)
        need = np.maximum(0.0, _db(level) - ceiling)
        padded = np.concatenate([need, np.zeros(n)])
        most = np.lib.stride_tricks.sliding_window_view(padded, n + 1).max(1)
        gain = 10 ** (-follow(most, 0.2 * ahead, release, rate) / 20)
        return x * np.minimum(gain, top / np.maximum(level, 1e-30))

    return _with_run_up(samples, rate, (0.2 * ahead, release), run, after=n + DETECTOR_TAPS * true_peak)


#: Fixed values of the two kernels: half width, steps of the sum that scales it, beta, and cut-off as a share of the lower rate.
QUALITIES = {"fast": (24, 256, 9.0, 0.44), "best": (64, 1024, 14.0, 0.465)}


def kaiser(u: np.ndarray, beta: float) -> np.ndarray:
    return np.where(np.abs(u) <= 1, np.i0(beta * np.sqrt(np.maximum(0, 1 - np.square(u)))) / np.i0(beta), 0.0)


def sinc_kernel(quality: str) -> tuple[int, Callable]:
    """Half width and values of a low-pass kernel of unit area, at places in samples of the lower rate."""
    if quality not in QUALITIES:
        raise ValueError(f"qualities are {' and '.join(QUALITIES)}")
    half, steps, beta, cutoff = QUALITIES[quality]
    shape = lambda t: 2 * cutoff * np.sinc(2 * cutoff * t) * kaiser(t / half, beta)
    area = (2 * shape(np.arange(half * steps + 1) / steps).sum() - shape(np.zeros(1))[0]) / steps
    return half, lambda t: np.where(np.abs(t) < half - 1e-9, shape(t) / area, 0.0)


@lru_cache(maxsize=4)
def kernel_table(quality: str, stretch: float) -> tuple[np.ndarray, np.ndarray]:
    """Taps around a place, and the kernel's values at them for parts of a sample: row q + 1 for q / (rows - 4), so that a cubic through four rows gives any part to about 1e-15.

    Beyond its ends the kernel is carried on smoothly; who reads it cuts it off."""
    half, steps, beta, cutoff = QUALITIES[quality]
    _, kernel = sinc_kernel(quality)
    scale = float(kernel(np.zeros(1))[0]) / (2 * cutoff)
    grid, wide = max(32, math.ceil(4096 / stretch)), int(half * stretch) + 1
    taps = np.arange(-wide, wide + 1)
    t = (taps - (np.arange(-1, grid + 3) / grid)[:, None]) / stretch
    z = 1 - np.square(t / half)
    bessel = term = np.ones_like(z)
    for k in range(1, 60):
        term = term * z * (beta / 2 / k) ** 2
        bessel = bessel + term
    return taps, scale * 2 * cutoff * np.sinc(2 * cutoff * t) * bessel / np.i0(beta)


def resample(samples: DataFrame, from_rate: float, to_rate: float, quality: str = "best") -> DataFrame:
    """Windowed-sinc resampling: output k reads at k * from / to; a wider kernel when the rate falls, and the same samples when it stays."""
    half, _ = sinc_kernel(quality)
    ratio = from_rate / to_rate
    if not 1 / 128 <= ratio <= 128:
        raise ValueError("the ratio of the rates lies between 1 / 128 and 128")
    if ratio == 1:
        return samples.select("recording", F.col("channel").cast("int").alias("channel"), "n", "x")
    stretch = max(1.0, ratio)
    reach = half * stretch

    def run(xs, lo, hi, start):
        """The output places that read within the block's own samples."""
        taps, table = kernel_table(quality, stretch)
        grid, wide = len(table) - 4, int(reach) + 1
        first, last = math.ceil((start + lo) / ratio - 1e-9), math.ceil((start + hi) / ratio - 1e-9)
        k = np.arange(first, last)
        out = np.zeros(len(k))
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(wide + 1), xs, np.zeros(wide + 2)]), len(taps))
        ends = np.flatnonzero(np.abs(taps) > reach - 2)
        for a in range(0, len(k), 4096):
            p = k[a : a + 4096] * from_rate / to_rate - start
            at = np.floor(p).astype(int)
            part = p - at
            heard = windows[np.clip(at + 1, 0, len(windows) - 1)]
            heard[:, ends] *= np.abs((taps[ends] - part[:, None]) / stretch) < half - 1e-9  # the kernel ends in a step, which no line crosses
            q = np.floor(part * grid).astype(int)
            u = part * grid - q
            near = (-u * (u - 1) * (u - 2) / 6, (u + 1) * (u - 1) * (u - 2) / 2, -(u + 1) * u * (u - 2) / 2, (u + 1) * u * (u - 1) / 6)
            out[a : a + 4096] = sum(c * np.einsum("ij,ij->i", table[q + i], heard) for i, c in enumerate(near)) / stretch
        return {"n": pa.array(k), "x": pa.array(out)}

    return map_blocks(pack(samples, BLOCK, int(reach) + 2, int(reach) + 2), run, SAMPLES)


def interpolator(factor: int, taps: int, window: Callable) -> np.ndarray:
    """Phases of a sinc interpolator whose centre lies on a sample: phase 0 gives the samples, phase p what lies p / factor further; each has unit gain.

    ``window`` takes places from -1 to 1."""
    half = (taps - 1) / 2
    at = np.arange(factor)[:, None] / factor + np.arange(taps) - half
    kernel = np.where(at <= half, np.sinc(at) * window(np.clip(at / half, -1, 1)), 0.0)
    return kernel / kernel.sum(1, keepdims=True)


def blackman_harris(u: np.ndarray) -> np.ndarray:
    a = np.pi * (u + 1)
    return 0.35875 - 0.48829 * np.cos(a) + 0.14128 * np.cos(2 * a) - 0.01168 * np.cos(3 * a)


def between(xs: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """At each sample the largest magnitude of all phases whose kernels end there."""
    out = np.zeros(len(xs))
    for p in phases:
        np.maximum(out, np.abs(np.convolve(xs, p)[: len(xs)]), out=out)
    return out


def _peaks(samples: DataFrame, size: int, factor: int, taps: int) -> DataFrame:
    """``recording, channel, sub, true_peak`` of every ``size`` samples: the samples themselves and what the interpolator has given by their end."""
    phases = interpolator(factor, taps, blackman_harris)

    def run(xs, lo, hi, start):
        top = np.maximum(between(xs, phases), np.abs(xs))[lo:hi]
        first = (start + lo) // size
        edges = np.arange(first, (start + hi - 1) // size + 1) * size - (start + lo)
        return {"sub": pa.array(first + np.arange(len(edges))), "true_peak": pa.array(np.maximum.reduceat(top, np.maximum(edges, 0)))}

    block = max(1, BLOCK // size) * size
    return map_blocks(pack(samples, block, taps, 0), run, "recording long, channel int, sub long, true_peak double")


def sub_peaks(samples: DataFrame, size: int, factor: int = 4, taps: int = 25) -> DataFrame:
    """``recording, sub, true_peak``: the largest of all channels in each run of ``size`` samples."""
    return _peaks(samples, size, factor, taps).groupBy("recording", "sub").agg(F.max("true_peak").alias("true_peak"))


def true_peak(samples: DataFrame, factor: int = 4, taps: int = 25) -> DataFrame:
    """Largest magnitude of each channel between and at the samples."""
    return _peaks(samples, BLOCK, factor, taps).groupBy("recording", "channel").agg(F.max("true_peak").alias("true_peak"))


def sweep(spark: SparkSession, rate: float, seconds: float = 5.0, start: float = 20.0, end: float = 20000.0, level: float = 0.5, fade: float = 0.02) -> DataFrame:
    """An exponential sine sweep with raised-cosine fades: ``n, x``."""
    end = min(end, 0.99 * rate / 2)
    frames, edge = int(seconds * rate), max(1, int(fade * rate))
    k = math.log(end / start)
    n = F.col("id")
    x = level * F.sin(2 * math.pi * start * seconds / k * (F.exp(n / rate / seconds * k) - 1))
    near = F.least(n, F.lit(frames - 1) - n)
    return spark.range(frames).select(n.alias("n"), (x * F.when(near < edge, 0.5 - 0.5 * F.cos(math.pi * near / edge)).otherwise(1.0)).alias("x"))
