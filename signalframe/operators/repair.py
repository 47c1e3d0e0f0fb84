"""Short-time spectrum edits and repair in blocks with halos; time-stretching scans the phases of blocks.

Blocks begin at multiples of the hop, so that the frames of a block lie where those of the whole recording do, and halos
hold all that a frame or a smoother looks back to.  What is asked of the whole recording (a noise profile, the peak) is
aggregated first and joined to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .blocks import SAMPLES, Gathered, along, beside, bundle, cells, map_blocks, pack, sample_rows, values

SIZE, HOP = 1024, 256
SPAN = 1 << 16


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames with size - hop zeros in front; Hann window."""
    pad = size - hop
    frames = (pad + len(x) - 1) // hop + 1
    padded = np.concatenate([np.zeros(pad), x, np.zeros(frames * hop + size)])
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:frames] * hann(size), axis=1)


def istft(spec: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """Window again, overlap-add, divide by the windows' squares."""
    w = hann(size)
    out, norm = np.zeros(len(spec) * hop + size), np.zeros(len(spec) * hop + size)
    for i, f in enumerate(np.fft.irfft(spec, size, axis=1)):
        out[i * hop : i * hop + size] += f * w
        norm[i * hop : i * hop + size] += w * w
    pad = size - hop
    return (out / np.maximum(norm, 1e-12))[pad : pad + length]


def edit_frames(samples: DataFrame, edit, size: int = SIZE, hop: int = HOP, look_back: int = 0, side: DataFrame | None = None, name: str = "") -> DataFrame:
    """The STFT of each block through ``edit(spec, frame[, side])``; ``frame`` is the first frame's number in the whole recording.

    ``look_back`` frames before a block are computed too; ``side(recording, channel, name)`` comes to each block as an array."""
    halo = size + hop
    packed = pack(samples, SPAN // hop * hop, -(-(halo + look_back * hop) // hop) * hop, halo)
    if side is not None:
        packed = beside(packed, side, ["recording", "channel"], "left")

    def run(xs, lo, hi, start, *more):
        return istft(edit(stft(xs, size, hop), start // hop, *more), size, hop, len(xs))[lo:hi]

    return map_blocks(packed, run, None, *([name] if side is not None else []))


def noise_profile(samples: DataFrame, noise_from: int, noise_to: int, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """``recording, channel, noise``: mean magnitudes of a passage that the user has marked."""
    part = samples.filter((F.col("n") >= noise_from) & (F.col("n") < noise_to)).withColumn("n", F.col("n") - noise_from)

    def run(xs, lo, hi, start):
        mags = np.abs(stft(xs, size, hop))
        first = 0 if start + lo == 0 else (lo + size - hop) // hop
        last = len(mags) if hi == len(xs) else (hi + size - hop) // hop
        return {"bin": pa.array(np.arange(mags.shape[1])), "total": pa.array(mags[first:last].sum(0)), "frames": pa.array(np.full(mags.shape[1], last - first))}

    by = map_blocks(pack(part, SPAN // hop * hop, -(-size // hop) * hop, size), run, "recording long, channel int, bin long, total double, frames long")
    by = by.groupBy("recording", "channel", "bin").agg((F.sum("total") / F.sum("frames")).alias("m"))
    return by.groupBy("recording", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "m"))), lambda v: v["m"]).alias("noise"))


def smoothed(gain: np.ndarray, keep: float = 0.55) -> np.ndarray:
    """Moving mean over three bins (edges shortened), then exponential smoothing over frames from 1."""
    wide = np.ones(3)
    gain = np.apply_along_axis(lambda g: np.convolve(g, wide, "same") / np.convolve(np.ones_like(g), wide, "same"), 1, gain)
    last = np.ones(gain.shape[1])
    for i in range(len(gain)):
        last = gain[i] = keep * last + (1 - keep) * gain[i]
    return gain


def denoise(samples: DataFrame, noise_from: int, noise_to: int, amount_db: float = 12.0, size: int = SIZE, hop: int = HOP, over: float = 1.5) -> DataFrame:
    """Spectral subtraction by the mean magnitudes of a noise passage, smoothed over bins and frames."""
    if noise_to - noise_from < 2 * size:
        raise ValueError("a noise profile needs two windows")

    def edit(spec, frame, noise):
        p, n = np.abs(spec) ** 2, (np.asarray(noise) * over) ** 2
        s = np.maximum(0, p - n)
        gain = smoothed(np.where(s + n > 0, s / np.where(s + n > 0, s + n, 1), 1.0))
        return spec * np.maximum(gain, 10 ** (-amount_db / 20))

    return edit_frames(samples, edit, size, hop, 64, noise_profile(samples, noise_from, noise_to, size, hop), "noise")


def feather(at: np.ndarray, low: float, high: float, edge: float) -> np.ndarray:
    """1 inside [low, high], a raised cosine over ``edge`` outside."""
    away = np.maximum(np.maximum(low - at, at - high), 0)
    return np.where(away <= 0, 1.0, np.where(away < edge, 0.5 + 0.5 * np.cos(np.pi * away / edge), 0.0)) if edge > 0 else (away <= 0).astype(float)


def attenuate(samples: DataFrame, rate: float, t0: float, t1: float, f0: float, f1: float, gain_db: float, size: int = SIZE, hop: int = HOP, bins: float = 3.0, frames: float = 1.0) -> DataFrame:
    """Scale a time-frequency region under a raised-cosine mask (three bins and a hop wide by default)."""
    f = np.arange(size // 2 + 1) * rate / size
    across = feather(f, f0, f1, bins * rate / size)

    def edit(spec, frame):
        t = ((frame + np.arange(len(spec))) * hop - (size - hop) + size / 2) / rate
        mask = feather(t, t0, t1, frames * hop / rate)[:, None] * across[None, :]
        return spec * (1 + mask * (10 ** (gain_db / 20) - 1))

    return edit_frames(samples, edit, size, hop)


def dereverb(samples: DataFrame, rate: float, removal: float = 1.0, decay: float = 0.8, floor_db: float = -20.0, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """Subtract a delayed, decayed estimate of late energy in each bin; gains are smoothed over bins and frames."""
    delay = max(size // hop, int(0.05 * rate / hop))

    def edit(spec, frame):
        p = np.abs(spec) ** 2
        late = np.zeros_like(p)
        late[delay:] = 10 ** (-6 * delay * hop / rate / decay) * removal * p[:-delay] if len(p) > delay else 0
        gain = smoothed(np.sqrt(np.maximum(0, p - late) / np.maximum(p, 1e-30)))
        return spec * np.maximum(gain, 10 ** (floor_db / 20))

    return edit_frames(samples, edit, size, hop, delay + 64)


def fit_prediction(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction by Levinson-Durbin on the windowed autocorrelation with a small ridge."""
    y = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / max(len(x), 1)))
    r = np.array([float(y[: len(y) - k] @ y[k:]) for k in range(order + 1)])
    r[0] *= 1 + 1e-6
    a, e = np.zeros(order), r[0]
    for k in range(order):
        if e <= 0:
            break
        c = (r[k + 1] - a[:k] @ r[k:0:-1][:k]) / e
        if abs(c) >= 1:
            break
        a[:k], a[k] = a[:k] - c * a[:k][::-1], c
        e *= 1 - c * c
    return a


def interpolate(x: np.ndarray, missing: np.ndarray, order: int, trusted: bool = False) -> np.ndarray:
    """Fill the missing samples so that the prediction error is least; ``trusted``: what stands there serves for the fit.

    The normal equations hold the autocorrelation of the error filter at the gaps' distances: no matrix over the signal."""
    a = np.concatenate([[1.0], -fit_prediction(x if trusted else np.where(missing, 0, x), order)])
    gaps = np.flatnonzero(missing)
    n, known = len(x), np.where(missing, 0, x)
    error = np.convolve(known, a)[:n]
    error[:order] = 0  # only places with all their past count
    right = np.array([a[: min(order, n - 1 - g) + 1] @ error[g : g + min(order, n - 1 - g) + 1] for g in gaps])
    left = np.zeros((len(gaps), len(gaps)))
    for i, g in enumerate(gaps):
        for j in range(i, min(len(gaps), i + order + 1)):
            d = gaps[j] - g
            if d > order:
                break
            first = max(gaps[j], order)
            m = min(g + order, n - 1) - first + 1
            if m > 0:
                left[i, j] = left[j, i] = a[first - g : first - g + m] @ a[first - gaps[j] : first - gaps[j] + m]
    out = x.copy()
    out[gaps] = np.linalg.lstsq(left, -right, rcond=None)[0]
    return out


def islands(flags: np.ndarray, merge: int = 0) -> list[tuple[int, int]]:
    """Runs of true values; runs no more than ``merge`` apart become one."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    out: list[tuple[int, int]] = []
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if out and i - out[-1][1] <= merge:
            out[-1] = (out[-1][0], j)
        else:
            out.append((i, j))
    return out


def declick(samples: DataFrame, order: int = 32, block: int = 4096, sensitivity: float = 5.0, most: int = 64, merge: int = 8) -> DataFrame:
    """Samples whose prediction error stands out in both directions are replaced by interpolation; runs up to ``merge`` apart are one."""
    halo = 4 * order

    def outliers(e):
        mad = np.sort(np.abs(e))[len(e) // 2] * 1.4826
        return np.abs(e) > sensitivity * mad if mad > 0 else np.zeros(len(e), bool)

    def run(xs, lo, hi, start):
        y, out = xs[lo:hi], xs.copy()
        if len(y) < 4 * order:
            return y
        a = np.concatenate([[1.0], -fit_prediction(y, order)])
        bad = outliers(np.convolve(y, a)[: len(y)]) & outliers(np.convolve(y[::-1], a)[: len(y)][::-1])
        bad[:order] = bad[-order:] = False
        for i, j in islands(bad, merge):
            i, j = lo + max(order, i - 1), lo + min(len(y) - order, j + 1)
            if 0 < j - i <= most:
                p, q = max(0, i - halo), min(len(xs), j + halo)
                miss = np.zeros(q - p, bool)
                miss[i - p : j - p] = True
                out[p:q] = interpolate(out[p:q], miss, order)
        return out[lo:hi]

    return map_blocks(pack(samples, block, halo, halo), run)


def peaks(samples: DataFrame) -> DataFrame:
    return samples.groupBy("recording", "channel").agg(F.max(F.abs("x")).alias("peak"))


def declip(samples: DataFrame, tolerance: float = 0.001, least: int = 2, most: int = 512, order: int = 32, keep_level: bool = False) -> DataFrame:
    """Flat tops at the recording's peak are filled by interpolation that never lies below the clipped value; then the level falls below full scale."""
    own = 1024
    halo = most + 2 * order

    def run(xs, lo, hi, start, peak):
        if not peak:
            return xs[lo:hi]
        fill = np.zeros(len(xs), bool)
        for i, j in islands(np.abs(xs) >= peak * (1 - tolerance)):
            fill[i:j] = least <= j - i <= most
        fill[:order] = fill[len(xs) - order :] = False
        if not fill[lo:hi].any():
            return xs[lo:hi]
        got, sign = xs.copy(), np.sign(xs)
        for _ in range(3):  # the fit gets better as the tops grow
            got = interpolate(got, fill, order, trusted=True)
            got = np.where(fill, sign * np.maximum(np.abs(xs), got * sign), got)
        return got[lo:hi]

    filled = map_blocks(beside(pack(samples, own, halo, halo), peaks(samples), ["recording", "channel"]), run, None, "peak")
    if keep_level:
        return filled
    top = filled.groupBy("recording").agg(F.max(F.abs("x")).alias("top"))
    scale = F.when(F.col("top") > 1, 10 ** (-0.1 / 20) / F.col("top")).otherwise(1.0)
    return beside(filled, top, ["recording"], by="n").select("recording", "channel", "n", (F.col("x") * scale).alias("x"))


def hum_power(samples: DataFrame, rate: float, candidates: list[float]) -> DataFrame:
    """``recording, channel, hz, power``: the signal's power at each candidate frequency, by one pass of sums."""
    turn = lambda f: 2 * np.pi * f / rate * F.col("n")
    sums = [x for i, f in enumerate(candidates) for x in (F.sum(F.col("x") * F.cos(turn(f))).alias(f"c{i}"), F.sum(F.col("x") * F.sin(turn(f))).alias(f"s{i}"))]
    by = samples.groupBy("recording", "channel").agg(F.count("*").alias("frames"), *sums)
    each = F.array(*(F.struct(F.lit(float(f)).alias("hz"), ((F.col(f"c{i}") * F.col(f"c{i}") + F.col(f"s{i}") * F.col(f"s{i}")) / (F.col("frames") * F.col("frames"))).alias("power")) for i, f in enumerate(candidates)))
    return by.select("recording", "channel", F.explode(each).alias("v")).select("recording", "channel", "v.*")


def hum_search(samples: DataFrame, rate: float, around: tuple[float, ...] = (50.0, 60.0), width: float = 1.0, step: float = 0.1) -> DataFrame:
    """``recording, channel, hz, power, prominence``: the strongest candidate near a mains frequency, against the candidates' mean."""
    steps = int(round(width / step))
    grid = [round(c + k * step, 6) for c in around for k in range(-steps, steps + 1) if 0 < c + k * step < rate / 2]
    powers = hum_power(samples, rate, grid)
    best = powers.groupBy("recording", "channel").agg(F.max_by("hz", F.struct(F.round("power", 12), -F.col("hz"))).alias("hz"), F.max("power").alias("power"), F.avg("power").alias("mean"))
    return best.select("recording", "channel", "hz", "power", F.when(F.col("mean") > 0, F.col("power") / F.col("mean")).alias("prominence"))


class HumMeter:
    """Coherent levels of partials over a recording's groups of blocks: a steady hum keeps its phase from block to block, a note or noise doesn't."""

    LENGTH, BLOCKS, COHERENCE, PROMINENCE, CAP = 16384, 8, 0.65, 3.0, 30.0  # fixed values
    SPAN = LENGTH * BLOCKS
    NEAR, QUICK = (-17.0, -11.0, 11.0, 17.0), (-14.0, 14.0)

    def __init__(self, f: list[float], level: list[float], coherence: list[float], rate: float):
        """What was heard at each frequency that was asked for."""
        self.rate, self.known = rate, dict(zip(f, zip(level, coherence)))

    def partial(self, hz: float) -> tuple[float, float]:
        """(level, coherence) at a frequency: the median over groups of what is left when blocks are added with their phases, and its mean share of their magnitudes."""
        return self.known.get(round(hz, 9), (0.0, 0.0))

    def prominence(self, hz: float, offsets: tuple[float, ...] = NEAR) -> float:
        """The level against the median of those around."""
        around = sorted(self.partial(hz + d)[0] for d in offsets if 0 < hz + d < self.rate / 2)
        background = around[len(around) // 2] if around else 0.0
        return self.partial(hz)[0] / background if background > 0 else 0.0

    def evidence(self, hz: float, partials: int, offsets: tuple[float, ...] = NEAR) -> tuple[float, float]:
        """The mean of the capped prominences of a fundamental's coherent partials, and their levels together, which decide where the cap makes equals."""
        heard = [f for f in multiples(hz, partials, self.rate) if self.partial(f)[1] >= self.COHERENCE]
        return round(sum(min(self.CAP, self.prominence(f, offsets)) for f in heard) / partials, 9), sum(self.partial(f)[0] for f in heard)

    def accepted(self, hz: float, partials: int) -> list[float]:
        return [f for f in multiples(hz, partials, self.rate) if self.partial(f)[1] >= self.COHERENCE and self.prominence(f) >= self.PROMINENCE]


def multiples(hz: float, partials: int, rate: float) -> list[float]:
    return [k * hz for k in range(1, partials + 1) if k * hz < rate / 2]


def hum_groups(samples: DataFrame, ends: DataFrame) -> DataFrame:
    """One row for each group of blocks of each recording of ``ends(recording, frames)``, as ``bundle`` makes them: as few groups as hold all samples, spread evenly from the first sample to the last."""
    rows = beside(samples, ends, ["recording"], by="n").withColumn("free", F.col("frames") - HumMeter.SPAN).withColumn("more", F.expr(f"(frames - 1) div {HumMeter.SPAN}"))  # group i begins at free * i / more
    first = F.expr(f"CASE WHEN more = 0 THEN 0L ELSE greatest(0L, ((n - {HumMeter.SPAN - 1}) * more + free - 1) div free) END")
    last = F.expr("CASE WHEN more = 0 THEN 0L ELSE least(more, ((n + 1) * more - 1) div free) END")
    return bundle(rows.select("recording", "channel", "n", "x", first.alias("first"), last.alias("last")))


HEARD = "f array<double>, level array<double>, coherence array<double>"


def hum_levels(groups: DataFrame, rate: float, ask: Callable[..., list[float]], *more: str) -> DataFrame:
    """``recording, f, level, coherence``: what each group of blocks holds at the frequencies of ``ask(*more)``; a silent one has a coherence of -1."""
    length, blocks, at_once = HumMeter.LENGTH, HumMeter.BLOCKS, 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = hann(length), np.arange(length)
        for batch in batches:
            alike: dict[tuple, list] = {}
            for xs, (r, start, *told) in zip(values(batch), cells(batch, "recording", "start", *more)):
                alike.setdefault(tuple(told), []).append((r, start, xs))
            for told, rows in alike.items():
                fs = np.unique([round(f, 9) for f in ask(*told)])
                for part in (rows[j : j + 16] for j in range(0, len(rows), 16)):
                    cut = np.zeros((len(part), HumMeter.SPAN))
                    for held, (_, _, xs) in zip(cut, part):
                        held[: len(xs)] = xs[: HumMeter.SPAN]
                    cut = cut.reshape(-1, length)
                    cut *= w
                    starts = np.concatenate([s + np.arange(blocks) * length for _, s, _ in part])
                    amp = np.empty((len(cut), len(fs)), complex)
                    for i in range(0, len(fs), at_once):
                        turn = 2 * np.pi * fs[i : i + at_once] / rate
                        angle = np.outer(t, turn)
                        amp[:, i : i + at_once] = (cut @ np.cos(angle) - 1j * (cut @ np.sin(angle))) * np.exp(-1j * np.outer(starts, turn)) * (2 / w.sum())
                    amp = amp.reshape(len(part), blocks, -1)
                    size, both = np.abs(amp).sum(1), np.abs(amp.sum(1))
                    share = np.where(size > 0, both / np.where(size > 0, size, 1), -1.0)
                    yield pa.RecordBatch.from_pydict({"recording": pa.array([r for r, _, _ in part], pa.int64()), "f": [fs] * len(part), "level": list(both / blocks), "coherence": list(share)})

    return groups.mapInArrow(run, f"recording long, {HEARD}")


def hum_heard(levels: DataFrame) -> DataFrame:
    """``hum_levels`` of all groups of a recording together: the median of the levels, the mean of the coherences."""
    each = levels.select("recording", F.explode(F.arrays_zip("f", "level", "coherence")).alias("v")).select("recording", "v.*").filter("coherence >= 0")
    by = each.groupBy("recording", "f").agg(F.sort_array(F.collect_list("level")).alias("levels"), F.sort_array(F.collect_list("coherence")).alias("shares"))  # two numbers for a group
    count = F.size("levels")
    level, mean = F.element_at("levels", (F.floor(count / 2) + 1).cast("int")), F.aggregate("shares", F.lit(0.0), lambda a, b: a + b) / count
    whole = by.groupBy("recording").agg(F.collect_list(F.struct("f", level.alias("level"), mean.alias("coherence"))).alias("v"))
    return whole.select("recording", *(F.col("v")[k].alias(k) for k in ("f", "level", "coherence")))


def judged(heard: DataFrame, rate: float, judge: Callable[..., list[tuple]], schema: str, *more: str) -> DataFrame:
    """``recording`` and the rows of ``judge(meter, *more)`` for each row of what was heard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *out) for r, f, level, coherence, *told in cells(batch, "recording", "f", "level", "coherence", *more) for out in judge(HumMeter(f, level, coherence, rate), *told)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("recording", *(c.split()[0] for c in schema.split(", "))), map(list, zip(*rows)))))

    return heard.mapInArrow(run, f"recording long, {schema}")


def find_hum(samples: DataFrame, rate: float, frequency: float | None = None, partials: int = 8, least: float = 2.0) -> DataFrame:
    """``recording, found, hz, evidence, parts``: mains frequency and coherent partials of channel 0 of each recording.

    Steps of 0.1 Hz around 50 and 60 Hz over four partials (the mean of the evidence in each group of blocks), then of 0.01 Hz around the best over eight (of all groups together); found if the
    mean prominence is at least ``least`` and two partials are steady and stand out (a lone tone is no hum).  With ``frequency`` given, only its partials are looked at.  A group has 131,072 samples,
    and groups cover the whole recording; in one that is shorter than a group nothing is found (given a frequency, all its partials are taken)."""
    near, quick = HumMeter.NEAR, HumMeter.QUICK
    coarse = [m + 0.1 * k for m in (50.0, 60.0) for k in range(-10, 11)]
    around = lambda hz: [hz, *(hz + 0.01 * k for k in range(-9, 10))]
    asked = lambda tried, count, offsets: [f + d for hz in tried for f in multiples(hz, count, rate) for d in (0.0, *offsets) if 0 < f + d < rate / 2]
    scratch = Scratch(samples.sparkSession, "groups")
    own = samples.filter("channel = 0").select(F.col("recording").cast("long").alias("recording"), "channel", F.col("n").cast("long").alias("n"), "x")
    ends = scratch.keep(own.groupBy("recording").agg((F.max("n") + 1).alias("frames")), "ends")
    long = ends.filter(F.col("frames") >= HumMeter.SPAN)
    groups = scratch.keep(hum_groups(own, long), "groups")

    def weigh(meter):
        return [(i, hz, *meter.evidence(hz, 4, quick)) for i, hz in enumerate(coarse)]

    def refine(meter, hz):
        (e, _), _, f = max((meter.evidence(f, 8), -i, f) for i, f in enumerate(around(hz)))
        return [(round(f, 6), e)]

    def accept(meter, hz):
        return [(meter.accepted(hz, partials),)]

    if frequency is None:
        each = judged(hum_levels(groups, rate, lambda: asked(coarse, 4, quick)), rate, weigh, "i long, hz double, e double, level double")
        tried = each.groupBy("recording", "i", "hz").agg(F.round(F.avg("e"), 9).alias("e"), F.round(F.avg("level"), 12).alias("level"))
        best = scratch.keep(tried.groupBy("recording").agg(F.max_by("hz", F.struct("e", "level", -F.col("i"))).alias("hz"), F.max("e").alias("e")).filter("e > 0").select("recording", "hz"), "best")
        fine = hum_heard(hum_levels(beside(groups, best, ["recording"]), rate, lambda hz: asked(around(hz), 8, near), "hz"))
        found = scratch.keep(judged(fine.join(best, "recording"), rate, refine, "hz double, evidence double", "hz"), "found")
        sure, few, every, hz = found.filter(F.col("evidence") >= least).select("recording", "hz"), 2, F.lit(None), F.col("hz")
    else:
        frequency = float(frequency)
        found = long.select("recording", F.lit(frequency).alias("hz"), F.lit(None).cast("double").alias("evidence"))
        sure, few, every, hz = found.select("recording", "hz"), 1, F.array(*map(F.lit, multiples(frequency, partials, rate))), F.lit(frequency)
    steady = hum_heard(hum_levels(beside(groups, sure, ["recording"]), rate, lambda hz: asked([hz], partials, near), "hz"))
    parts = judged(steady.join(sure, "recording"), rate, accept, "parts array<double>", "hz").filter(F.size("parts") >= few)
    got = F.when(F.col("frames") >= HumMeter.SPAN, F.col("parts")).otherwise(every.cast("array<double>"))
    known = ends.join(found, "recording", "left").join(parts, "recording", "left")
    return known.select("recording", got.isNotNull().alias("found"), hz.alias("hz"), "evidence", got.alias("parts"))


def dehum(samples: DataFrame, rate: float, hz: float = 50.0, partials: int = 8, block: int = 4096) -> DataFrame:
    """Subtract the partials of a mains frequency from all recordings."""
    parts = [k * hz for k in range(1, partials + 1) if k * hz < rate / 2]
    return dehum_each(samples, rate, samples.select("recording").distinct().withColumn("parts", F.array(*map(F.lit, parts)).cast("array<double>")), block)


def dehum_each(samples: DataFrame, rate: float, found: DataFrame, block: int = 4096) -> DataFrame:
    """Subtract each recording's ``parts`` (of ``found``; none: it stays as it is): each one's complex amplitude in overlapping blocks, averaged over the blocks around, overlap-added."""
    hop, around = block // 4, 4
    w = hann(block)

    def run(xs, lo, hi, start, parts):
        if not parts:
            return xs[lo:hi]
        size = min(block, len(xs))
        win = w if size == block else hann(size)
        starts = sorted({*range(0, max(len(xs) - size, 0) + 1, hop), len(xs) - size})  # the last one is right-aligned
        out, norm = np.zeros(len(xs)), np.full(len(xs), 1e-12)
        views = np.stack([xs[s : s + size] * win for s in starts])
        for s in starts:
            norm[s : s + size] += win
        for f in parts:
            t = np.arange(len(xs)) + start
            wave = np.exp(-2j * np.pi * f * t / rate)
            amp = 2 * np.array([v @ wave[s : s + size] for v, s in zip(views, starts)]) / win.sum()
            amp = np.array([amp[max(0, i - around) : i + around + 1].mean() for i in range(len(amp))])
            for a, s in zip(amp, starts):
                out[s : s + size] += win * (a * np.conj(wave[s : s + size])).real
        return (xs - out / norm)[lo:hi]

    halo = block + (around + 1) * hop
    packed = pack(samples, SPAN // hop * hop, -(-halo // hop) * hop, -(-halo // hop) * hop)
    return map_blocks(beside(packed, found.select("recording", "parts"), ["recording"], "left"), run, None, "parts")


def stretch(samples: DataFrame, factor: float, size: int = 2048, hop: int = HOP, frames: int = 512) -> DataFrame:
    """Time-stretch by a phase vocoder with identity phase locking: ``factor`` times as long at the same pitch.

    Phases add up along the whole recording, but a frame does the same to any phases before it: a bin takes those of its region's peak and adds an angle.  Such steps compose
    (which bin of the beginning a bin follows, and how far it has turned), so blocks of ``frames`` output frames are gone through side by side, then their few numbers
    along the recording, and the blocks again from their true phases."""
    if not 0.1 <= factor <= 10:
        raise ValueError("the factor must lie between 0.1 and 10")
    pad, back = size - hop, size // hop - 1
    spark = samples.sparkSession
    scratch = Scratch(spark, "stretch")
    keys = ["recording", "channel"]
    count = lambda length: F.floor((length + (pad - 1)) / hop) + 1
    sizes = samples.select(F.col("recording").cast("long").alias("recording"), F.col("channel").cast("int").alias("channel"), "n").groupBy(*keys).agg((F.max("n") + 1).cast("long").alias("length"))
    sizes = sizes.withColumn("out", F.greatest(F.lit(1), F.floor(F.col("length") * factor + 0.5)).cast("long"))
    sizes = scratch.keep(sizes.withColumn("inner", count(F.col("length"))).withColumn("outer", count(F.col("out"))), "sizes")
    rate = (F.col("inner") - 1) / F.greatest(F.col("outer") - 1, F.lit(1))  # input frames for an output frame
    first = F.floor((F.col("n") + pad - size) / hop)
    low = F.floor((first - 1) / F.greatest(rate, F.lit(1e-9))) - 1
    high = F.ceil((first + size // hop + 2) / F.greatest(rate, F.lit(1e-9))) + 1 + back
    last = F.floor((F.col("outer") - 1) / frames)
    rows = samples.select(F.col("recording").cast("long").alias("recording"), F.col("channel").cast("int").alias("channel"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))
    rows = beside(rows, sizes, keys, by="n").select(*keys, "n", "x", *(F.least(last, F.greatest(F.lit(0), F.floor(v / frames))).cast("long").alias(k) for k, v in (("first", low), ("last", high))))
    packed = scratch.keep(beside(bundle(rows), sizes, keys), "packed")

    def steps(xs, start, block, length, out, inner, outer, more):
        """(frame, magnitudes, which bin each follows, how far it turns) of a block's frames; the very first frame turns from nothing."""
        begin, end = max(0, block * frames - back), min(outer, (block + 1) * frames - back * (not more))
        expected = 2 * np.pi * hop * np.arange(size // 2 + 1) / size
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def polar(i):
            if i not in known:
                a = frame_of(xs, start, i, size, hop)
                known[i] = np.abs(a), np.angle(a)
            return known[i]

        for f in range(begin, end):
            place = f * (inner - 1) / (outer - 1) if outer > 1 else 0.0
            left = int(place)
            for i in [i for i in known if i < left]:
                del known[i]
            (size_a, angle_a), (size_b, angle_b) = polar(left), polar(min(left + 1, inner - 1))
            t = place - left
            mag = size_a * (1 - t) + size_b * t
            if f == 0:
                yield f, mag, None, angle_a
                continue
            turn = expected + wrapped(angle_b - angle_a - expected)
            lead, near = leads(mag), angle_a if t < 0.5 else angle_b
            yield f, mag, lead, turn[lead] + near - near[lead]

    def summed(batches):
        done = Gathered(pa.schema([("recording", pa.int64()), ("channel", pa.int32()), ("block", pa.int64()), ("of", pa.list_(pa.int32())), ("add", pa.list_(pa.float64()))]))
        for batch in batches:
            for xs, (r, c, block, start, *about) in zip(values(batch), cells(batch, "recording", "channel", "block", "start", "length", "out", "inner", "outer")):
                if (block + 1) * frames >= about[-1]:
                    continue  # nothing follows a recording's last block
                of, add = np.arange(size // 2 + 1), np.zeros(size // 2 + 1)
                for _, _, lead, turn in steps(xs, start, block, *about, False):
                    of, add = (np.full(len(of), -1), turn) if lead is None else (of[lead], wrapped(add[lead] + turn))
                yield from done.add([r, c, block, of.astype(np.int32), add])
        yield from done.rest()

    def turn_on(now, of, add):
        of = np.asarray(of)
        return wrapped(np.where(of >= 0, now[np.maximum(of, 0)], 0.0) + np.asarray(add))

    ends = packed.mapInArrow(summed, "recording long, channel int, block long, of array<int>, add array<double>")
    turned = along(ends, ["of", "add"], lambda: np.zeros(size // 2 + 1), turn_on, "phase array<double>", after=True)

    def sound(batches):
        w = hann(size)
        for batch in batches:
            for xs, phase, (r, c, block, start, length, out, inner, outer) in zip(values(batch), values(batch, "phase"), cells(batch, "recording", "channel", "block", "start", "length", "out", "inner", "outer")):
                phase, begin = phase if len(phase) else np.zeros(size // 2 + 1), max(0, block * frames - back)
                y = np.zeros((frames + back + 1) * hop + size)
                norm = np.zeros(len(y))
                for f, mag, lead, turn in steps(xs, start, block, length, out, inner, outer, True):
                    phase = turn if lead is None else wrapped(phase[lead] + turn)
                    at = (f - begin) * hop
                    y[at : at + size] += np.fft.irfft(mag * np.exp(1j * phase), size) * w
                    norm[at : at + size] += w * w
                a = block * frames * hop  # the block's own places, counted with the padding
                b = out + pad if (block + 1) * frames >= outer else a + frames * hop
                a, b = max(a, pad), min(b, out + pad)
                if b > a:
                    yield sample_rows(r, c, a - pad, (y / np.maximum(norm, 1e-12))[a - begin * hop : b - begin * hop])

    return packed.join(turned, [*keys, "block"], "left").mapInArrow(sound, SAMPLES)


def wrapped(angle: np.ndarray) -> np.ndarray:
    return angle - 2 * np.pi * np.round(angle / (2 * np.pi))


def frame_of(xs: np.ndarray, start: int, i: int, size: int, hop: int) -> np.ndarray:
    """The spectrum of frame ``i`` of a recording, of which ``xs`` begins at ``start``; what isn't there is silent."""
    at = i * hop - (size - hop) - start
    a, b = max(at, 0), min(at + size, len(xs))
    x = np.zeros(size)
    if b > a:
        x[a - at : b - at] = xs[a:b]
    return np.fft.rfft(x * hann(size))


def leads(mag: np.ndarray) -> np.ndarray:
    """The peak whose region each bin lies in: regions part at the lowest bin between two peaks, which belongs to the lower one.  Without peaks each bin leads itself."""
    top = np.flatnonzero((mag[1:-1] > mag[:-2]) & (mag[1:-1] > mag[2:])) + 1
    if not len(top):
        return np.arange(len(mag))
    first, last = top[:-1] + 1, top[-1]
    low = np.repeat(np.minimum.reduceat(mag[:last], first), np.diff(top)) if len(first) else mag[:0]  # a region's end is lower than the peak behind it
    at = np.flatnonzero(mag[top[0] + 1 : last + 1][: len(low)] == low) + top[0] + 1
    edges = np.concatenate([[0], at[np.searchsorted(at, first)] + 1, [len(mag)]])
    return np.repeat(top, np.diff(edges))
