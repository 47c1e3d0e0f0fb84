"""Incremental meters on streams: algebraic ones are streaming aggregations, loudness keeps its filter state per recording."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.loudness import OFFSET, k_weighting


def running_statistics(blocks: DataFrame) -> DataFrame:
    """Peak, energy, mean and frames of each recording and channel so far, from ``blocks(recording, channel, samples)``; use complete or update mode."""
    x = blocks.select("recording", "channel", F.explode("samples").alias("x"))
    return x.groupBy("recording", "channel").agg(F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.avg("x").alias("mean"), F.count("*").alias("frames"))


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event time with a watermark for late data."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("c"), F.sum("value").alias("total"))


def _filter(x: np.ndarray, sections, state: list[float]) -> tuple[np.ndarray, list[float]]:
    y, out = x, []
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        s1, s2 = state[2 * k], state[2 * k + 1]
        z = np.empty(len(y))
        for i, v in enumerate(y.tolist()):
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            z[i] = o
        y = z
        out += [s1, s2]
    return y, out


def loudness_meter(blocks: DataFrame, rate: float) -> DataFrame:
    """Energy and loudness of each whole 100 ms of each recording and channel, however the stream is cut.

    ``blocks(recording, channel, block_index, samples)``.  Blocks that come early wait in the state for their turn."""
    sections, size = k_weighting(rate), int(rate / 10)

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, sub, filt, rest, waiting = state.get if state.exists else (0, 0, [0.0] * 4, [], [])
        held = {int(i): list(s) for i, s in waiting}
        for pdf in pdfs:
            held.update({int(i): list(s) for i, s in zip(pdf["block_index"], pdf["samples"]) if i >= nxt})
        rows = []
        while nxt in held:
            y, filt = _filter(np.asarray(held.pop(nxt), float), sections, list(filt))
            y = np.concatenate([np.asarray(rest, float), y])
            n = len(y) // size
            for e in (y[: n * size].reshape(n, size) ** 2).sum(1):
                rows.append((key[0], key[1], sub, float(e), float(OFFSET + 10 * np.log10(e / size)) if e > 0 else -200.0))
                sub += 1
            rest = y[n * size :].tolist()
            nxt += 1
        state.update((nxt, sub, [float(v) for v in filt], [float(v) for v in rest], [(i, [float(v) for v in s]) for i, s in held.items()]))
        yield pd.DataFrame(rows, columns=["recording", "channel", "sub", "sq", "loudness"])

    return blocks.groupBy("recording", "channel").applyInPandasWithState(
        run, "recording long, channel int, sub long, sq double, loudness double",
        "next long, sub long, filter array<double>, rest array<double>, waiting array<struct<i:long,s:array<double>>>", "append", GroupStateTimeout.NoTimeout,
    )
