"""Streams of blocks: segments whose totals go on, and conversion to another rate with the resampler's history as state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import sinc_kernel


def segment_peaks(blocks: DataFrame) -> DataFrame:
    """Peak and energy of each ``segment`` of ``blocks(recording, segment, samples)`` and, under a null segment, of the recording so far: a new segment loses no totals."""
    x = blocks.select("recording", F.explode(F.array(F.col("segment"), F.lit(None).cast(blocks.schema["segment"].dataType))).alias("segment"), F.explode("samples").alias("x"))
    return x.groupBy("recording", "segment").agg(F.max(F.abs("x")).alias("peak"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("frames"))


def convert(blocks: DataFrame, from_rate: float, to_rate: float, quality: str = "best") -> DataFrame:
    """``recording, channel, n, x`` at another rate from ``blocks(recording, channel, block_index, samples, last)``, however the stream is cut.

    Output k needs input up to k * from / to and half a kernel; what it still needs stays in the state, early blocks wait
    there for their turn, and the block marked ``last`` flushes the rest.  With equal rates samples pass as they are."""
    half, kernel = sinc_kernel(quality)
    ratio = from_rate / to_rate
    stretch = max(1.0, ratio)
    reach = int(half * stretch) + 1

    def produce(hist: np.ndarray, origin: int, k: int, ready: int, done: bool):
        """Outputs from k on whose input has come (all, if done)."""
        upto = math.ceil(ready / ratio - 1e-9) if done else max(k, math.floor((ready - 1 - reach) / ratio) + 1 if ready > reach else k)
        places = np.arange(k, upto)
        if from_rate == to_rate:
            return places, hist[places - origin] if len(places) else np.zeros(0)
        p = places * from_rate / to_rate
        at = np.floor(p).astype(int)[:, None] + np.arange(-reach, reach + 1)
        ok = (at >= origin) & (at < ready)
        got = np.where(ok, hist[np.clip(at - origin, 0, max(len(hist) - 1, 0))], 0) if len(hist) else np.zeros(at.shape)
        return places, (got * kernel((at - p[:, None]) / stretch)).sum(1) / stretch

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, k, origin, hist, waiting = state.get if state.exists else (0, 0, 0, [], [])
        hist = np.asarray(hist, float)
        held = {int(i): (list(s), bool(e)) for i, s, e in waiting}
        for pdf in pdfs:
            held.update({int(i): (list(s), bool(e)) for i, s, e in zip(pdf["block_index"], pdf["samples"], pdf["last"]) if i >= nxt})
        places, values = [], []
        while nxt in held:
            samples, done = held.pop(nxt)
            hist = np.concatenate([hist, np.asarray(samples, float)])
            n, x = produce(hist, origin, k, origin + len(hist), done)
            places.append(n)
            values.append(x)
            k += len(n)
            keep = max(origin, math.floor(k * ratio) - reach)
            hist, origin = hist[keep - origin :], keep
            nxt += 1
        state.update((nxt, k, origin, [float(v) for v in hist], [(i, [float(v) for v in s], e) for i, (s, e) in held.items()]))
        n = np.concatenate(places) if places else np.zeros(0, int)
        yield pd.DataFrame({"recording": key[0], "channel": key[1], "n": n, "x": np.concatenate(values) if values else np.zeros(0)})

    return blocks.groupBy("recording", "channel").applyInPandasWithState(
        run, "recording long, channel int, n long, x double", "next long, k long, origin long, hist array<double>, waiting array<struct<i:long,s:array<double>,e:boolean>>", "append", GroupStateTimeout.NoTimeout
    )


def with_settings(blocks: DataFrame, settings: DataFrame) -> DataFrame:
    """Each block with the gain of ``settings(recording, version, gain)`` that is in force (the latest; 1 where there is none): a small table that is read anew for every micro-batch."""
    latest = settings.groupBy("recording").agg(F.max_by("gain", "version").alias("gain"))
    return blocks.join(latest, "recording", "left").withColumn("samples", F.transform("samples", lambda v: v * F.coalesce(F.col("gain"), F.lit(1.0)))).drop("gain")
