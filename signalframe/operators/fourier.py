"""Transforms of whole recordings that no task holds: a transform of N1 x N2 places is N2 of N1, a turn of each value, and N1 of N2.

Place n = n1 * N2 + n2 and bin k = k1 + N1 * k2, with N1 and N2 about the square root of the length.  Columns (equal n2) and rows (equal k1) are dealt out in bundles of
``CELLS`` values; between the two steps values travel once, as tiles.  The inverse goes the same way back, so a correlation takes three shuffles of its values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 17
TILES = "recording long, bits int, p long, q long, side int, content binary"


def shape(bits: int) -> tuple[int, int, int, int]:
    """N1, N2, and how many columns and rows make a bundle."""
    n1 = 1 << (bits // 2)
    n2 = 1 << (bits - bits // 2)
    return n1, n2, min(n2, max(1, CELLS // n1)), min(n1, max(1, CELLS // n2))


def turns(n1: int, n2: int, k1: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.exp(-2j * np.pi * (np.outer(k1, at) % (n1 * n2)) / (n1 * n2))


def _bits(length):
    """The number of bits of a transform that is at least as long."""
    return F.greatest(F.lit(2), F.ceil(F.log2(length.cast("double")) - 1e-12).cast("int"))


def correlation(a: DataFrame, b: DataFrame, reduce, schema: str) -> DataFrame:
    """``reduce(recording, place, value)`` of bundles of the circular cross-correlation of ``a(recording, n, x)`` with ``b``: place m is lag m, or m - size from the middle of the size on.

    The size of a recording's transform is its and its partner's length together, up to a power of two; recordings without a partner are left out."""
    ends = lambda df, name: df.groupBy("recording").agg((F.max("n") + 1).alias(name))
    sizes = ends(a, "_a").join(ends(b, "_b"), "recording").select("recording", "_a", "_b", _bits(F.col("_a") + F.col("_b")).alias("bits"))
    both = a.select("recording", "n", "x", F.lit(0).alias("side")).unionByName(b.select("recording", "n", "x", F.lit(1).alias("side")))
    both = both.join(sizes, "recording")
    wide, tall = F.expr("shiftleft(1L, CAST(bits - floor(bits / 2) AS INT))"), F.expr("shiftleft(1L, CAST(floor(bits / 2) AS INT))")
    bundle = F.least(wide, F.greatest(F.lit(1), F.floor(F.lit(CELLS) / tall)))
    placed = both.withColumn("p", F.floor((F.col("n") % wide) / bundle).cast("long")).select("recording", "bits", "p", "side", "n", "x")

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        """Transforms of the columns of a bundle, turned, cut into tiles for the rows."""
        recording, bits, p = (int(pdf[c].iloc[0]) for c in ("recording", "bits", "p"))
        n1, n2, wide, tall = shape(bits)
        out = []
        for side, own in pdf.groupby("side"):
            x, n = np.zeros((n1, wide)), own["n"].to_numpy()
            x[n // n2, n % n2 - p * wide] = own["x"].to_numpy()
            got = np.fft.fft(x, axis=0) * turns(n1, n2, np.arange(n1), p * wide + np.arange(wide))
            out += [(recording, bits, p, q, int(side), got[q * tall : (q + 1) * tall].tobytes()) for q in range(n1 // tall)]
        return pd.DataFrame(out, columns=["recording", "bits", "p", "q", "side", "content"])

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        """The product of both spectra on the rows of a bundle, and half the way back."""
        recording, bits, q = (int(pdf[c].iloc[0]) for c in ("recording", "bits", "q"))
        n1, n2, wide, tall = shape(bits)
        x = np.zeros((2, tall, n2), np.complex128)
        for p, side, content in zip(pdf["p"], pdf["side"], pdf["content"]):
            x[side, :, p * wide : (p + 1) * wide] = np.frombuffer(content, np.complex128).reshape(tall, wide)
        spectra = np.fft.fft(x, axis=2)
        back = np.fft.ifft(np.conj(spectra[0]) * spectra[1], axis=1) * np.conj(turns(n1, n2, q * tall + np.arange(tall), np.arange(n2)))
        return pd.DataFrame([(recording, bits, p, q, 0, np.ascontiguousarray(back[:, p * wide : (p + 1) * wide]).tobytes()) for p in range(n2 // wide)], columns=["recording", "bits", "p", "q", "side", "content"])

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        recording, bits, p = (int(pdf[c].iloc[0]) for c in ("recording", "bits", "p"))
        n1, n2, wide, tall = shape(bits)
        x = np.zeros((n1, wide), np.complex128)
        for q, content in zip(pdf["q"], pdf["content"]):
            x[q * tall : (q + 1) * tall] = np.frombuffer(content, np.complex128).reshape(tall, wide)
        r = np.fft.ifft(x, axis=0).real
        at = np.arange(n1)[:, None] * n2 + p * wide + np.arange(wide)
        return reduce(recording, 1 << bits, at.ravel(), r.ravel(), int(pdf["_a"].iloc[0]), int(pdf["_b"].iloc[0]))

    spread = placed.groupBy("recording", "bits", "p").applyInPandas(columns, TILES)
    half = spread.groupBy("recording", "bits", "q").applyInPandas(rows, TILES)
    return half.join(sizes.select("recording", "_a", "_b"), "recording").groupBy("recording", "bits", "p").applyInPandas(places, schema)
