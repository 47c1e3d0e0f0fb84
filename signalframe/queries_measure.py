"""Queries of measurements, scalar functions, spectrogram views and stores, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import model
from .functions import scalars
from .operators import advanced, channels, filters, loudness, measure, pyramids, room, spectral, statistics
from .plans import tiles
from .queries import CHROMA, DFT, EVENT, LINE, QUERIES, SPEC, SQL, SUBS, db_sql, query, rounded  # noqa: F401

RATE = model.RATE
PULSE = EVENT.replace("(value - 250) / 250 AS x", "(value - 250) / 250 * exp(-(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 8.0) AS x")


def _pulses(spark, sf_dir) -> DataFrame:
    """Each user's recording as a decaying impulse response."""
    return model.event_signal(spark, sf_dir).withColumn("x", F.col("x") * F.exp(-F.col("n") / 8.0))


# --- rooms

Y = f"""{PULSE}, pk AS (SELECT recording, max(abs(x)) AS p, max(n) AS last FROM ev GROUP BY 1), di AS (SELECT ev.recording, min(n) AS d FROM ev JOIN pk USING (recording) WHERE abs(x) >= p * 0.1 GROUP BY 1),
y AS MATERIALIZED (SELECT ev.recording, n - d AS n, x, last + 1 - d AS available, d AS direct FROM ev JOIN pk USING (recording) JOIN di USING (recording) WHERE n >= d),
nz AS (SELECT recording, available, avg(CASE WHEN n >= available - available // 10 THEN x * x END) AS noise FROM y GROUP BY ALL), wd AS (SELECT recording, available, n // greatest(64, available // 200) AS w, avg(x * x) AS energy, count(*) AS c FROM y GROUP BY ALL),
ct AS (SELECT wd.recording, min(w * greatest(64, wd.available // 200)) AS cut FROM wd JOIN nz USING (recording) WHERE c = greatest(64, wd.available // 200) AND noise > 0 AND energy < 10 * noise AND wd.available >= 20 GROUP BY 1),
us AS (SELECT recording, available, coalesce(cut, available) AS usable FROM nz LEFT JOIN ct USING (recording))"""


def _curve_sql(name: str, src: str, tail: str = "0.0") -> str:
    return f"{name}0 AS (SELECT recording, n, sum(x * x) OVER (PARTITION BY recording ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + {tail} AS l FROM {src}), {name} AS MATERIALIZED (SELECT a.recording, a.n, {db_sql('a.l / b.l', 10)} AS v FROM {name}0 a JOIN {name}0 b ON b.recording = a.recording AND b.n = 0 WHERE b.l > 0)"


def _slope_sql(name: str, curve: str, top: float, bottom: float) -> str:
    return f"{name} AS (SELECT recording, regr_slope(v, (n - a)::DOUBLE) AS s FROM {curve} JOIN (SELECT recording, min(CASE WHEN v <= {top} THEN n END) AS a, min(CASE WHEN v <= {bottom} THEN n END) AS b FROM {curve} GROUP BY 1) USING (recording) WHERE b > a + 2 AND n BETWEEN a AND b GROUP BY 1 HAVING regr_slope(v, (n - a)::DOUBLE) < 0)"


def _tail_sql(name: str, src: str, frames: str) -> str:
    return f"""{_curve_sql(name + 'p', src)}, {_slope_sql(name + 's', name + 'p', -5.0, -20.0)}, {name} AS (SELECT recording, e * (-10.0 / (s * ln(10))) AS tail FROM (SELECT recording, avg(x * x) AS e FROM {src} JOIN (SELECT recording, {frames} AS f FROM us) USING (recording) WHERE f >= 64 AND n >= f - greatest(32, f // 100) GROUP BY 1) JOIN {name}s USING (recording))"""


@query(
    "m19_room_acoustics",
    f"""WITH {Y}, ok AS (SELECT * FROM us WHERE available >= 16 AND usable >= 16), ud AS MATERIALIZED (SELECT y.recording, n, x FROM y JOIN ok USING (recording) WHERE n < usable), {_tail_sql('tl', 'ud', 'usable')}, ux AS (SELECT ud.*, coalesce(tail, 0) AS tail FROM ud LEFT JOIN tl USING (recording)),
{_curve_sql('cv', 'ux', 'tail')}, {_slope_sql('e', 'cv', 0.0, -10.0)}, {_slope_sql('t2', 'cv', -5.0, -25.0)}, {_slope_sql('t3', 'cv', -5.0, -35.0)}, lo AS (SELECT recording, -min(v) AS reach FROM cv GROUP BY 1),
q AS (SELECT recording, direct, sum(CASE WHEN n < 25 THEN x * x ELSE 0 END) AS e5, sum(CASE WHEN n < 40 THEN x * x ELSE 0 END) AS e8, sum(x * x) AS al, sum(x * x * n / 500.0) AS mo FROM y GROUP BY ALL)
SELECT recording, reach IS NOT NULL AS valid, round(-60 / e.s / 500, 5) AS edt, round(-60 / t2.s / 500, 5) AS t20, round(-60 / t3.s / 500, 5) AS t30, round(CASE WHEN al - e5 > 1e-15 * al THEN 10 * log10(e5 / (al - e5)) END, 5) AS c50_db, round(CASE WHEN al - e8 > 1e-15 * al THEN 10 * log10(e8 / (al - e8)) END, 5) AS c80_db,
round(e5 / al, 6) AS d50, round(mo / al, 6) AS centre_time, round(reach, 5) AS usable_range_db, direct FROM q LEFT JOIN e USING (recording) LEFT JOIN t2 USING (recording) LEFT JOIN t3 USING (recording) LEFT JOIN lo USING (recording)""",
)
def _(spark, sf_dir):
    out = room.room(_pulses(spark, sf_dir), 500.0)
    return out.select(*(F.round(c, 6 if c in ("d50", "centre_time") else 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("m21_schroeder_from_direct", f"WITH {Y}, {_tail_sql('tl', 'y', 'available')}, ux AS (SELECT y.*, coalesce(tail, 0) AS tail FROM y LEFT JOIN tl USING (recording)), {_curve_sql('cv', 'ux', 'tail')} SELECT recording, n, round(v, 5) + 0.0::DOUBLE AS level_db FROM cv")
def _(spark, sf_dir):
    return rounded(room.schroeder_from_direct(_pulses(spark, sf_dir)), 5)


_NOM, _FIL = ", ".join(f"({c}::DOUBLE)" for c in spectral.OCTAVES), ", ".join(f"({1000 * 10 ** (0.3 * k)!r}::DOUBLE)" for k in range(-4, 5))


@query("j9_band_match", f"WITH a(centre) AS (VALUES {_NOM}), b(f) AS (VALUES {_FIL}) SELECT centre, round(f, 6) AS filter_centre FROM a LEFT JOIN b ON abs(f - centre) <= centre * 0.02")
def _(spark, sf_dir):
    nominal = spark.createDataFrame([(c,) for c in spectral.OCTAVES], "centre double")
    made = spark.createDataFrame([(1000 * 10 ** (0.3 * k),) for k in range(-4, 5)], "filter_centre double")
    return rounded(room.match_bands(nominal, made))


# --- loudness

KW = """kw(rate) AS (SELECT unnest([8000, 16000, 22050, 32000, 44100, 48000, 88200, 96000, 192000])::DOUBLE),
sh AS (SELECT rate, tan(pi() * 1681.974450955533 / rate) AS k, pow(10, 3.999843853973347 / 20) AS v, 0.7071752369554196 AS q FROM kw), s2 AS (SELECT *, pow(v, 0.4996667741545416) AS vb, 1 + k / q + k * k AS d FROM sh), hp AS (SELECT rate, tan(pi() * 38.13547087602444 / rate) AS k, 0.5003270373238773 AS q FROM kw), h2 AS (SELECT *, 1 + k / q + k * k AS d FROM hp)"""


@query(
    "m1_k_weighting",
    f"""WITH {KW} SELECT rate, 0::INT AS section, round((v + vb * k / q + k * k) / d, 9) AS b0, round(2 * (k * k - v) / d, 9) AS b1, round((v - vb * k / q + k * k) / d, 9) AS b2, round(2 * (k * k - 1) / d, 9) AS a1, round((1 - k / q + k * k) / d, 9) AS a2 FROM s2
UNION ALL SELECT rate, 1::INT, 1.0, -2.0, 1.0, round(2 * (k * k - 1) / d, 9), round((1 - k / q + k * k) / d, 9) FROM h2""",
)
def _(spark, sf_dir):
    rates = (8000, 16000, 22050, 32000, 44100, 48000, 88200, 96000, 192000)
    rows = [(float(r), i, *map(float, s)) for r in rates for i, s in enumerate(loudness.k_weighting(r))]
    return rounded(spark.createDataFrame(rows, "rate double, section int, b0 double, b1 double, b2 double, a1 double, a2 double"), 9)


def _points(spark, sf_dir):
    mono = model.long(model.line_signal(spark, sf_dir)).withColumn("recording", F.lit(0).cast("long"))
    return mono, loudness.series(loudness.sub_blocks(mono, 800, weighted=False), 800)


@query(
    "a7_a9_loudness_range",
    f"""WITH {SUBS}, st AS (SELECT least(CAST(floor((short_term + 70) / 0.1) AS INT), 999) AS bin, pow(10, (short_term + 0.691) / 10) AS e FROM pt WHERE short_term > -70 AND (sub - 29) % 10 = 0), bn AS (SELECT bin, count(*) AS c, sum(e) AS e FROM st GROUP BY 1),
g AS (SELECT -20.691 + 10 * log10(sum(e) / sum(c)) AS gate FROM bn), k AS (SELECT bin, c, sum(c) OVER (ORDER BY bin) AS upto, sum(c) OVER () AS n FROM bn, g WHERE (bin + 0.5) * 0.1 - 70 > gate),
p AS (SELECT min(CASE WHEN upto > floor((n - 1) * 0.95 + 0.5) THEN (bin + 0.5) * 0.1 - 70 END) AS hi, min(CASE WHEN upto > floor((n - 1) * 0.1 + 0.5) THEN (bin + 0.5) * 0.1 - 70 END) AS lo FROM k) SELECT round(greatest(0, hi - lo), 6)::DOUBLE AS lra FROM p WHERE hi IS NOT NULL""",
)
def _(spark, sf_dir):
    return rounded(loudness.loudness_range(_points(spark, sf_dir)[1]).drop("recording"))


@query("w3_running_max", f"WITH {SUBS} SELECT sub, round(max(momentary) OVER o, 6) AS max_momentary, round(max(short_term) OVER o, 6) AS max_short_term FROM pt WINDOW o AS (ORDER BY sub ROWS UNBOUNDED PRECEDING)")
def _(spark, sf_dir):
    w = Window.partitionBy("recording").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    p = _points(spark, sf_dir)[1]
    return rounded(p.select("sub", F.max("momentary").over(w).alias("max_momentary"), F.max("short_term").over(w).alias("max_short_term")))


@query("w4_every_tenth", f"WITH {SUBS} SELECT sub, round(short_term, 6) AS short_term FROM pt WHERE sub >= 29 AND (sub - 29) % 10 = 0")
def _(spark, sf_dir):
    return rounded(_points(spark, sf_dir)[1].filter("sub >= 29 AND (sub - 29) % 10 = 0").select("sub", "short_term"))


# an interpolator of 4 phases of up to 25 taps, spelled out
PHASES = """tp AS (SELECT i, (CASE WHEN i = 48 THEN 1 ELSE sin(pi() * (i - 48) / 4) / (pi() * (i - 48) / 4) END) * (0.35875 - 0.48829 * cos(2 * pi() * i / 96) + 0.14128 * cos(4 * pi() * i / 96) - 0.01168 * cos(6 * pi() * i / 96)) AS h FROM range(97) t(i)),
ph AS (SELECT i % 4 AS k, i // 4 AS j, h / sum(h) OVER (PARTITION BY i % 4) AS h FROM tp)"""
_CONTOUR = f"""{SUBS}, {PHASES}, up AS (SELECT channel, k, n + j AS m, sum(x * h) AS y FROM long, ph WHERE n + j <= (SELECT max(n) FROM long) GROUP BY ALL), tk AS (SELECT m // 80 AS sub, max(abs(y)) AS y FROM up GROUP BY 1),
b AS (SELECT sub, p, ms, greatest(p, y) AS t FROM (SELECT n // 80 AS sub, max(abs(x)) AS p, avg(x * x) AS ms FROM long GROUP BY 1) JOIN tk USING (sub)),
j AS (SELECT sub, momentary, short_term, max(t) OVER (o ROWS 29 PRECEDING) AS top, max(p) OVER (o ROWS 3 PRECEDING) AS shrt, avg(ms) OVER (o ROWS 3 PRECEDING) AS m FROM pt JOIN b USING (sub) WINDOW o AS (ORDER BY sub)),
ct AS (SELECT sub, round(momentary, 6) AS momentary, round(short_term, 6) AS short_term, round(CASE WHEN short_term IS NOT NULL THEN {db_sql('top')} END, 6) AS peak_db, round({db_sql('top')} - short_term, 6) AS psr_db, round(CASE WHEN momentary IS NOT NULL THEN CASE WHEN m > 0 THEN {db_sql('shrt / sqrt(m)')} ELSE 0 END END, 6) AS crest_db FROM j)"""


@query("m3_j6_contour_series", f"WITH {_CONTOUR} SELECT round((sub + 1) / 10, 6) AS seconds, * EXCLUDE (sub) FROM ct")
def _(spark, sf_dir):
    mono, points = _points(spark, sf_dir)
    return rounded(advanced.contour(points, mono, 800).drop("recording", "sub"))


@query(
    "m3_contour_points",
    f"""WITH {_CONTOUR}, f AS (SELECT max(n) + 1 AS f FROM long), g AS (SELECT k * 200 / 800.0::DOUBLE AS seconds, least(k * 200 // 80, f // 80) - 1 AS sub FROM f, range(0, f // 200 + 1) t(k))
SELECT round(seconds, 6) AS seconds, momentary, short_term, peak_db, psr_db, crest_db FROM g LEFT JOIN ct USING (sub)""",
)
def _(spark, sf_dir):
    """A point each quarter of a second, which no whole number of sub-blocks is."""
    mono, points = _points(spark, sf_dir)
    return rounded(advanced.contour_grid(advanced.contour(points, mono, 800), mono, 800, 0.25).drop("recording"))


@query(
    "m3_contour_summary",
    f"""WITH {_CONTOUR}, f AS (SELECT max(n) + 1 AS f FROM long), g AS (SELECT least(k * 200 // 80, f // 80) - 1 AS sub FROM f, range(0, f // 200 + 1) t(k)), s AS (SELECT short_term, row_number() OVER (ORDER BY short_term) - 1 AS r, count(*) OVER () AS n FROM g JOIN ct USING (sub) WHERE short_term > -70)
SELECT (SELECT count(*) FROM g) AS points, round({db_sql('(SELECT greatest(max(abs(y)), (SELECT max(abs(x)) FROM long)) FROM up)')}, 6) AS peak_db, min(short_term) AS quietest, max(short_term) AS loudest, max(CASE WHEN r = floor((n - 1) * 0.1 + 0.5) THEN short_term END) AS p10, max(CASE WHEN r = floor((n - 1) * 0.95 + 0.5) THEN short_term END) AS p95 FROM s""",
)
def _(spark, sf_dir):
    mono, points = _points(spark, sf_dir)
    grid = advanced.contour_grid(advanced.contour(points, mono, 800), mono, 800, 0.25)
    none = points.select("recording").distinct().select("recording", F.lit(None).cast("double").alias("integrated"), F.lit(None).cast("double").alias("lra"))
    return rounded(advanced.contour_summary(grid, none, filters.true_peak(mono)).select("points", "peak_db", "quietest", "loudest", "p10", "p95"))


_LEVELS = "c AS (SELECT count(*) AS f FROM line), g AS (SELECT f, k AS \"column\", (k * f + 63) // 64 AS a, ((k + 1) * f + 63) // 64 AS b, CAST(pow(2, floor(log2(f // 64 / 16))) AS BIGINT) * 16 AS w FROM c, range(64) t(k))"


@query(
    "r19_peak_columns",
    f"WITH {LINE}, {_LEVELS} SELECT 0::BIGINT AS recording, channel, \"column\", round(min(x), 6) AS min, round(max(x), 6) AS max, round(sqrt(avg(x * x)), 6) AS rms FROM g JOIN long ON n >= a // w * w AND n < ((b - 1) // w + 1) * w GROUP BY ALL",
)
def _(spark, sf_dir):
    """The whole signal in 64 columns, off one stored level."""
    stored = pyramids.peak_store(model.whole(model.long(model.line_signal(spark, sf_dir))), 16)
    return rounded(pyramids.peak_columns(stored, 0, model.table(spark, sf_dir, "lineitem").count(), 64))


@query(
    "a12_stored_levels",
    f"WITH {LINE}, l AS (SELECT unnest(range(0, CAST(ceil(log2(ceil(f / 256))) AS BIGINT) + 1)) AS level FROM (SELECT count(*)::DOUBLE AS f FROM line)) SELECT CAST(level AS INT) AS level, channel, CAST(n // 256 // CAST(pow(2, level) AS BIGINT) AS BIGINT) AS idx, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS frames FROM long, l GROUP BY ALL",
)
def _(spark, sf_dir):
    """Every stored level up to the one with a single bin."""
    stored = pyramids.peak_store(model.whole(model.long(model.line_signal(spark, sf_dir))))
    return rounded(stored.read().select("level", "channel", "idx", "min", "max", "frames"))


@query("p17_plr_psr", f"WITH {EVENT}, t AS (SELECT recording, {db_sql('max(abs(x))')} AS p, {db_sql('sqrt(avg(x * x))')} AS r, min(n) AS k FROM ev GROUP BY 1) SELECT recording, round(CASE WHEN p <= -200 OR r <= -200 THEN -200 ELSE p - r END, 6) AS plr FROM t")
def _(spark, sf_dir):
    e = model.event_signal(spark, sf_dir).groupBy("recording").agg(model.db(F.max(F.abs("x"))).alias("p"), model.db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("r"))
    return rounded(e.select("recording", statistics.peak_to_loudness(F.col("p"), F.col("r")).alias("plr")))


@query("j11_target_by_name", f"WITH t(target, lufs, ceiling, tolerance) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for n, a, b, c in statistics.TARGETS)}) SELECT w.asked, target, lufs, ceiling FROM (VALUES ('spotify'), ('EBU r128'), ('tidal'), ('none such')) w(asked) LEFT JOIN t ON lower(target) = lower(asked)")
def _(spark, sf_dir):
    asked = spark.createDataFrame([("spotify",), ("EBU r128",), ("tidal",), ("none such",)], "asked string")
    return statistics.find_targets(asked, statistics.targets(spark)).select("asked", "target", "lufs", "ceiling")


# --- tempo, key, provenance, sweep

SQL["m18_provenance"] = f"""WITH {SPEC}, s AS (SELECT CAST(floor(log2(bin * 125.0 / 500) * 16) AS BIGINT) AS step, avg(average_db) AS l FROM spec WHERE bin * 125.0 >= 500 GROUP BY 1), m AS (SELECT max(l) - 35 AS t FROM s), z AS (SELECT max(step) AS last FROM s, m WHERE l >= t),
d AS (SELECT max(CASE WHEN step = last THEN l END) - max(CASE WHEN step = last + 4 THEN l END) AS drop_db, max(last) AS last FROM s, z) SELECT round(500 * pow(2, (last + 1) / 16), 6) AS cutoff_hz, round(drop_db, 6) AS drop_db, coalesce(drop_db >= 35, false) AS steep FROM d"""
SQL["m22_sweep"] = "WITH g AS (SELECT n, least(n, 7999 - n) AS near FROM range(8000) t(n)), k AS (SELECT ln(3960.0 / 20) AS k) SELECT n, round(0.5 * sin(2 * pi() * 20 * 1 / k * (exp(n / 8000 * k) - 1)) * CASE WHEN near < 160 THEN 0.5 - 0.5 * cos(pi() * near / 160) ELSE 1 END, 6) + 0.0::DOUBLE AS x FROM g, k"
SQL["p13_cola_deviation"] = """WITH t AS (SELECT i % 512 AS slot, 1.0::DOUBLE AS r, 0.5 - 0.5 * cos(a) AS h, 0.54 - 0.46 * cos(a) AS m, 0.35875 - 0.48829 * cos(a) + 0.14128 * cos(2 * a) - 0.01168 * cos(3 * a) AS b FROM (SELECT i, 2 * pi() * i / 2048 AS a FROM range(2048) t(i))),
s AS (SELECT slot, sum(r * r) AS r, sum(h * h) AS h, sum(m * m) AS m, sum(b * b) AS b FROM t GROUP BY 1) SELECT round((max(r) - min(r)) / avg(r), 9) AS rectangular, round((max(h) - min(h)) / avg(h), 9) AS hann, round((max(m) - min(m)) / avg(m), 9) AS hamming, round((max(b) - min(b)) / avg(b), 9) AS blackman_harris FROM s"""
QCODE = "CAST(floor(greatest(0.0, least(1.0, (20 * log10(greatest(mag / 16, 1e-12)) + 120) / 120)) * 255 + 0.5) AS INT)"
SQL["p18_quantised_magnitude"] = f"WITH {DFT} SELECT frame, bin, {QCODE} AS q FROM mags"


@query("m23_inverse_sweep", "WITH g AS (SELECT n, least(n, 7999 - n) AS near FROM range(8000) t(n)), k AS (SELECT ln(3960.0 / 20) AS k), s AS (SELECT n, 0.5 * sin(2 * pi() * 20 / k * (exp(n / 8000 * k) - 1)) * CASE WHEN near < 160 THEN 0.5 - 0.5 * cos(pi() * near / 160) ELSE 1 END AS x FROM g, k) SELECT 7999 - n AS n, round(x * exp(-(7999 - n) / 8000 * k), 6) + 0.0::DOUBLE AS x FROM s, k")
def _(spark, sf_dir):
    return rounded(measure.inverse_sweep(filters.sweep(spark, RATE, 1.0), 8000, RATE, 20.0, 3960.0))


@query("m15_onset_seconds", "SELECT vec_id AS frame, round((vec_id * 256 + 1024 - 128) / 8000, 6) AS seconds FROM embeddings")
def _(spark, sf_dir):
    return rounded(model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), scalars.onset_seconds(F.col("vec_id"), RATE, 1024, 256).alias("seconds")))


ONSET = f"{EVENT}, o AS (SELECT recording, n, greatest(0, x) AS v, row_number() OVER (PARTITION BY recording ORDER BY greatest(0, x) DESC, n) AS k, count(*) OVER (PARTITION BY recording) AS c FROM ev)"


@query("a15_onset_concentration", f"WITH {ONSET} SELECT recording, round(sum(CASE WHEN k <= greatest(1, c // 10) THEN v END) / sum(v), 6) AS concentration FROM o GROUP BY recording HAVING sum(v) > 0")
def _(spark, sf_dir):
    return rounded(measure.concentration(model.event_signal(spark, sf_dir).select("recording", F.col("n").alias("frame"), F.greatest(F.lit(0.0), F.col("x")).alias("onset"))))


@query("a20_weighted_fit", f"WITH {ONSET}, m AS (SELECT recording, sum(v * k) / sum(v) AS mk, sum(v * n) / sum(v) AS mn, sum(v) AS w FROM o GROUP BY 1 HAVING sum(v) > 0) SELECT recording, round(sum(v * (k - mk) * (n - mn)) / sum(v * (k - mk) * (k - mk)), 5) AS period, round(any_value(mn) - any_value(mk) * sum(v * (k - mk) * (n - mn)) / sum(v * (k - mk) * (k - mk)), 4) AS phase FROM o JOIN m USING (recording) GROUP BY recording")
def _(spark, sf_dir):
    """Beat places against beat numbers, weighted by onset height."""
    e = model.event_signal(spark, sf_dir).withColumn("v", F.greatest(F.lit(0.0), F.col("x")))
    k = F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("v"), "n"))
    fit = measure.weighted_fit(e.select("recording", k.alias("k"), F.col("n").alias("at"), F.col("v").alias("weight")))
    return fit.select("recording", F.round("period", 5).alias("period"), F.round("phase", 4).alias("phase"))


FULLKEY = f"""{CHROMA}, tn AS (SELECT atan2(sum(mag * sin(2 * pi() * (s - round(s)))), sum(mag * cos(2 * pi() * (s - round(s))))) * 100 / (2 * pi()) AS cents FROM (SELECT mag, 69 + 12 * log2(bin * 125.0 / 440) AS s FROM mags WHERE bin > 0 AND bin * 125.0 BETWEEN 65 AND 5000)),
c12 AS (SELECT d, coalesce(weight, 0) AS w FROM range(12) t(d) LEFT JOIN ch ON d = pitch_class), ct AS (SELECT sqrt(sum(pow(w - m, 2)) / 12) / max(m) AS contrast FROM c12, (SELECT sum(w) / 12 AS m FROM c12))"""


@query("m16_key_strength", f"WITH {FULLKEY}, k AS ({SQL['j10_m16_key']}) SELECT key, round(contrast, 6) AS contrast, round(fit * least(1, contrast), 5) AS strength, round(cents, 4) AS tuning_cents, contrast >= 0.15 AND fit * least(1, contrast) >= 0.2 AS worth_naming FROM k, ct, tn")
def _(spark, sf_dir):
    out = spectral.key(spark, spectral.dft(model.frames(spark, sf_dir), 64), RATE, 64)
    return out.select("key", F.round("contrast", 6).alias("contrast"), F.round("strength", 5).alias("strength"), F.round("tuning_cents", 4).alias("tuning_cents"), "worth_naming")


# --- scalar families

_I0 = lambda x: f"list_sum(list_transform(range(0, 40), lambda k: pow(({x}) / 2, 2 * k) / pow(gamma(k + 1), 2)))"


@query(
    "p14_windowed_sinc",
    f"""WITH g AS (SELECT vec_id AS i, vec_id / 250.0::DOUBLE AS p FROM embeddings) SELECT i, round(CASE WHEN p = 0 THEN 1 ELSE sin(pi() * p) / (pi() * p) END, 6) AS sinc, round({_I0('p')}, 6) AS i0, round(CASE WHEN abs(p) <= 1 THEN {_I0('9 * sqrt(greatest(0, 1 - p * p))')} / {_I0('9.0')} ELSE 0 END, 6) AS kaiser,
round(CASE WHEN 50 * p > 50 THEN 0.1102 * (50 * p - 8.7) WHEN 50 * p >= 21 THEN 0.5842 * pow(50 * p - 21, 0.4) + 0.07886 * (50 * p - 21) ELSE 0 END, 6) AS beta, round(CASE WHEN p > 0 THEN (80 - 8.0) / (2.285 * 2 * pi() * p) ELSE 0 END, 6) AS length FROM g""",
)
def _(spark, sf_dir):
    p = F.col("vec_id") / 250.0
    return rounded(model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), scalars.sinc(p).alias("sinc"), scalars.bessel_i0(p).alias("i0"), scalars.kaiser(p, 9.0).alias("kaiser"), scalars.kaiser_beta(50 * p).alias("beta"), scalars.kaiser_length(F.lit(80.0), p).alias("length")))


@query("p1_p2_selection", f"WITH {LINE} SELECT n, round(x, 6) AS x FROM long, (SELECT count(*) AS f FROM line) WHERE channel = 1 AND n >= f // 3 AND n < least(f, 2 * f)")
def _(spark, sf_dir):
    s = model.whole(model.long(model.line_signal(spark, sf_dir)))
    frames = model.table(spark, sf_dir, "lineitem").count()
    return rounded(channels.select_channel(channels.select_range(s, frames // 3, 2 * frames), 1, 2).select("n", "x"))


@query("p4_p19_seconds_and_predicates", f"WITH {EVENT} SELECT recording, n, round(n / 44100.0::DOUBLE, 6) AS seconds, CAST(round(n / 44100.0::DOUBLE * 8000) AS BIGINT) AS there, x > 0.5 AS loud FROM ev")
def _(spark, sf_dir):
    s = scalars.seconds_of(F.col("n"), 44100.0)
    return rounded(model.event_signal(spark, sf_dir).select("recording", "n", s.alias("seconds"), scalars.samples_of(s, RATE).alias("there"), (F.col("x") > 0.5).alias("loud")))


def _stop_sql(stops, k):
    out = f"{stops[-1][k]}"
    for a, b in reversed(list(zip(stops, stops[1:]))):
        out = f"CASE WHEN v <= {b[0]} THEN {a[k]} + ({b[k]} - {a[k]}) * ((v - {a[0]}) / ({b[0]} - {a[0]})) ELSE {out} END"
    return f"CAST(round(({out})::DOUBLE * 255) AS INT)"


@query(
    "p21_colour_map",
    f"WITH g AS (SELECT vec_id AS i, round(greatest(0.0, least(1.0, vec_id / 400.0::DOUBLE)) * 255) / 255 AS v FROM embeddings) SELECT i, printf('#%02x%02x%02x', {', '.join(_stop_sql(scalars.MAGMA, k) for k in (1, 2, 3))}) AS magma, printf('#%02x%02x%02x', {', '.join(_stop_sql(scalars.VIRIDIS, k) for k in (1, 2, 3))}) AS viridis, printf('#%02x%02x%02x', CAST(round(v * 255) AS INT), CAST(round(v * 255) AS INT), CAST(round(v * 255) AS INT)) AS grey FROM g",
)
def _(spark, sf_dir):
    v = F.col("vec_id") / 400.0
    return model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), *(scalars.colour(v, k).alias(k) for k in ("magma", "viridis", "grey")))


@query("p22_axes", "WITH g AS (SELECT vec_id AS i, 20.0 + vec_id * 7.5 AS hz FROM embeddings) SELECT i, round(greatest(0, least(1, hz / 4000)), 6) AS linear, round(greatest(0, least(1, ln(greatest(hz, 20) / 20) / ln(4000 / 20))), 6) AS log, round(20 * pow(4000 / 20, greatest(0, least(1, hz / 4000))), 5) AS back FROM g")
def _(spark, sf_dir):
    hz = 20.0 + F.col("vec_id") * 7.5
    lin = scalars.fraction_of(hz, 4000.0, False)
    return model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.round(lin, 6).alias("linear"), F.round(scalars.fraction_of(hz, 4000.0, True), 6).alias("log"), F.round(scalars.frequency_at(lin, 4000.0, True), 5).alias("back"))


@query(
    "k4_container_choice",
    """WITH c AS (SELECT o_orderkey AS id, 'out/' || o_orderkey || CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '.wav' WHEN 1 THEN '.AIFF' WHEN 2 THEN '.flac' WHEN 3 THEN '.mp3' ELSE '' END AS path, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 24 ELSE 32 END AS bits FROM orders),
k AS (SELECT *, CASE WHEN lower(path) LIKE '%.aiff' THEN 'aiff' WHEN lower(path) LIKE '%.flac' THEN 'flac' ELSE 'wav' END AS container FROM c) SELECT id, container, CASE WHEN (container = 'flac' AND bits IN (16, 24)) OR (container = 'aiff' AND bits IN (16, 24, 32)) OR container = 'wav' THEN bits ELSE 24 END AS bits FROM k""",
)
def _(spark, sf_dir):
    o, k = model.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("out/"), k.cast("string"), F.when(k % 5 == 0, ".wav").when(k % 5 == 1, ".AIFF").when(k % 5 == 2, ".flac").when(k % 5 == 3, ".mp3").otherwise(""))
    bits = F.when(k % 4 == 0, 8).when(k % 4 == 1, 16).when(k % 4 == 2, 24).otherwise(32)
    return o.select(k.alias("id"), scalars.container_of(path, bits).alias("c")).select("id", "c.container", "c.bits")


@query(
    "m25_readings",
    f"""WITH {EVENT}, t AS (SELECT recording, avg(abs(x)) AS a, max(x) AS m, count(*) AS c FROM ev GROUP BY 1) SELECT recording, CASE WHEN a < 0.15 OR a * m < 0.2 THEN 'no key' ELSE 'C major' END AS key, CASE WHEN a < 0.15 OR a * m < 0.2 THEN 'none' WHEN a * m < 0.5 OR abs(c - 60) > 25 THEN 'doubtful' ELSE 'firm' END AS key_certainty,
CASE WHEN c > 60 THEN printf('%.1f BPM', c::DOUBLE) ELSE 'no tempo' END AS tempo, CASE WHEN c <= 60 THEN 'none' WHEN a < 0.35 THEN 'doubtful' ELSE 'firm' END AS tempo_certainty FROM t""",
)
def _(spark, sf_dir):
    t = model.event_signal(spark, sf_dir).groupBy("recording").agg(F.avg(F.abs("x")).alias("a"), F.max("x").alias("m"), F.count("*").alias("c"))
    key = scalars.key_reading(F.lit("C major"), F.col("a"), F.col("a") * F.col("m"), F.col("c") - 60)
    tempo = scalars.tempo_reading(F.col("c") > 60, F.col("c").cast("double"), F.col("a"))
    return t.select("recording", key.alias("k"), tempo.alias("t")).select("recording", F.col("k.value").alias("key"), F.col("k.certainty").alias("key_certainty"), F.col("t.value").alias("tempo"), F.col("t.certainty").alias("tempo_certainty"))


# --- spectrogram views and stores

VIEW = f"{DFT}, q AS MATERIALIZED (SELECT frame, bin, {QCODE} AS q FROM mags), fr0 AS (SELECT count(DISTINCT frame) AS f FROM q)"


@query("r16_spectrogram_view", f"WITH {VIEW}, e AS (SELECT r, r * 33 // 16 AS a, greatest(r * 33 // 16 + 1, ((r + 1) * 33 + 15) // 16) AS b FROM range(16) t(r)) SELECT CAST(frame * 40 // f AS BIGINT) AS \"column\", CAST(r AS INT) AS \"row\", max(q) AS q FROM q, fr0, e WHERE bin >= a AND bin < b GROUP BY ALL")
def _(spark, sf_dir):
    q = spectral.quantised(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    return tiles.view(q, model.table(spark, sf_dir, "embeddings").count(), 33, 40, 16)


@query(
    "r16_spectrogram_zoomed",
    f"""WITH {VIEW}, g AS (SELECT r, (r + 0.5) * 33 / 80 - 0.5 AS p FROM range(80) t(r)), h AS (SELECT r, greatest(0, least(32, CAST(floor(p) AS INT))) AS a, greatest(0, least(32, CAST(floor(p) AS INT) + 1)) AS b, p - floor(p) AS w FROM g)
SELECT CAST(x.frame * 40 // f AS BIGINT) AS "column", CAST(r AS INT) AS "row", max(CAST(floor(x.q * (1 - w) + y.q * w + 0.5) AS INT)) AS q FROM h JOIN q x ON x.bin = a JOIN q y ON y.bin = b AND y.frame = x.frame, fr0 GROUP BY ALL""",
)
def _(spark, sf_dir):
    q = spectral.quantised(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    return tiles.view(q, model.table(spark, sf_dir, "embeddings").count(), 33, 40, 80)


@query(
    "r16_overview",
    f"""WITH {VIEW}, g AS (SELECT f, k AS c, (k * f + 19) // 20 AS a, ((k + 1) * f + 19) // 20 AS b, CAST(pow(2, floor(log2(f // 20))) AS BIGINT) AS w FROM fr0, range(20) t(k)), e AS (SELECT r, r * 33 // 16 AS a, greatest(r * 33 // 16 + 1, ((r + 1) * 33 + 15) // 16) AS b FROM range(16) t(r))
SELECT c AS "column", CAST(r AS INT) AS "row", max(q) AS q FROM g JOIN q ON frame >= g.a // w * w AND frame < ((g.b - 1) // w + 1) * w JOIN e ON bin >= e.a AND bin < e.b GROUP BY ALL""",
)
def _(spark, sf_dir):
    """All frames in 20 columns, off one stored level of the fold."""
    q = spectral.quantised(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    return tiles.overview_view(tiles.overview(q), 0, model.table(spark, sf_dir, "embeddings").count(), 33, 20, 16)


@query("r17_tiles", f"WITH {VIEW} SELECT frame // 64 AS tile, CAST(count(DISTINCT frame) AS BIGINT) AS frames, max(q) AS loudest, CAST(sum(q) AS BIGINT) AS total FROM q GROUP BY 1")
def _(spark, sf_dir):
    """Tiles are written and read back; a tile's rows come from its own partition."""
    q = spectral.quantised(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    back = tiles.write(q, 64)
    return back.groupBy("tile").agg(F.countDistinct("frame").alias("frames"), F.max("q").alias("loudest"), F.sum("q").alias("total"))


@query("r18_store_keys", f"WITH {EVENT} SELECT recording, sha256('tiles:1|8000|1|' || count(*) || '|0:' || sha256(string_agg(CAST(CAST(round(x * 32768) AS BIGINT) AS VARCHAR), ',' ORDER BY n))) AS key FROM ev GROUP BY recording")
def _(spark, sf_dir):
    return tiles.source_keys(model.event_signal(spark, sf_dir), 8000, 1)


@query(
    "r18_sampled_key",
    f"WITH {LINE}, f AS (SELECT count(*) AS f FROM line), p AS (SELECT DISTINCT CASE WHEN f > 17408 THEN CAST(floor(k * (f - 1024) / 16) AS BIGINT) ELSE k * 1024 END AS s FROM f, range(17) t(k) WHERE f > 17408 OR k * 1024 < f), b AS (SELECT s, sha256(string_agg(CAST(CAST(round(l * 32768) AS BIGINT) AS VARCHAR), ',' ORDER BY n)) AS h FROM p JOIN line ON n >= s AND n < s + 1024 GROUP BY s) SELECT 0::BIGINT AS recording, sha256('tiles:1|8000|1|' || (SELECT f FROM f) || '|' || string_agg(s || ':' || h, ',' ORDER BY s)) AS key FROM b",
)
def _(spark, sf_dir):
    """A recording of many blocks: its key comes from seventeen of them (all of them where it is short)."""
    return tiles.source_keys(model.line_signal(spark, sf_dir).select(F.lit(0).cast("long").alias("recording"), "n", F.col("l").alias("x")), 8000, 1)


@query("r18_store_check", f"WITH {VIEW} SELECT frame, CAST(sum(q) AS BIGINT) AS total FROM q WHERE frame % 50 <> 0 GROUP BY frame")
def _(spark, sf_dir):
    """Every fiftieth entry is damaged in the store; reading throws those away and keeps the rest."""
    q = spectral.quantised(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    entries = tiles.pack(q)
    bad = entries.withColumn("payload", F.when(F.col("frame") % 50 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return tiles.unpack(tiles.sound(bad)).groupBy("frame").agg(F.sum("q").alias("total"))


@query("o8_evict_least_recent", "WITH c AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) + 1 AS bytes, sum(CAST(floor(value * 100) AS BIGINT) + 1) OVER (ORDER BY ts DESC, event_id DESC) AS upto FROM events), t AS (SELECT sum(bytes) // 3 AS b FROM c) SELECT event_id, bytes FROM c, t WHERE upto <= b")
def _(spark, sf_dir):
    e = model.table(spark, sf_dir, "events").select("event_id", "ts", (F.floor(F.col("value") * 100) + 1).cast("long").alias("bytes"))
    budget = e.agg(F.sum("bytes")).first()[0] // 3
    return tiles.keep_recent(e, budget, ["ts", "event_id"]).select("event_id", "bytes")


@query("t4_sliding_windows", "SELECT CAST(s AS BIGINT) AS start, event_type, count(*) AS c, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) - 900 * k FOR k IN range(4)]) AS s FROM events) GROUP BY 1, 2")
def _(spark, sf_dir):
    """An hour's window every quarter of an hour."""
    e = model.table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("c"), F.sum("value").alias("total"))
    return rounded(w.select(F.unix_timestamp("w.start").alias("start"), "event_type", "c", "total"), 4)


@query("o6_prefix_caps", f"WITH {LINE}, c AS (SELECT least(count(*), 120 * 8) AS k FROM line) SELECT channel, count(*) AS frames, round(sum(x * x), 4) AS energy FROM long, c WHERE n < k GROUP BY channel")
def _(spark, sf_dir):
    """The verbs that listen to the first 120 seconds (here at 8 Hz) cut before framing."""
    s = channels.first_seconds(model.long(model.line_signal(spark, sf_dir)), 120.0, 8.0)
    return rounded(s.groupBy("channel").agg(F.count("*").alias("frames"), F.sum(F.col("x") * F.col("x")).alias("energy")), 4)
