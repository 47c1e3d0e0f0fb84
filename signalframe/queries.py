"""The registered queries over the driver's tables and their SQL.  Doubles are rounded where sums may come in any order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import channels, loudness, measure, pyramids, spectral, statistics, timeline

QUERIES: dict = {}
SQL: dict = {}

LINE = """line AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS n, (l_discount - 0.05) * 10 AS l, (l_tax - 0.04) * 12.5 AS r FROM lineitem),
long AS (SELECT n, 0 AS channel, l AS x FROM line UNION ALL SELECT n, 1, r FROM line)"""
EVENT = "ev AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, (value - 250) / 250 AS x FROM events)"
CLIPS = "clips AS (SELECT o_orderkey AS clip_id, o_custkey AS source_id, (row_number() OVER (ORDER BY o_orderkey) - 1) * 37 AS timeline_start, 50 + o_orderkey % 100 AS length, 1 + (o_custkey % 5) / 10.0 AS gain FROM orders)"
DFT = """w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w FROM range(64) t(i)), fr AS (SELECT vec_id AS frame, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
mags AS (SELECT frame, bin, sqrt(re * re + im * im) AS mag FROM (SELECT frame, bin, sum(x * w * cos(2 * pi() * ((fr.i * bin) % 64) / 64)) AS re, sum(x * w * sin(2 * pi() * ((fr.i * bin) % 64) / 64)) AS im FROM fr JOIN w ON fr.i = w.i, range(33) b(bin) GROUP BY frame, bin))"""


def db_sql(x: str, k: int = 20) -> str:
    return f"(CASE WHEN {x} > 0 THEN greatest(-200.0, {k} * log10({x})) ELSE -200.0 END)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def _line(spark, sf_dir) -> DataFrame:
    return model.line_signal(spark, sf_dir)


STATS = f"""ch AS (SELECT channel, max(abs(x)) AS peak, sum(x * x) AS sq, avg(x) AS mean, count(*) AS c FROM long GROUP BY channel),
st AS (SELECT max(c) AS frames, {db_sql('max(peak)')} AS peak_db, {db_sql('sqrt(sum(sq) / sum(c))')} AS rms_db, arg_max(mean, abs(mean)) AS dc, {db_sql('max(peak) / sqrt(sum(sq) / sum(c))')} AS crest FROM ch)"""


@query("a1_signal_statistics", f"WITH {LINE}, {STATS} SELECT frames, round(peak_db, 6) AS sample_peak_db, round(rms_db, 6) AS rms_db, round(dc, 6) AS dc_offset, round(crest, 6) AS crest_db FROM st")
def _(spark, sf_dir):
    return rounded(statistics.signal_statistics(model.long(model.line_values(spark, sf_dir))))


_T = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in statistics.TARGETS)


@query(
    "a1_p16_statistics_compliance",
    f"""WITH {LINE}, {STATS}, t(target, lufs, ceiling, tolerance) AS (VALUES {_T})
SELECT round(rms_db, 6) AS lufs_in, round(peak_db, 6) AS peak_in, target, round(rms_db - lufs, 6) AS deviation_lu, round(ceiling - peak_db, 6) AS margin_db, abs(rms_db - lufs) <= tolerance AS on_target, ceiling - peak_db >= 0 AS within_ceiling,
round(lufs - rms_db, 6) AS gain_to_target, round(least(lufs - rms_db, ceiling - peak_db), 6) AS conform_gain FROM st, t""",
)
def _(spark, sf_dir):
    s = statistics.signal_statistics(model.long(model.line_values(spark, sf_dir))).select(F.col("rms_db").alias("lufs_in"), F.col("sample_peak_db").alias("peak_in"))
    return rounded(statistics.compliance(s, statistics.targets(spark)))


@query(
    "a2_stereo_field",
    f"""WITH {LINE}, t AS (SELECT sum(l * l) AS ll, sum(r * r) AS rr, sum(l * r) AS lr, sum((l + r) * (l + r)) / 4 AS mm, sum((l - r) * (l - r)) / 4 AS ss FROM line)
SELECT round(lr / sqrt(ll * rr), 6) AS correlation, round(10 * log10(ss / mm), 6) AS width_db, round(10 * log10(rr / ll), 6) AS balance_db, round(10 * log10(mm / ((ll + rr) / 2)), 6) AS mono_loss_db FROM t""",
)
def _(spark, sf_dir):
    return rounded(statistics.stereo_field(model.line_values(spark, sf_dir)))


@query("a4_effective_bits", f"WITH {LINE}, u AS (SELECT bit_or(CAST(abs(round(greatest(-1.0, least(1.0, x)) * 8388608)) AS BIGINT)) AS v FROM long) SELECT CAST(CASE WHEN v = 0 THEN 0 ELSE 24 - bit_count((v & -v) - 1) END AS INT) AS effective_bits FROM u")
def _(spark, sf_dir):
    return statistics.effective_bits(model.long(model.line_values(spark, sf_dir)))


@query("p5_p7_channel_edits", f"WITH {LINE}, c AS (SELECT count(*) AS f FROM line) SELECT f - 1 - n AS n, CAST(1 - channel AS INT) AS channel, round(-x, 6) + 0.0::DOUBLE AS x FROM long, c")
def _(spark, sf_dir):
    s = model.long(_line(spark, sf_dir))
    frames = model.table(spark, sf_dir, "lineitem").count()
    return rounded(channels.swap(channels.invert(channels.reverse(s, frames))))


@query("p8_sum_to_mono", f"WITH {LINE} SELECT n, round(0.5 * (l + r), 6) AS l, round(0.5 * (l + r), 6) AS r FROM line")
def _(spark, sf_dir):
    return rounded(channels.mono(_line(spark, sf_dir)))


@query("p3_p17_decibels", f"WITH {EVENT} SELECT recording, n, round({db_sql('x')}, 6) AS level_db, round({db_sql('abs(x)')}, 6) AS abs_db FROM ev")
def _(spark, sf_dir):
    return rounded(model.event_signal(spark, sf_dir).select("recording", "n", model.db(F.col("x")).alias("level_db"), model.db(F.abs("x")).alias("abs_db")))


@query(
    "p10_fade_curves",
    "SELECT i, round(t, 6) AS linear, round(sin(t * pi() / 2), 6) AS equal_power, round(sqrt(t), 6) AS logarithmic, round(t * t, 6) AS exponential, round(t * t * (3 - 2 * t), 6) AS s_curve FROM (SELECT vec_id AS i, vec_id / 100.0 AS v, greatest(0.0, least(1.0, vec_id / 100.0)) AS t FROM embeddings)",
)
def _(spark, sf_dir):
    t = F.col("vec_id") / 100.0
    return rounded(model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), *(channels.fade(s, t).alias(s) for s in channels.SHAPES)))


@query(
    "p12_tapers",
    "SELECT i, 1.0::DOUBLE AS rectangular, round(0.5 - 0.5 * cos(a), 9) AS hann, round(0.54 - 0.46 * cos(a), 9) AS hamming, round(0.35875 - 0.48829 * cos(a) + 0.14128 * cos(2 * a) - 0.01168 * cos(3 * a), 9) AS blackman_harris FROM (SELECT i, 2 * pi() * i / 512 AS a FROM range(512) t(i))",
)
def _(spark, sf_dir):
    return rounded(channels.tapers(spark, 512), 9)


@query("p13_cola_deviation")
def _(spark, sf_dir):
    return rounded(channels.cola_deviation(spark, 2048, 512), 9)


@query("p15_k5_quantise", f"WITH {LINE} SELECT channel, v, count(*) AS c FROM (SELECT channel, greatest(-128, least(127, CAST(round(round(x, 6) * 128) AS BIGINT))) AS v FROM long) GROUP BY channel, v")
def _(spark, sf_dir):
    return model.long(model.line_values(spark, sf_dir)).groupBy("channel", channels.quantise(F.round("x", 6), 8).alias("v")).agg(F.count("*").alias("c"))


@query(
    "a12_peak_pyramid",
    f"""WITH {LINE}, b AS (SELECT channel, lv AS level, (n // 256) >> lv AS idx, x FROM long, range(4) t(lv))
SELECT CAST(channel AS INT) AS channel, CAST(level AS INT) AS level, idx, round(min(x), 6) AS min, round(max(x), 6) AS max, round(sqrt(avg(x * x)), 6) AS rms, count(*) AS frames FROM b GROUP BY ALL""",
)
def _(spark, sf_dir):
    return rounded(pyramids.peak_pyramid(model.long(_line(spark, sf_dir))))


@query("r19_peak_query", f"WITH {LINE}, c AS (SELECT count(*) AS f FROM line) SELECT channel, n * 64 // f AS \"column\", round(min(x), 6) AS min, round(max(x), 6) AS max, round(sqrt(avg(x * x)), 6) AS rms FROM long, c GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(pyramids.peak_query(model.long(_line(spark, sf_dir)), 0, model.table(spark, sf_dir, "lineitem").count(), 64))


@query(
    "w7_runs",
    f"WITH {EVENT}, h AS (SELECT *, n - row_number() OVER (PARTITION BY recording ORDER BY n) AS island FROM ev WHERE x > -0.9) SELECT recording, min(n) AS start, count(*) AS length, round(max(abs(x)), 6) AS peak FROM h GROUP BY recording, island HAVING count(*) >= 2",
)
def _(spark, sf_dir):
    return rounded(pyramids.runs(model.event_signal(spark, sf_dir), F.col("x") > -0.9, 2))


SUBS = f"""{LINE}, sb AS (SELECT channel, n // 80 AS sub, sum(x * x) AS sq, count(*) AS c FROM long GROUP BY ALL HAVING count(*) = 80), e AS (SELECT sub, sum(sq) / 80 AS e FROM sb GROUP BY sub),
se AS (SELECT sub, CASE WHEN row_number() OVER o >= 4 THEN sum(e) OVER (o ROWS 3 PRECEDING) / 4 END AS me, CASE WHEN row_number() OVER o >= 30 THEN sum(e) OVER (o ROWS 29 PRECEDING) / 30 END AS s3 FROM e WINDOW o AS (ORDER BY sub)),
pt AS (SELECT sub, me, -0.691 + 10 * log10(me) AS momentary, -0.691 + 10 * log10(s3) AS short_term FROM se)"""


def _mono(spark, sf_dir):
    return model.long(_line(spark, sf_dir)).withColumn("recording", F.lit(0).cast("long"))


@query("w1_w2_loudness_series", f"WITH {SUBS} SELECT sub, round(momentary, 6) AS momentary, round(short_term, 6) AS short_term FROM pt")
def _(spark, sf_dir):
    return rounded(loudness.series(loudness.sub_blocks(_mono(spark, sf_dir), 800, weighted=False), 800).select("sub", "momentary", "short_term"))


@query(
    "a5_a7_gated_loudness",
    f"""WITH {SUBS}, bins AS (SELECT least(CAST(floor((momentary + 70) / 0.1) AS INT), 999) AS bin, count(*) AS c, sum(me) AS e FROM pt WHERE momentary > -70 GROUP BY 1), g AS (SELECT -10.691 + 10 * log10(sum(e) / sum(c)) AS gate FROM bins)
SELECT round(-0.691 + 10 * log10(sum(e) / sum(c)), 6) AS integrated, CAST(sum(c) AS BIGINT) AS gated_blocks FROM bins, g WHERE (bin + 0.5) * 0.1 - 70 > gate""",
)
def _(spark, sf_dir):
    points = loudness.series(loudness.sub_blocks(_mono(spark, sf_dir), 800, weighted=False), 800)
    return rounded(loudness.integrated(points).drop("recording"))


@query("m2_k_weighted_programme")
def _(spark, sf_dir):
    return rounded(loudness.programme(_mono(spark, sf_dir), model.RATE))


@query("m8_dft_frames", f"WITH {DFT} SELECT frame, bin, round(mag, 6) AS mag FROM mags")
def _(spark, sf_dir):
    return rounded(spectral.dft(model.frames(spark, sf_dir), 64).select("frame", "bin", "mag"))


SPEC = f"""{DFT}, spec AS (SELECT bin, {db_sql('avg(mag) * 2 / 32')} AS average_db, {db_sql('max(mag) * 2 / 32')} AS peak_db FROM mags GROUP BY bin)"""


@query("m8_average_spectrum", f"WITH {SPEC} SELECT bin, round(average_db, 6) AS average_db, round(peak_db, 6) AS peak_db FROM spec")
def _(spark, sf_dir):
    return rounded(spectral.average_spectrum(spectral.dft(model.frames(spark, sf_dir), 64), 64))


_B = ", ".join(f"({c})" for c in spectral.OCTAVES)


@query(
    "m9_octave_bands",
    f"""WITH {SPEC}, lay AS (SELECT c AS centre, c / sqrt(2) AS low, c * sqrt(2) AS high FROM (VALUES {_B}) t(c) WHERE c * sqrt(2) <= 4000), s AS (SELECT bin, bin * 8000.0 / 64 AS hz, pow(10, average_db / 10) AS p FROM spec),
i AS (SELECT centre, sum(p) AS p FROM lay JOIN s ON hz >= low AND hz < high GROUP BY centre)
SELECT lay.centre, round(low, 6) AS low, round(high, 6) AS high, round(10 * log10(greatest(coalesce(i.p, s.p, 0) / 1.5, 1e-30)), 6) AS level_db FROM lay LEFT JOIN i USING (centre) LEFT JOIN s ON s.bin = CAST(round(lay.centre * 64 / 8000) AS BIGINT)""",
)
def _(spark, sf_dir):
    spec = spectral.average_spectrum(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    return rounded(spectral.bands(spec, spark, 8000.0, 64))


CHROMA = f"""{DFT}, cf AS (SELECT ((CAST(round(69 + 12 * log2(bin * 8000.0 / 64 / 440)) AS INT) % 12) + 12) % 12 AS pitch_class, sum(mag) AS m FROM mags WHERE bin > 0 AND bin * 8000.0 / 64 BETWEEN 65 AND 5000 GROUP BY 1), ch AS (SELECT pitch_class, m / sum(m) OVER () AS weight FROM cf)"""


@query("a14_chroma", f"WITH {CHROMA} SELECT CAST(pitch_class AS INT) AS pitch_class, round(weight, 6) AS weight FROM ch")
def _(spark, sf_dir):
    return rounded(spectral.chroma(spectral.dft(model.frames(spark, sf_dir), 64), 8000.0, 64))


_P = ", ".join(f"({t}, {m}, '{spectral.NAMES[t]} {('major', 'minor')[m]}', {d}, {(spectral.MAJOR, spectral.MINOR)[m][(d - t) % 12]})" for t in range(12) for m in (0, 1) for d in range(12))


@query(
    "j10_m16_key",
    f"""WITH {CHROMA}, pr(tonic, mode, name, d, p) AS (VALUES {_P}), j AS (SELECT tonic, mode, name, p::DOUBLE AS p, coalesce(weight, 0) AS c FROM pr LEFT JOIN ch ON d = pitch_class),
f AS (SELECT tonic, mode, name, corr(p, c) AS fit FROM j GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY round(fit, 9) DESC, tonic, mode) AS k FROM f)
SELECT max(name) FILTER (k = 1) AS key, round(max(fit) FILTER (k = 1), 6) AS fit, max(name) FILTER (k = 2) AS runner_up, round(max(fit) FILTER (k = 1) - max(fit) FILTER (k = 2), 6) AS margin FROM r""",
)
def _(spark, sf_dir):
    folded = spectral.chroma(spectral.dft(model.frames(spark, sf_dir), 64), 8000.0, 64)
    return rounded(spectral.best_key(spectral.key_scores(spark, folded)))


@query(
    "w5_m13_onset_envelope",
    f"""WITH {DFT}, v AS (SELECT frame, bin, ln(1 + 1000 * greatest(mag, 1e-3 * max(mag) OVER (PARTITION BY frame))) AS v FROM mags), d AS (SELECT frame, greatest(0, v - lag(v) OVER (PARTITION BY bin ORDER BY frame)) AS rise, lag(v) OVER (PARTITION BY bin ORDER BY frame) AS before FROM v)
SELECT frame, round(coalesce(sum(CASE WHEN before IS NULL THEN 0 ELSE rise END), 0), 6) AS onset FROM d GROUP BY frame""",
)
def _(spark, sf_dir):
    return rounded(spectral.onset_envelope(spectral.dft(model.frames(spark, sf_dir), 64)))


@query("p18_quantised_magnitude")
def _(spark, sf_dir):
    return spectral.quantised(spectral.dft(model.frames(spark, sf_dir), 64), 64)


@query("a13_magnitude_fold", f"WITH {DFT} SELECT CAST(lv AS INT) AS level, frame >> lv AS frame, bin, round(max(mag), 6) AS mag FROM mags, range(4) t(lv) GROUP BY ALL")
def _(spark, sf_dir):
    return rounded(pyramids.magnitude_fold(spectral.dft(model.frames(spark, sf_dir), 64).select("frame", "bin", "mag")))


@query("a18_noise_profile", f"WITH {DFT} SELECT bin, round(avg(mag), 6) AS noise FROM mags GROUP BY bin")
def _(spark, sf_dir):
    return rounded(spectral.noise_profile(spectral.dft(model.frames(spark, sf_dir), 64)))


@query("r6_denoise_gain", f"WITH {DFT}, p AS (SELECT bin, avg(mag) * 1.5 AS n FROM mags GROUP BY bin) SELECT frame, bin, round(greatest(greatest(0, mag * mag - n * n) / (greatest(0, mag * mag - n * n) + n * n), pow(10, -0.6)), 6) AS gain FROM mags JOIN p USING (bin)")
def _(spark, sf_dir):
    mags = spectral.dft(model.frames(spark, sf_dir), 64)
    return rounded(spectral.denoise_gain(mags, spectral.noise_profile(mags)))


@query(
    "j2_clips_in_blocks",
    f"WITH {CLIPS}, b AS (SELECT block FROM range(0, (SELECT max(timeline_start + length) // 4096 + 1 FROM clips)) t(block)) SELECT block, count(*) AS clips, round(sum(gain), 6) AS gain FROM clips JOIN b ON timeline_start < (block + 1) * 4096 AND timeline_start + length > block * 4096 GROUP BY block",
)
def _(spark, sf_dir):
    clips = model.clips(spark, sf_dir)
    last = clips.agg(F.max(F.col("timeline_start") + F.col("length"))).first()[0] or 0
    j = timeline.overlapping(clips, spark.range(last // 4096 + 1).withColumnRenamed("id", "block"), 4096)
    return rounded(j.groupBy("block").agg(F.count("*").alias("clips"), F.sum("gain").alias("gain")))


RENDER = f"""{CLIPS}, {EVENT}, src AS (SELECT recording AS source_id, n, x FROM ev)"""


def _sources(spark, sf_dir):
    return model.event_signal(spark, sf_dir).select(F.col("recording").alias("source_id"), "n", "x")


@query(
    "j1_j3_render",
    f"""WITH {RENDER}, p AS (SELECT timeline_start + s.n AS n, sum(gain * x) AS x FROM clips JOIN src s USING (source_id) WHERE s.n < length GROUP BY 1)
SELECT g.n, round(coalesce(x, 0), 6) AS x FROM range(0, (SELECT max(timeline_start + length) FROM clips)) g(n) LEFT JOIN p ON p.n = g.n""",
)
def _(spark, sf_dir):
    clips = model.clips(spark, sf_dir).withColumn("source_start", F.lit(0).cast("long"))
    return rounded(timeline.render(clips, _sources(spark, sf_dir), 0, timeline.duration(clips)))


@query("j12_missing_sources", f"WITH {RENDER} SELECT clip_id, source_id FROM clips WHERE source_id NOT IN (SELECT source_id FROM src)")
def _(spark, sf_dir):
    return model.clips(spark, sf_dir).join(_sources(spark, sf_dir), "source_id", "left_anti").select("clip_id", "source_id")


@query(
    "e2_split_clips",
    f"""WITH {CLIPS} SELECT clip_id, timeline_start, 0::BIGINT AS source_start, CASE WHEN timeline_start < 5000 AND timeline_start + length > 5000 THEN 5000 - timeline_start ELSE length END AS length, CAST(0 AS INT) AS part FROM clips
UNION ALL SELECT clip_id, 5000, 5000 - timeline_start, timeline_start + length - 5000, 1 FROM clips WHERE timeline_start < 5000 AND timeline_start + length > 5000""",
)
def _(spark, sf_dir):
    clips = model.clips(spark, sf_dir).withColumn("source_start", F.lit(0).cast("long"))
    return timeline.split_at(clips, 5000).drop("gain", "source_id")


@query(
    "e6_delete_range",
    f"""WITH {CLIPS}, c AS (SELECT *, timeline_start + length AS e FROM clips) SELECT clip_id, timeline_start, 0::BIGINT AS source_start, least(e, 4000) - timeline_start AS length, CAST(0 AS INT) AS part FROM c WHERE timeline_start < 4000
UNION ALL SELECT clip_id, greatest(timeline_start, 6000) - 2000, greatest(timeline_start, 6000) - timeline_start, e - greatest(timeline_start, 6000), 1 FROM c WHERE e > 6000""",
)
def _(spark, sf_dir):
    clips = model.clips(spark, sf_dir).withColumn("source_start", F.lit(0).cast("long"))
    return timeline.delete_range(clips, 4000, 6000).drop("gain", "source_id")


@query(
    "e7_insert_silence",
    f"""WITH {CLIPS}, s AS (SELECT clip_id, timeline_start, CASE WHEN timeline_start < 5000 AND timeline_start + length > 5000 THEN 5000 - timeline_start ELSE length END AS length FROM clips
UNION ALL SELECT clip_id, 5000, timeline_start + length - 5000 FROM clips WHERE timeline_start < 5000 AND timeline_start + length > 5000) SELECT clip_id, CASE WHEN timeline_start >= 5000 THEN timeline_start + 800 ELSE timeline_start END AS timeline_start, length FROM s""",
)
def _(spark, sf_dir):
    clips = model.clips(spark, sf_dir).withColumn("source_start", F.lit(0).cast("long"))
    return timeline.insert_silence(clips, 5000, 800).select("clip_id", "timeline_start", "length")


@query("o1_clip_order", f"WITH {CLIPS} SELECT clip_id, row_number() OVER (PARTITION BY source_id ORDER BY timeline_start, clip_id) AS place, source_id FROM clips")
def _(spark, sf_dir):
    from pyspark.sql import Window

    c = model.clips(spark, sf_dir)
    return c.select("clip_id", F.row_number().over(Window.partitionBy("source_id").orderBy("timeline_start", "clip_id")).cast("long").alias("place"), "source_id")


@query(
    "j7_m17_residual",
    f"""WITH {EVENT}, j AS (SELECT a.recording, a.x, b.x AS y FROM ev a JOIN ev b ON a.recording = b.recording AND a.n = b.n - 1), t AS (SELECT recording, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * x) AS xx, count(*) AS frames FROM j GROUP BY recording)
SELECT recording, frames, round(xy / yy, 6) AS gain, round({db_sql('(xx - xy * xy / yy) / xx', 10)}, 5) AS residual_db FROM t""",
)
def _(spark, sf_dir):
    e = model.event_signal(spark, sf_dir)
    r = measure.residual(e, e, 1)
    return r.select("recording", "frames", F.round("gain", 6).alias("gain"), F.round("residual_db", 5).alias("residual_db"))


@query("m17_null_test")
def _(spark, sf_dir):
    e = model.event_signal(spark, sf_dir)
    return rounded(measure.null_test(e, e.select("recording", (F.col("n") + 3).alias("n"), (F.col("x") * -0.5).alias("x"))))


@query(
    "w6_m21_schroeder",
    f"WITH {EVENT}, s AS (SELECT recording, n, sum(x * x) OVER (PARTITION BY recording ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, sum(x * x) OVER (PARTITION BY recording) AS a FROM ev) SELECT recording, n, round({db_sql('l / a', 10)}, 6) + 0.0::DOUBLE AS level_db FROM s",
)
def _(spark, sf_dir):
    return rounded(measure.schroeder(model.event_signal(spark, sf_dir)))


@query(
    "a21_decay_time",
    f"""WITH {EVENT}, s AS (SELECT recording, n, sum(x * x) OVER (PARTITION BY recording ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, sum(x * x) OVER (PARTITION BY recording) AS a FROM ev), c AS (SELECT recording, n / 8000.0 AS t, {db_sql('l / a', 10)} AS y FROM s)
SELECT recording, round(CASE WHEN regr_slope(y, t) < 0 THEN -60 / regr_slope(y, t) END, 6) AS seconds FROM c WHERE y <= -1 AND y >= -10 GROUP BY recording""",
)
def _(spark, sf_dir):
    return rounded(measure.decay_time(measure.schroeder(model.event_signal(spark, sf_dir)), 8000.0, -1, -10))


@query(
    "a17_clarity",
    f"""WITH {EVENT}, t AS (SELECT recording, sum(CASE WHEN n < 25 THEN x * x ELSE 0 END) AS e5, sum(CASE WHEN n < 40 THEN x * x ELSE 0 END) AS e8, sum(x * x) AS a, sum(x * x * n / 500.0) AS m FROM ev GROUP BY recording)
SELECT recording, round(10 * log10(e5 / (a - e5)), 6) AS c50_db, round(10 * log10(e8 / (a - e8)), 6) AS c80_db, round(e5 / a, 6) AS d50, round(m / a, 6) AS centre_time FROM t""",
)
def _(spark, sf_dir):
    return rounded(measure.clarity(model.event_signal(spark, sf_dir), 500.0))


@query("m11_pitch_track")
def _(spark, sf_dir):
    f = model.frames(spark, sf_dir).select(F.lit(0).cast("long").alias("recording"), "frame", "samples")
    return rounded(measure.track_pitch(f, 8000.0, 64, low=300.0, high=2000.0))


@query(
    "a10_upper_median",
    f"WITH {EVENT}, o AS (SELECT recording, x, row_number() OVER (PARTITION BY recording ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY recording) AS c FROM ev) SELECT recording, round(max(CASE WHEN k = c // 2 THEN x END), 6) AS median, round(max(CASE WHEN k = CAST(floor((c - 1) * 0.95 + 0.5) AS INT) THEN x END), 6) AS p95 FROM o GROUP BY recording",
)
def _(spark, sf_dir):
    s = model.event_signal(spark, sf_dir).groupBy("recording").agg(F.sort_array(F.collect_list("x")).alias("s"))
    n = F.size("s")
    return rounded(s.select("recording", F.get("s", F.floor(n / 2).cast("int")).alias("median"), F.get("s", F.floor((n - 1) * 0.95 + 0.5).cast("int")).alias("p95")))


@query("t4_event_windows", "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS c, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("c"), F.sum("value").alias("total"))
    return rounded(w.select(F.unix_timestamp("w.start").alias("start"), "event_type", "c", "total"), 4)


TWO_PI = 2 * math.pi


# --- filters, dynamics, repair, containers: state or transforms beyond SQL; known answers are in tests/


def _users(spark, sf_dir):
    return model.event_signal(spark, sf_dir).withColumn("channel", F.lit(0))


def _sections() -> dict[str, tuple]:
    from .operators import filters

    return {k: filters.design(k, 8000.0, 1000.0, 0.9, 6.0) for k in filters.KINDS}


_C = ", ".join(f"('{k}', {', '.join(f'{float(v)!r}::DOUBLE' for v in s)})" for k, s in _sections().items())


@query(
    "f1_f2_filter_response",
    f"""WITH c(name, b0, b1, b2, a1, a2) AS (VALUES {_C}), g AS (SELECT *, CAST(i AS INT) AS i2, pi() * i / 64 AS w FROM c, range(0, 64) t(i)),
v AS (SELECT name, i2, pow(b0 + b1 * cos(w) + b2 * cos(2 * w), 2) + pow(b1 * sin(w) + b2 * sin(2 * w), 2) AS u, pow(1 + a1 * cos(w) + a2 * cos(2 * w), 2) + pow(a1 * sin(w) + a2 * sin(2 * w), 2) AS d FROM g)
SELECT name, i2 AS i, round(i2 * 8000.0::DOUBLE / 2 / 64, 6) AS hz, round(CASE WHEN u > 0 THEN greatest(-200, 10 * log10(u / d)) ELSE -200 END, 5) + 0.0::DOUBLE AS gain_db FROM v""",
)
def _(spark, sf_dir):
    from .operators import filters

    r = filters.response(spark, _sections(), 8000.0, 64)
    return r.select("name", "i", F.round("hz", 6).alias("hz"), (F.round("gain_db", 5) + F.lit(0.0)).alias("gain_db"))


def _register():
    from .operators import filters, repair
    from .sources import containers

    mono = lambda s, d: model.whole(model.long(_line(s, d)))
    more = {
        "f3_biquad": lambda s, d: filters.apply_sections(_users(s, d), [filters.design("low_pass", 8000.0, 1000.0)]),
        "f4_butterworth": lambda s, d: filters.apply_sections(_users(s, d), filters.butterworth("high_pass", 8000.0, 500.0, 6)),
        "f5_parametric_eq": lambda s, d: filters.parametric_eq(_users(s, d), 8000.0, [{"kind": "peaking", "hz": 900.0, "gain_db": 4.0}, {"kind": "low_shelf", "hz": 200.0, "gain_db": -3.0, "enabled": False}]),
        "f8_compressor": lambda s, d: filters.compress(_users(s, d), 8000.0), "f9_expander": lambda s, d: filters.expand(_users(s, d), 8000.0), "f10_gate": lambda s, d: filters.gate(_users(s, d), 8000.0),
        "f11_limiter": lambda s, d: filters.limit(_users(s, d), 8000.0, -6.0), "m4_true_peak": lambda s, d: filters.true_peak(_mono(s, d)), "m10_filter_bank": lambda s, d: filters.filter_bank(mono(s, d), 8000.0),
        "m22_sweep": lambda s, d: filters.sweep(s, 8000.0, 1.0), "r15_resample": lambda s, d: filters.resample(_users(s, d), 8000.0, 11025.0), "r6_denoise": lambda s, d: repair.denoise(mono(s, d), 0, 4000),
        "r4_attenuate_region": lambda s, d: repair.attenuate(mono(s, d), 8000.0, 0.5, 1.0, 500.0, 1500.0, -24.0), "r7_dereverb": lambda s, d: repair.dereverb(mono(s, d), 8000.0), "r10_declick": lambda s, d: repair.declick(mono(s, d)),
        "r11_declip": lambda s, d: repair.declip(mono(s, d)), "r12_dehum": lambda s, d: repair.dehum(mono(s, d), 8000.0), "r13_stretch": lambda s, d: repair.stretch(mono(s, d), 1.25),
        "k1_write_wav": lambda s, d: containers.write_wav(_users(s, d), 8000, "s16").select("recording", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")),
    }
    for name, fn in more.items():
        QUERIES[name] = (lambda f: lambda spark, sf_dir: rounded(f(spark, sf_dir)))(fn)


_register()


@query("m14_tempo")
def _(spark, sf_dir):
    e = model.event_signal(spark, sf_dir).select("recording", F.col("n").alias("frame"), F.greatest(F.lit(0.0), F.col("x")).alias("onset"))
    return measure.track_tempo(e, 8.0).select("recording", "valid", F.round("bpm", 4).alias("bpm"), F.round("confidence", 6).alias("confidence"), F.size("beats").alias("n_beats"))


@query("m18_provenance")
def _(spark, sf_dir):
    spec = spectral.average_spectrum(spectral.dft(model.frames(spark, sf_dir), 64), 64)
    return rounded(spectral.provenance(spec, 8000.0, 64))


@query(
    "k7_csv_report",
    f"WITH {EVENT} SELECT recording || ',' || printf('%.3f', max(abs(x))) || ',' || printf('%.3f', {db_sql('sqrt(avg(x * x))')}) AS line FROM ev GROUP BY recording",
)
def _(spark, sf_dir):
    from .plans import reports

    e = model.event_signal(spark, sf_dir)
    r = e.groupBy("recording").agg(F.max(F.abs("x")).alias("peak"), model.db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms_db"))
    return reports.csv_lines(r)


@query("k8_k9_session")
def _(spark, sf_dir):
    """Save the timeline as sessions of a thousand order keys and load them again: the clips come back as they were."""
    from .plans import session

    clips = model.clips(spark, sf_dir).withColumn("source_start", F.lit(0).cast("long")).withColumn("session_id", F.floor(F.col("clip_id") / 1000))
    sources = clips.select("session_id", "source_id").distinct().selectExpr("session_id", "source_id", "cast(source_id AS string) AS name", "'' AS path", "100L AS frame_count", "8000.0D AS source_sample_rate", "1 AS source_channels")
    markers = clips.groupBy("session_id").agg(F.min("timeline_start").alias("position")).selectExpr("session_id", "position", "0L AS length", "'start' AS label")
    saved = session.save(spark, sources, clips, markers, 8000.0, 1)
    return session.load(saved)["clips"].select("clip_id", "source_id", "source_start", "length", "timeline_start", F.round("gain", 6).alias("gain"))


SQL["k8_k9_session"] = f"WITH {CLIPS} SELECT clip_id, source_id, 0::BIGINT AS source_start, length, timeline_start, round(gain::DOUBLE, 6) AS gain FROM clips"


def _register_advanced():
    from .operators import advanced

    signal = lambda s, d: model.whole(model.long(_line(s, d)))

    def contour(s, d):
        x = signal(s, d)
        return advanced.contour(loudness.series(loudness.sub_blocks(x, model.RATE), model.RATE), x, model.RATE)

    more = {
        "m3_loudness_contour": contour, "m5_exact_true_peak": lambda s, d: advanced.exact_true_peak(signal(s, d)), "m20_room_by_band": lambda s, d: advanced.room_by_band(_users(s, d), 8000.0),
        "f15_multiband": lambda s, d: advanced.multiband_compress(signal(s, d), 8000.0), "f16_deess": lambda s, d: advanced.deess(signal(s, d), 8000.0, 3000.0), "r5_heal": lambda s, d: advanced.heal(signal(s, d), 8000.0, 0.1, 0.2, 500.0, 1500.0),
        "r14_pitch_shift": lambda s, d: advanced.pitch_shift(signal(s, d), 8000.0, 3.0), "p15_dither": lambda s, d: advanced.dither(signal(s, d), 16),
    }
    for name, fn in more.items():
        QUERIES[name] = (lambda f: lambda spark, sf_dir: rounded(f(spark, sf_dir)))(fn)


_register_advanced()

from . import queries_edits, queries_files, queries_measure, queries_state, queries_verbs  # noqa: E402, F401
