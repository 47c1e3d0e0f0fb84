"""Queries of the batch verbs and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import model, verbs
from .operators import filters, spectral
from .plans import session
from .queries import EVENT, LINE, QUERIES, SQL, db_sql, query, rounded  # noqa: F401
from .queries_edits import SOUND, _clips, _sources
from .queries_measure import PHASES, PULSE
from .queries_state import YIN

RATE = model.RATE


def _line(spark, sf_dir):
    return model.whole(model.long(model.line_signal(spark, sf_dir)))


def _users(spark, sf_dir):
    return model.event_signal(spark, sf_dir).withColumn("channel", F.lit(0))


TAPS = f"""{PHASES}, up AS (SELECT recording, k, n + j AS m, sum(x * h) AS y FROM ev JOIN (SELECT recording, max(n) AS last FROM ev GROUP BY 1) USING (recording), ph WHERE n + j <= last GROUP BY ALL),
pk AS (SELECT recording, greatest(max(abs(y)), (SELECT max(abs(x)) FROM ev e WHERE e.recording = up.recording)) AS tp FROM up GROUP BY recording)"""
REPORT = f"""{EVENT}, {TAPS}, s AS (SELECT recording, count(*) AS frames, max(abs(x)) AS p, sqrt(avg(x * x)) AS r, avg(x) AS d FROM ev GROUP BY 1),
rp AS (SELECT CAST(recording AS VARCHAR) AS file, 8000.0::DOUBLE AS "sampleRate", 1::INT AS channels, frames, frames / 8000.0::DOUBLE AS seconds, -200.0::DOUBLE AS st, {db_sql('tp')} AS "truePeakDbtp", {db_sql('p')} AS "samplePeakDbfs", {db_sql('r')} AS "rmsDbfs", {db_sql('p / r')} AS "crestFactorDb", d AS "dcOffset" FROM s JOIN pk USING (recording))"""


@query(
    "v_analyse",
    f"""WITH {REPORT} SELECT file, "sampleRate", channels, frames, round(seconds, 6) AS seconds, NULL::VARCHAR AS format, NULL::DOUBLE AS "integratedLufs", NULL::DOUBLE AS "loudnessRangeLu", st AS "maxShortTermLufs", st AS "maxMomentaryLufs", round("truePeakDbtp", 6) AS "truePeakDbtp", round("samplePeakDbfs", 6) AS "samplePeakDbfs",
round("rmsDbfs", 6) AS "rmsDbfs", round("crestFactorDb", 6) AS "crestFactorDb", round("dcOffset", 6) AS "dcOffset", NULL::DOUBLE AS "stereoCorrelation", NULL::DOUBLE AS "stereoWidthDb", NULL::DOUBLE AS "stereoBalanceDb", NULL::DOUBLE AS "monoLossDb" FROM rp""",
)
def _(spark, sf_dir):
    """The users' recordings are too short for a loudness block, so those cells stay empty."""
    return rounded(verbs.analyse(_users(spark, sf_dir), RATE), 6)


@query("k7_csv_19_columns", f"""WITH {REPORT} SELECT file || ',8000.000,1,' || frames || ',' || printf('%.3f', seconds + 1e-9) || ',,,,-200.000,-200.000,' || printf('%.3f', "truePeakDbtp") || ',' || printf('%.3f', "samplePeakDbfs") || ',' || printf('%.3f', "rmsDbfs") || ',' || printf('%.3f', "crestFactorDb") || ',' || printf('%.6f', "dcOffset") || ',,,,' AS line FROM rp""")
def _(spark, sf_dir):
    return verbs.analyse_csv(_users(spark, sf_dir), RATE)


@query("k6_json_report", f"""WITH {REPORT} SELECT file, frames, round("truePeakDbtp", 3) AS true_peak, round("dcOffset", 6) AS dc, true AS nulls_kept FROM rp""")
def _(spark, sf_dir):
    """Each object has all keys; what wasn't measured is null in it."""
    j = verbs.analyse_json(_users(spark, sf_dir), RATE).select(F.from_json("json", "file string, frames long, truePeakDbtp double, dcOffset double").alias("v"), F.contains("json", F.lit('"integratedLufs":null')).alias("nulls_kept"))
    return j.select("v.file", "v.frames", F.col("v.truePeakDbtp").alias("true_peak"), F.col("v.dcOffset").alias("dc"), "nulls_kept")


def _spectra_sql(cap: str, size: int = 64, hop: int = 32) -> str:
    return f"""cp AS (SELECT n, l AS x FROM line WHERE n < {cap}), w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / {size}) AS w FROM range({size}) t(i)), fr AS (SELECT f, i, x * w AS x FROM range(0, (SELECT (count(*) - {size}) // {hop} + 1 FROM cp)) r(f), w JOIN cp ON cp.n = f * {hop} + i),
mags AS (SELECT f AS frame, bin, sqrt(re * re + im * im) AS mag FROM (SELECT f, bin, sum(x * cos(2 * pi() * ((i * bin) % {size}) / {size})) AS re, sum(x * sin(2 * pi() * ((i * bin) % {size}) / {size})) AS im FROM fr, range({size // 2 + 1}) b(bin) GROUP BY f, bin)), spec AS (SELECT bin, {db_sql(f'avg(mag) * 2 / {size // 2}')} AS average_db FROM mags GROUP BY bin)"""


_B = ", ".join(f"({c}::DOUBLE)" for c in spectral.OCTAVES)


@query(
    "v_bands",
    f"""WITH {LINE}, {_spectra_sql('960000')}, lay AS (SELECT c AS centre, c / sqrt(2) AS low, c * sqrt(2) AS high FROM (VALUES {_B}) t(c) WHERE c * sqrt(2) <= 4000), s AS (SELECT bin, bin * 125.0 AS hz, pow(10, average_db / 10) AS p FROM spec),
i AS (SELECT centre, sum(p) AS p FROM lay JOIN s ON hz >= low AND hz < high GROUP BY centre)
SELECT 0::BIGINT AS recording, lay.centre AS "centreHz", round(low, 6) AS "lowHz", round(high, 6) AS "highHz", round(10 * log10(greatest(coalesce(i.p, s.p, 0) / 1.5, 1e-30)), 5) AS "levelDbfs" FROM lay LEFT JOIN i USING (centre) LEFT JOIN s ON s.bin = CAST(round(lay.centre / 125) AS BIGINT)""",
)
def _(spark, sf_dir):
    out = verbs.bands(spark, _line(spark, sf_dir), RATE, octave=True, size=64)
    return out.select("recording", "centreHz", F.round("lowHz", 6).alias("lowHz"), F.round("highHz", 6).alias("highHz"), F.round("levelDbfs", 5).alias("levelDbfs"))


_P = ", ".join(f"({t}, {m}, '{spectral.NAMES[t]} {('major', 'minor')[m]}', {d}, {(spectral.MAJOR, spectral.MINOR)[m][(d - t) % 12]})" for t in range(12) for m in (0, 1) for d in range(12))


@query(
    "v_key",
    f"""WITH {LINE}, {_spectra_sql('480000')}, tot AS (SELECT bin, sum(mag) AS mag, 69 + 12 * log2(bin * 125.0 / 440) AS s FROM mags WHERE bin > 0 AND bin * 125.0 BETWEEN 65 AND 5000 GROUP BY bin), cf AS (SELECT ((CAST(round(s) AS INT) % 12) + 12) % 12 AS pc, sum(mag) AS m FROM tot GROUP BY 1),
ch AS (SELECT d, coalesce(m, 0) / (SELECT sum(m) FROM cf) AS c FROM range(12) t(d) LEFT JOIN cf ON d = pc), pr(tonic, mode, name, d, p) AS (VALUES {_P}), f AS (SELECT tonic, mode, name, corr(p::DOUBLE, c) AS fit FROM pr JOIN ch USING (d) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY round(fit, 9) DESC, tonic, mode) AS k FROM f), ct AS (SELECT sqrt(sum(pow(c - 1 / 12.0, 2)) / 12) * 12 AS contrast FROM ch), tn AS (SELECT atan2(sum(mag * sin(2 * pi() * (s - round(s)))), sum(mag * cos(2 * pi() * (s - round(s))))) * 100 / (2 * pi()) AS cents FROM tot),
a AS (SELECT max(name) FILTER (k = 1) AS key, max(mode) FILTER (k = 1) AS mode, max(fit) FILTER (k = 1) AS fit, max(name) FILTER (k = 2) AS ru, max(fit) FILTER (k = 1) - max(fit) FILTER (k = 2) AS margin FROM r)
SELECT 0::BIGINT AS recording, key, string_split(key, ' ')[1] AS tonic, string_split(key, ' ')[2] AS mode, contrast >= 0.15 AND fit * least(1, contrast) >= 0.2 AS "worthNaming", round(fit * least(1, contrast), 5) AS strength, round(fit, 5) AS fit, round(contrast, 5) AS contrast, round(margin, 5) AS margin, round(cents, 4) AS "tuningOffsetCents", ru AS "runnerUp" FROM a, ct, tn""",
)
def _(spark, sf_dir):
    k = verbs.key(spark, _line(spark, sf_dir), RATE, size=64)
    return k.select("recording", "key", "tonic", "mode", "worthNaming", *(F.round(c, 5).alias(c) for c in ("strength", "fit", "contrast", "margin")), F.round("tuningOffsetCents", 4).alias("tuningOffsetCents"), "runnerUp")


@query(
    "v_provenance",
    f"""WITH {LINE}, {_spectra_sql('960000')}, u AS (SELECT bit_or(CAST(abs(round(greatest(-1.0, least(1.0, x)) * 8388608)) AS BIGINT)) AS v FROM cp), b AS (SELECT CAST(CASE WHEN v = 0 THEN 0 ELSE 24 - bit_count((v & -v) - 1) END AS INT) AS e FROM u),
s AS (SELECT CAST(floor(log2(bin * 125.0 / 500) * 16) AS BIGINT) AS step, avg(average_db) AS l FROM spec WHERE bin * 125.0 >= 500 GROUP BY 1), m AS (SELECT max(l) - 35 AS t FROM s), z AS (SELECT max(step) AS last FROM s, m WHERE l >= t),
d AS (SELECT max(CASE WHEN step = last THEN l END) - max(CASE WHEN step = last + 4 THEN l END) AS drop_db, max(last) AS last FROM s, z)
SELECT 0::BIGINT AS recording, 8000.0::DOUBLE AS "sampleRate", 24::INT AS "declaredBits", e AS "effectiveBits", e > 0 AND e < 24 AS padded, round(500 * pow(2, (last + 1) / 16), 5) AS "cutoffHz", round(drop_db, 5) AS "cutoffDropDb", coalesce(drop_db >= 35, false) AS "steepCutoff" FROM b, d""",
)
def _(spark, sf_dir):
    return rounded(verbs.provenance(_line(spark, sf_dir), RATE, size=64), 5)


@query(
    "v_onsets",
    f"""WITH {LINE}, {_spectra_sql('960000')}, v AS (SELECT frame, bin, ln(1 + 1000 * greatest(mag, 1e-3 * max(mag) OVER (PARTITION BY frame))) AS v FROM mags), d AS (SELECT frame, v - lag(v) OVER (PARTITION BY bin ORDER BY frame) AS r FROM v)
SELECT 0::BIGINT AS recording, 0::INT AS channel, frame, round(sum(greatest(0, coalesce(r, 0))), 5) AS onset FROM d GROUP BY frame""",
)
def _(spark, sf_dir):
    return rounded(spectral.onsets(verbs._channel(_line(spark, sf_dir), 0), 64, 32), 5)


_FRAMED = YIN.replace("fr AS MATERIALIZED (SELECT vec_id AS frame, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)", "fr AS MATERIALIZED (SELECT n // 64 AS frame, n % 64 AS i, l AS x FROM line WHERE n // 64 < (SELECT count(*) // 64 FROM line))")


@query("v_pitch_contour", f"WITH {LINE}, {_FRAMED} SELECT 0::BIGINT AS recording, round(seconds, 6) AS seconds, round(hz, 5) AS hz, round(confidence, 5) AS confidence, voiced FROM pitch")
def _(spark, sf_dir):
    return rounded(verbs.pitch_of(_line(spark, sf_dir), RATE, 300.0, 2000.0, size=64, hop=64)[1], 5)


@query("v_pitch_summary", f"WITH {LINE}, {_FRAMED}, o AS (SELECT hz, row_number() OVER (ORDER BY hz) - 1 AS k, count(*) OVER () AS c FROM pitch WHERE voiced) SELECT 0::BIGINT AS recording, round(max(CASE WHEN k = c // 2 THEN hz END), 5) AS \"medianHz\", round(min(hz), 5) AS \"lowestHz\", round(max(hz), 5) AS \"highestHz\", round((SELECT avg(voiced::INT) FROM pitch), 5) AS \"voicedFraction\", (SELECT count(*) FROM pitch) AS frames FROM o")
def _(spark, sf_dir):
    return rounded(verbs.pitch_of(_line(spark, sf_dir), RATE, 300.0, 2000.0, size=64, hop=64)[0], 5)


@query("v_null", f"WITH {EVENT}, j AS (SELECT a.recording, a.n, a.x, 0.5 * a.x + 0.01 * (a.n % 2) AS y FROM ev a), e AS (SELECT recording, sum(pow(x - y, 2)) AS rest, sum(x * x) AS xx, sum(x * y) AS xy, max(abs(x - y)) AS most, arg_max(n, struct_pack(a := abs(x - y), b := -n)) AS worst, count(*) AS c FROM j GROUP BY 1) SELECT recording, CASE WHEN {db_sql('rest / xx', 10)} <= -120 THEN 'null' ELSE 'different' END AS verdict, 0::BIGINT AS \"delaySamples\", round({db_sql('abs(xy / xx)')}, 6) AS \"gainDb\", xy < 0 AS \"polarityInverted\", round({db_sql('rest / xx', 10)}, 6) AS \"residualDb\", round({db_sql('most')}, 6) AS \"peakResidualDb\", round(worst / 8000.0::DOUBLE, 6) AS \"worstTimeSeconds\", c AS \"comparedFrames\" FROM e")
def _(spark, sf_dir):
    """Without alignment or gain matching."""
    u = _users(spark, sf_dir)
    return rounded(verbs.null(u, u.withColumn("x", F.col("x") * 0.5 + 0.01 * (F.col("n") % 2)), RATE, align=False, gain_match=False), 6)


@query(
    "v_null_bands",
    f"""WITH {LINE}, cp AS (SELECT n, l AS x, l - (0.5 * l + 0.01 * (n % 2)) AS e FROM line), w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w FROM range(64) t(i)), fr AS (SELECT f, i, x * w AS x, e * w AS e FROM range(0, (SELECT (count(*) - 64) // 32 + 1 FROM cp)) r(f), w JOIN cp ON cp.n = f * 32 + i),
mg AS (SELECT f, bin, sqrt(a * a + b * b) AS mx, sqrt(c * c + d * d) AS me FROM (SELECT f, bin, sum(x * cos(2 * pi() * ((i * bin) % 64) / 64)) AS a, sum(x * sin(2 * pi() * ((i * bin) % 64) / 64)) AS b, sum(e * cos(2 * pi() * ((i * bin) % 64) / 64)) AS c, sum(e * sin(2 * pi() * ((i * bin) % 64) / 64)) AS d FROM fr, range(33) t(bin) GROUP BY f, bin)),
sp AS (SELECT bin, bin * 125.0 AS hz, pow(avg(mx) / 16, 2) / 2 * 2 AS px, pow(avg(me) / 16, 2) AS pe FROM mg GROUP BY bin), lay AS (SELECT c, c / sqrt(2) AS low, c * sqrt(2) AS high FROM (VALUES {_B}) t(c) WHERE c * sqrt(2) <= 4000),
i AS (SELECT c, sum(px) AS px, sum(pe) AS pe FROM lay JOIN sp ON hz >= low AND hz < high GROUP BY c), o AS (SELECT lay.c, 10 * log10(greatest(coalesce(i.px, sp.px, 0) / 1.5, 1e-30)) AS r, 10 * log10(greatest(coalesce(i.pe, sp.pe, 0) / 1.5, 1e-30)) AS e FROM lay LEFT JOIN i USING (c) LEFT JOIN sp ON sp.bin = CAST(round(lay.c / 125) AS BIGINT))
SELECT 0::BIGINT AS recording, c AS "centreHz", round(r, 5) AS "referenceDb", round(e, 5) AS "residualDb", round(e - r, 5) AS "relativeDb" FROM o""",
)
def _(spark, sf_dir):
    """What the subtraction leaves in each octave."""
    x = _line(spark, sf_dir)
    return rounded(verbs.null_bands(spark, x, x.withColumn("x", F.col("x") * 0.5 + 0.01 * (F.col("n") % 2)), RATE, align=False, gain_match=False, size=64), 5)


@query(
    "v_deconvolve_report",
    f"""WITH {LINE}, g AS (SELECT n, least(n, 399 - n) AS near FROM range(400) t(n)), k AS (SELECT ln(3960.0 / 20) AS k), sw AS (SELECT n, 0.5 * sin(2 * pi() * 20 * 0.05 / k * (exp(n / 8000 / 0.05 * k) - 1)) * CASE WHEN near < 160 THEN 0.5 - 0.5 * cos(pi() * near / 160) ELSE 1 END AS x FROM g, k),
iv AS (SELECT 399 - n AS n, x * exp(-(399 - n) / 8000 / 0.05 * k) AS v FROM sw, k), pk AS (SELECT max(abs(y)) AS p FROM (SELECT sw.n + iv.n AS m, sum(sw.x * iv.v) AS y FROM sw, iv GROUP BY 1)), ir AS (SELECT line.n - (399 - iv.n) AS n, sum(l * v) / any_value(p) AS y FROM line, iv, pk WHERE line.n >= 399 - iv.n GROUP BY 1), f AS (SELECT count(*) AS f FROM line)
SELECT 0::BIGINT AS recording, f AS frames, round(f / 8000.0::DOUBLE, 5) AS seconds, round({db_sql('(SELECT max(abs(y)) FROM ir) / (SELECT sqrt(avg(y * y)) FROM ir, f WHERE n >= f - f // 10)')}, 5) AS "peakAboveTailDb" FROM f""",
)
def _(spark, sf_dir):
    """A sweep of 400 samples taken out of the line signal."""
    return rounded(verbs.deconvolve_report(verbs.deconvolve(_line(spark, sf_dir), RATE, seconds=0.05), RATE), 5)


@query("v_channels_mono", f"WITH {LINE} SELECT 0::BIGINT AS recording, channel, n, round(0.5 * (l + r), 6) AS x FROM line, (VALUES (0), (1)) c(channel)")
def _(spark, sf_dir):
    return rounded(verbs.channels(_line(spark, sf_dir), RATE, "mono"))


@query("v_convert_same_rate", f"WITH {EVENT} SELECT recording, 0::INT AS channel, n, x FROM ev")
def _(spark, sf_dir):
    """With one rate and no dither a conversion is a copy."""
    return verbs.convert(_users(spark, sf_dir), RATE, RATE).select("recording", "channel", "n", "x")


SQL["v_compress"] = SQL["f8_compressor"]
QUERIES["v_compress"] = lambda s, d: rounded(verbs.compress(_users(s, d), RATE).withColumn("channel", F.col("channel").cast("int")))
QUERIES["v_gate"] = lambda s, d: rounded(verbs.gate(_users(s, d), RATE))


@query("v_render", f"WITH {SOUND} SELECT g.n, round(coalesce(x, 0), 9) AS x FROM range(0, (SELECT max(timeline_start + length) FROM fc)) g(n) LEFT JOIN p ON p.n = g.n")
def _(spark, sf_dir):
    """Sessions of a thousand order keys are saved, and the timeline that they share is rendered from their JSON, fades included."""
    clips = _clips(spark, sf_dir).withColumn("session_id", F.floor(F.col("clip_id") / 1000))
    sources = clips.select("session_id", "source_id").distinct().selectExpr("session_id", "source_id", "cast(source_id AS string) AS name", "'' AS path", "100L AS frame_count", "8000.0D AS source_sample_rate", "1 AS source_channels")
    markers = clips.groupBy("session_id").agg(F.min("timeline_start").alias("position")).selectExpr("session_id", "position", "0L AS length", "'start' AS label")
    return rounded(verbs.render(session.save(spark, sources, clips, markers, RATE, 1), _sources(spark, sf_dir))[0], 9)


SQL["v_sweep"] = SQL["m22_sweep"].replace("range(8000)", "range(8000)").replace("0.5 * sin", "pow(10, -6.0206 / 20) * sin")
QUERIES["v_sweep"] = lambda s, d: rounded(verbs.sweep(s, RATE, 20.0, 20000.0, 1.0))


def _more():
    line, users = _line, _users
    more = {
        "v_tempo": lambda s, d: verbs.tempo(line(s, d), RATE).withColumn("beats", F.size("beats")), "v_contour": lambda s, d: verbs.contour(line(s, d), RATE, 0.2), "v_room": lambda s, d: verbs.room(users(s, d), RATE), "v_normalise": lambda s, d: verbs.normalise(s, line(s, d), RATE, "ebu r128"),
        "v_denoise": lambda s, d: verbs.denoise(line(s, d), RATE, (0.0, 0.5)), "v_dereverb": lambda s, d: verbs.dereverb(line(s, d), RATE), "v_deess": lambda s, d: verbs.deess(line(s, d), RATE, 3000.0)[1], "v_dehum": lambda s, d: verbs.dehum(line(s, d), RATE, 50.0),
        "v_declip": lambda s, d: verbs.declip(line(s, d), RATE), "v_declick": lambda s, d: verbs.declick(line(s, d), RATE), "v_stretch": lambda s, d: verbs.stretch(users(s, d), RATE, 125.0), "v_pitch": lambda s, d: verbs.pitch(users(s, d), RATE, 3.0),
        "v_convert": lambda s, d: verbs.convert(line(s, d), RATE, 11025.0, "16", "tpdf"), "v_deconvolve": lambda s, d: verbs.deconvolve(line(s, d), RATE, seconds=0.5, keep=0.1), "f14_offline_limiter": lambda s, d: filters.offline_limit(users(s, d), RATE, -6.0),
        "f6_range_eq": lambda s, d: filters.eq_on_range(users(s, d), RATE, 10, 50, [{"kind": "peaking", "hz": 900.0, "gain_db": 6.0}], 8),
    }
    for name, fn in more.items():
        QUERIES[name] = (lambda f: lambda spark, sf_dir: rounded(f(spark, sf_dir)))(fn)


_more()


SQL["m4_true_peak"] = f"""WITH {LINE}, {PHASES}, pd AS (SELECT channel, n, x FROM long), up AS (SELECT channel, k, n + j AS m, sum(x * h) AS y FROM pd, ph WHERE n + j <= (SELECT max(n) FROM long) GROUP BY ALL)
SELECT 0::BIGINT AS recording, CAST(channel AS INT) AS channel, round(greatest(max(abs(y)), (SELECT max(abs(x)) FROM long l WHERE l.channel = up.channel)), 6) AS true_peak FROM up GROUP BY channel"""
_BESSEL = lambda x: f"list_sum(list_transform(range(0, 40), lambda k: pow(({x}) / 2, 2 * k) / pow(gamma(k + 1), 2)))"
_SINC = lambda x: f"(CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END)"


def _resample_sql(signal: str, keys: str, to: float, half: int, steps: int, beta: float, cutoff: float) -> str:
    """The kernel of a cut-off, scaled by its sum at so many steps a sample."""
    value = lambda t: f"2 * {cutoff} * {_SINC(f'(2 * {cutoff} * {t})')} * {_BESSEL(f'{beta} * sqrt(greatest(0, 1 - pow({t} / {half}, 2)))')} / {_BESSEL(str(beta))}"
    wide = max(1.0, 8000 / to)
    return f"""sg AS (SELECT * FROM {signal}), ar AS (SELECT (2 * sum(v) - max(CASE WHEN i = 0 THEN v END)) / {steps} AS area FROM (SELECT i, {value(f'(i / {steps}.0::DOUBLE)')} AS v FROM range({half * steps + 1}) t(i))),
g AS (SELECT {keys}, unnest(range(0, CAST(ceil(c * {to}::DOUBLE / 8000 - 1e-9) AS BIGINT))) AS k FROM (SELECT {keys}, count(*) AS c FROM sg GROUP BY ALL)),
d AS (SELECT {', '.join(f'g.{k}' for k in keys.split(', '))}, k, x, (n - k * 8000.0::DOUBLE / {to}) / {wide} AS d FROM g JOIN sg ON {' AND '.join(f'sg.{k} = g.{k}' for k in keys.split(', '))} AND abs(n - k * 8000.0::DOUBLE / {to}) < {half * wide} - 1e-7),
rs AS (SELECT {keys}, k AS n, sum(x * ({value('d')})) / {wide} / (SELECT area FROM ar) AS x FROM d GROUP BY {keys}, k)"""


SQL["r15_resample"] = f"WITH {EVENT}, {_resample_sql('ev', 'recording', 11025.0, *filters.QUALITIES['best'])} SELECT recording, 0::INT AS channel, n, round(x, 6) + 0.0::DOUBLE AS x FROM rs"
SQL["r15_resample_down"] = f"WITH {EVENT}, {_resample_sql('ev', 'recording', 5000.0, *filters.QUALITIES['fast'])} SELECT recording, 0::INT AS channel, n, round(x, 6) + 0.0::DOUBLE AS x FROM rs"
QUERIES["r15_resample_down"] = lambda s, d: rounded(filters.resample(_users(s, d), RATE, 5000.0, "fast"))
_DETECT = f"""tp AS (SELECT i, {_SINC('((i - 128) / 8.0::DOUBLE)')} * {_BESSEL('5.0 * sqrt(greatest(0, 1 - pow((i - 128) / 128.0, 2)))')} / {_BESSEL('5.0')} AS h FROM range(257) t(i)), ph AS (SELECT i % 8 AS k, i // 8 AS j, h / sum(h) OVER (PARTITION BY i % 8) AS h FROM tp),
up AS (SELECT recording, n + j - 16 AS n, k, abs(sum(x * h)) AS y FROM ev, ph GROUP BY ALL), dt AS (SELECT recording, n, greatest(abs(any_value(x)), max(y)) AS level, any_value(x) AS x FROM ev JOIN up USING (recording, n) GROUP BY recording, n)"""
SQL["m6_true_peak_detector"] = f"WITH {EVENT}, {_DETECT} SELECT recording, 0::INT AS channel, n, round(level, 6) AS x FROM dt"
QUERIES["m6_true_peak_detector"] = lambda s, d: rounded(filters.detect_true_peak(_users(s, d), 8))
_room = SQL["m19_room_acoustics"].replace(PULSE, EVENT).replace("n < 25 ", "n < 400 ").replace("n < 40 ", "n < 640 ").replace("n / 500.0", "n / 8000.0").replace("/ 500, 5)", "/ 8000, 6)")
SQL["v_room"] = f"""SELECT recording, 0::INT AS channel, valid, edt, t20, t30, round(c50_db, 5) AS "c50Db", round(c80_db, 5) AS "c80Db", d50, centre_time AS "centreTimeSeconds", round(usable_range_db, 5) AS "usableRangeDb" FROM ({_room})"""
QUERIES["v_room"] = lambda s, d: verbs.room(_users(s, d), RATE).select(
    "recording", "channel", "valid", *(F.round(c, 6).alias(c) for c in ("edt", "t20", "t30", "d50", "centreTimeSeconds")), *(F.round(c, 5).alias(c) for c in ("c50Db", "c80Db", "usableRangeDb"))
)
