"""Filters and dynamics over the users' recordings against recursive SQL: the state of one sample is the next row's input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import model
from .operators import filters, measure, repair, spectral
from .queries import DFT, EVENT, QUERIES, SQL, db_sql, query, rounded  # noqa: F401

RATE = model.RATE
EV = EVENT.replace("ev AS (", "ev AS MATERIALIZED (")


def _users(spark, sf_dir) -> DataFrame:
    return model.event_signal(spark, sf_dir).withColumn("channel", F.lit(0))


def cascade_sql(sections: list[tuple]) -> str:
    """All sections of each sample at once; ``p`` is the sample before."""
    names = [f"s{k}{c}" for k in range(len(sections)) for c in "ab"]

    def step(before) -> str:
        cols, given = [], "ev.x"
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            a, b = before(f"s{k}a"), before(f"s{k}b")
            y = f"y{k}"
            cols += [f"{b0!r}::DOUBLE * {given} + {a} AS {y}", f"{b1!r}::DOUBLE * {given} - {a1!r}::DOUBLE * {y} + {b} AS n{k}a", f"{b2!r}::DOUBLE * {given} - {a2!r}::DOUBLE * {y} AS n{k}b"]
            given = y
        return ", ".join(cols)

    ys = ", ".join(f"y{k} AS o{k}, n{k}a AS s{k}a, n{k}b AS s{k}b" for k in range(len(sections)))
    first = step(lambda c: "0.0::DOUBLE")
    then = step(lambda c: f"p.{c}")
    last = f"o{len(sections) - 1}"
    return f"""WITH RECURSIVE {EV}, f AS (SELECT recording, n, {ys} FROM (SELECT ev.recording, ev.n, {first} FROM ev WHERE n = 0)
UNION ALL SELECT recording, n, {ys} FROM (SELECT ev.recording, ev.n, {then} FROM f p JOIN ev ON ev.recording = p.recording AND ev.n = p.n + 1))
SELECT recording, 0::INT AS channel, n, round({last}, 6) + 0.0::DOUBLE AS x FROM f"""


SQL["f3_biquad"] = cascade_sql([filters.design("low_pass", RATE, 1000.0)])
SQL["f4_butterworth"] = cascade_sql(filters.butterworth("high_pass", RATE, 500.0, 6))
SQL["f5_parametric_eq"] = cascade_sql([filters.design("peaking", RATE, 900.0, math.sqrt(0.5), 4.0)])


def _bank_sql() -> str:
    """Each band's cascade spelled out, and the mean of its squares."""
    out = []
    for b in filters.band_layout(RATE):
        head = f"{b['centre']!r}::DOUBLE AS centre, {b['low']!r}::DOUBLE AS low, {b['high']!r}::DOUBLE AS high"
        if b["sections"]:
            own = cascade_sql(b["sections"])
            own = own[: own.rindex("SELECT recording, 0::INT")] + f"SELECT recording, {db_sql(f'sqrt(avg(o{len(b["sections"]) - 1} * o{len(b["sections"]) - 1}))')} AS level FROM f GROUP BY recording"
            out.append(f"SELECT recording, {head}, round(level, 5) AS level_db, NULL::VARCHAR AS reason FROM ({own})")
        else:
            out.append(f"SELECT DISTINCT user_id AS recording, {head}, NULL::DOUBLE AS level_db, '{b['reason']}' AS reason FROM events")
    return f"SELECT recording, 0::INT AS channel, round(centre, 5) AS centre, round(low, 5) AS low, round(high, 5) AS high, level_db, reason FROM ({' UNION ALL '.join(f'({x})' for x in out)})"


SQL["m10_band_levels"] = _bank_sql()
QUERIES["m10_band_levels"] = lambda s, d: rounded(filters.filter_bank(_users(s, d), RATE), 5)


def follow_sql(value: str, attack: float, release: float, source: str, keep: str = "") -> str:
    """A CTE ``f(recording, n, x, s[, ...])``: the one-pole follower of ``value`` over ``source``."""
    a, r = filters._coefficient(attack, RATE), filters._coefficient(release, RATE)
    step = lambda p: f"{value} + (CASE WHEN {value} > {p} THEN {a!r}::DOUBLE ELSE {r!r}::DOUBLE END) * ({p} - {value})"
    return f"""SELECT v.recording, v.n, v.x{keep}, CASE WHEN abs({step('0.0::DOUBLE')}) < 1e-25 THEN 0 ELSE {step('0.0::DOUBLE')} END AS s FROM {source} v WHERE n = 0
UNION ALL SELECT v.recording, v.n, v.x{keep}, CASE WHEN abs({step('p.s')}) < 1e-25 THEN 0 ELSE {step('p.s')} END FROM p JOIN {source} v ON v.recording = p.recording AND v.n = p.n + 1"""


def _follower(name: str, value: str, attack: float, release: float, source: str, keep: str = "") -> str:
    return f"{name} AS ({follow_sql(value, attack, release, source, keep).replace('FROM p JOIN', f'FROM {name} p JOIN')})"


LEVEL = "(CASE WHEN abs(x) > 1e-10 THEN 20 * log10(abs(x)) ELSE -200.0 END)"


def _curve(threshold: float, ratio: float, knee: float, over: str) -> str:
    slope = 1 - 1 / ratio
    return f"(CASE WHEN abs({over}) * 2 <= {knee} THEN {slope!r} * pow({over} + {knee / 2}, 2) / {2 * knee} WHEN {over} > 0 THEN {slope!r} * ({over}) ELSE 0.0 END)"


SQL["f8_compressor"] = f"""WITH RECURSIVE {EV}, c AS MATERIALIZED (SELECT *, {_curve(-20, 4, 6, f'({LEVEL} + 20)')} AS r FROM ev), {_follower('f', 'v.r', 0.01, 0.1, 'c')}
SELECT recording, 0::INT AS channel, n, round(x * pow(10, -s / 20), 6) + 0.0::DOUBLE AS x FROM f"""

SQL["f9_expander"] = f"""WITH RECURSIVE {EV}, {_follower('d', 'abs(v.x)', 0.0, 0.01, 'ev')}, u AS MATERIALIZED (SELECT recording, n, x, -40 - (CASE WHEN s > 1e-10 THEN 20 * log10(s) ELSE -200.0 END) AS u FROM d),
c AS MATERIALIZED (SELECT *, CASE WHEN abs(u) * 2 <= 6 THEN pow(u + 3, 2) / 12 WHEN u > 0 THEN u ELSE 0.0 END AS r FROM u), {_follower('f', 'v.r', 0.001, 0.1, 'c')}
SELECT recording, 0::INT AS channel, n, round(x * pow(10, -s / 20), 6) + 0.0::DOUBLE AS x FROM f"""


def _gate_sql(hold: int) -> str:
    """The detected level, then for how long the gate stays open (-1: closed), then the glide of the gain."""
    keep = "exp(-1 / 80.0::DOUBLE)"
    left = lambda before: f"CASE WHEN lv > -50 THEN {hold} WHEN lv < -56 THEN greatest(-1, {before} - 1) ELSE {before} END"
    level = lambda e: f"CASE WHEN {e} > 1e-10 THEN 20 * log10({e}) ELSE -200.0 END"
    return f"""WITH RECURSIVE {EV}, g AS (SELECT recording, n, x, e, {left('-1')} AS k FROM (SELECT recording, n, x, abs(x) AS e, {level('abs(x)')} AS lv FROM ev WHERE n = 0)
UNION ALL SELECT recording, n, x, e, {left('k')} FROM (SELECT *, {level('e')} AS lv FROM (SELECT ev.recording, ev.n, ev.x, greatest(abs(ev.x), (1 - {keep}) * abs(ev.x) + {keep} * g.e) AS e, g.k FROM g JOIN ev ON ev.recording = g.recording AND ev.n = g.n + 1))),
t AS MATERIALIZED (SELECT recording, n, x, CASE WHEN k >= 0 THEN 80.0 ELSE 0.0 END AS t FROM g), {_follower('f', 'v.t', 0.001, 0.1, 't')}
SELECT recording, 0::INT AS channel, n, round(x * pow(10, (-80 + s) / 20), 6) + 0.0::DOUBLE AS x FROM f"""


SQL["f10_gate"] = _gate_sql(80)
SQL["v_gate"] = _gate_sql(400)

SQL["f11_limiter"] = f"""WITH RECURSIVE {EV}, w AS MATERIALIZED (SELECT *, max(greatest(0, {LEVEL} + 6)) OVER (PARTITION BY recording ORDER BY n ROWS BETWEEN CURRENT ROW AND 40 FOLLOWING) AS w FROM ev), {_follower('f', 'v.w', 0.001, 0.1, 'w')}
SELECT recording, 0::INT AS channel, n, round(x * least(pow(10, -s / 20), pow(10, -0.3) / greatest(abs(x), 1e-30)), 6) + 0.0::DOUBLE AS x FROM f"""


@query("f7_envelope_follower", f"WITH RECURSIVE {EV}, {_follower('f', 'abs(v.x)', 0.002, 0.05, 'ev')}, {_follower('r', 'v.x * v.x', 0.002, 0.05, 'ev')} SELECT recording, n, round(f.s, 6) AS peak, round(sqrt(r.s), 6) AS rms FROM f JOIN r USING (recording, n)")
def _(spark, sf_dir):
    u = _users(spark, sf_dir)
    peak = filters.envelope(u, RATE, 0.002, 0.05).select("recording", "n", F.col("x").alias("peak"))
    rms = filters.envelope(u, RATE, 0.002, 0.05, rms=True).select("recording", "n", F.col("x").alias("rms"))
    return rounded(peak.join(rms, ["recording", "n"]))


@query("w11_sliding_max", f"WITH {EVENT} SELECT recording, n, round(max(abs(x)) OVER (PARTITION BY recording ORDER BY n ROWS BETWEEN CURRENT ROW AND 40 FOLLOWING), 6) AS most FROM ev")
def _(spark, sf_dir):
    w = Window.partitionBy("recording").orderBy("n").rowsBetween(0, 40)
    return rounded(model.event_signal(spark, sf_dir).select("recording", "n", F.max(F.abs("x")).over(w).alias("most")))


@query("a22_most_reduction", f"WITH RECURSIVE {EV}, c AS MATERIALIZED (SELECT *, {_curve(-20, 4, 6, f'({LEVEL} + 20)')} AS r FROM ev), {_follower('f', 'v.r', 0.01, 0.1, 'c')} SELECT recording, round(max(s), 5) AS most_db FROM f WHERE abs(x) >= 1e-20 GROUP BY recording")
def _(spark, sf_dir):
    u = _users(spark, sf_dir)
    return rounded(filters.most_reduction(u, filters.compress(u, RATE)).drop("channel"), 5)


@query(
    "f12_stereo_link",
    f"""WITH RECURSIVE {EV}, b AS (SELECT recording, n, x FROM ev), st AS MATERIALIZED (SELECT recording, n, 0 AS channel, x, abs(x) AS own, abs(x * cos(n)) AS other FROM b UNION ALL SELECT recording, n, 1, x * cos(n), abs(x * cos(n)), abs(x) FROM b),
c AS MATERIALIZED (SELECT 2 * recording + channel AS recording, n, x, (SELECT {_curve(-20, 4, 6, '(l + 20)')} FROM (SELECT CASE WHEN m > 1e-10 THEN 20 * log10(m) ELSE -200.0 END AS l FROM (SELECT own + 0.5 * (greatest(own, other) - own) AS m))) AS r FROM st), {_follower('f', 'v.r', 0.01, 0.1, 'c')}
SELECT recording // 2 AS recording, CAST(recording % 2 AS INT) AS channel, n, round(x * pow(10, -s / 20), 6) + 0.0::DOUBLE AS x FROM f""",
)
def _(spark, sf_dir):
    """A side's detector hears half of what the louder side has over it."""
    u = model.event_signal(spark, sf_dir)
    stereo = u.select("recording", "n", F.posexplode(F.array(F.col("x"), F.col("x") * F.cos("n"))).alias("channel", "x"))
    return rounded(filters.linked_compress(stereo, RATE, amount=0.5))


@query(
    "f13_offline_dynamics",
    f"""WITH RECURSIVE {EV}, h AS MATERIALIZED (SELECT recording, n, x FROM ev WHERE n < 50), c AS MATERIALIZED (SELECT *, {_curve(-20, 4, 6, f'({LEVEL} + 20)')} AS r FROM h), {_follower('f', 'v.r', 0.01, 0.1, 'c')},
b AS (SELECT *, least(1.0, (n - 10 + 1) / 9.0, (50 - n) / 9.0) AS w FROM f)
SELECT ev.recording, 0::INT AS channel, ev.n, round(CASE WHEN ev.n >= 10 AND ev.n < least(50, c.k) THEN ev.x * (1 - least(1.0, (ev.n - 9) / 9.0, (least(50, c.k) - ev.n) / 9.0)) + f.x * pow(10, -f.s / 20) * least(1.0, (ev.n - 9) / 9.0, (least(50, c.k) - ev.n) / 9.0) ELSE ev.x END, 6) + 0.0::DOUBLE AS x
FROM ev JOIN (SELECT recording, count(*) AS k FROM ev GROUP BY 1) c USING (recording) LEFT JOIN f USING (recording, n)""",
)
def _(spark, sf_dir):
    """Samples 10 to 50 of each recording, with a run-up before and blended edges of 8 samples."""
    return rounded(filters.on_range(_users(spark, sf_dir), 10, 50, lambda part: filters.compress(part, RATE), blend=8))


# --- pitch by the definition

YIN = """fr AS MATERIALIZED (SELECT vec_id AS frame, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
d AS (SELECT a.frame, k, sum((a.x - b.x) * (a.x - b.x)) AS d FROM fr a, range(1, 28) t(k), fr b WHERE a.i < 37 AND b.frame = a.frame AND b.i = a.i + k GROUP BY a.frame, k),
m AS MATERIALIZED (SELECT frame, k, CASE WHEN c > 0 THEN d * k / c ELSE 1 END AS v FROM (SELECT *, sum(d) OVER (PARTITION BY frame ORDER BY k) AS c FROM d)),
nx AS (SELECT *, lead(v) OVER w AS after, lag(v, 1, 1.0::DOUBLE) OVER w AS before FROM m WINDOW w AS (PARTITION BY frame ORDER BY k)),
k0 AS (SELECT frame, min(k) AS k FROM m WHERE v < 0.15 GROUP BY frame), k1 AS (SELECT nx.frame, min(nx.k) AS k FROM nx JOIN k0 ON k0.frame = nx.frame AND nx.k >= k0.k WHERE after IS NULL OR after >= v GROUP BY nx.frame),
pt AS (SELECT nx.frame, v, CASE WHEN after IS NOT NULL AND before - 2 * v + after > 0 THEN nx.k + 0.5 * (before - after) / (before - 2 * v + after) ELSE nx.k END AS lag FROM nx JOIN k1 USING (frame, k)),
pitch AS MATERIALIZED (SELECT f.frame, (f.frame * 64 + 32) / 8000.0::DOUBLE AS seconds, CASE WHEN 8000 / lag BETWEEN 300 AND 2000 THEN 8000 / lag END AS hz, CASE WHEN lag IS NULL THEN greatest(0, 1 - (SELECT min(v) FROM m WHERE m.frame = f.frame)) ELSE greatest(0, least(1, 1 - v)) END AS confidence, coalesce(8000 / lag BETWEEN 300 AND 2000, false) AS voiced FROM (SELECT DISTINCT frame FROM fr) f LEFT JOIN pt USING (frame))"""

SQL["m11_pitch_track"] = f"WITH {YIN} SELECT 0::BIGINT AS recording, frame, round(seconds, 6) AS seconds, round(hz, 6) AS hz, round(confidence, 6) AS confidence, voiced FROM pitch"


@query("a19_pitch_summary", f"WITH {YIN}, o AS (SELECT hz, row_number() OVER (ORDER BY hz) - 1 AS k, count(*) OVER () AS c FROM pitch WHERE voiced) SELECT 0::BIGINT AS recording, round(max(CASE WHEN k = c // 2 THEN hz END), 6) AS median_hz, round(min(hz), 6) AS lowest_hz, round(max(hz), 6) AS highest_hz, round((SELECT avg(voiced::INT) FROM pitch), 6) AS voiced_fraction, (SELECT count(*) FROM pitch) AS frames FROM o")
def _(spark, sf_dir):
    f = model.frames(spark, sf_dir).select(F.lit(0).cast("long").alias("recording"), "frame", "samples")
    return rounded(measure.pitch_summary(measure.track_pitch(f, RATE, 64, low=300.0, high=2000.0)))


# --- alignment and null test

SQL["m17_null_test"] = f"""WITH {EVENT}, b AS (SELECT recording, n + 3 AS n, -0.5 * x + 0.001 * (n % 3) AS y FROM ev UNION ALL SELECT recording, unnest(range(3)), 0.0 FROM (SELECT DISTINCT recording FROM ev)),
r AS (SELECT ev.recording, b.n - ev.n AS lag, round(abs(sum(x * y)), 9) AS r FROM ev JOIN b USING (recording) GROUP BY ALL), g AS (SELECT recording, lag FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY r DESC, abs(lag), lag) AS k FROM r) WHERE k = 1),
j AS (SELECT ev.recording, lag, ev.n, x, y FROM ev JOIN g USING (recording) JOIN b ON b.recording = ev.recording AND b.n = ev.n + lag), s AS (SELECT recording, lag, sum(x * y) / sum(y * y) AS gain, sum(x * x) AS xx, count(*) AS c FROM j GROUP BY ALL),
e AS (SELECT recording, lag, gain, xx, c, sum(pow(x - gain * y, 2)) AS rest, max(abs(x - gain * y)) AS most FROM j JOIN s USING (recording, lag) GROUP BY ALL)
SELECT recording, lag, round(gain, 6) AS gain, gain < 0 AS inverted, c AS frames, round({db_sql('rest / xx', 10)}, 4) AS residual_db, round({db_sql('most')}, 4) AS peak_residual_db, CASE WHEN {db_sql('rest / xx', 10)} <= -120 THEN 'null' ELSE 'different' END AS verdict FROM e"""


def _null(spark, sf_dir):
    a = model.event_signal(spark, sf_dir)
    n = F.col("n")
    b = a.select("recording", (n + 3).alias("n"), (F.col("x") * -0.5 + 0.001 * (n % 3)).alias("x"))
    lead = a.select("recording").distinct().select("recording", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("n"), F.lit(0.0).alias("x"))
    out = measure.null_test(a, b.unionByName(lead))
    return out.select("recording", "lag", F.round("gain", 6).alias("gain"), "inverted", "frames", F.round("residual_db", 4).alias("residual_db"), F.round("peak_residual_db", 4).alias("peak_residual_db"), "verdict")


QUERIES["m17_null_test"] = _null


# --- smoothing of gains and delayed energies

GAIN = f"{DFT}, pr AS (SELECT bin, avg(mag) * 1.5 AS n FROM mags GROUP BY bin), g AS MATERIALIZED (SELECT frame, bin, CASE WHEN greatest(0, mag * mag - n * n) + n * n > 0 THEN greatest(0, mag * mag - n * n) / (greatest(0, mag * mag - n * n) + n * n) ELSE 1 END AS g FROM mags JOIN pr USING (bin))"


@query(
    "w8_w10_smoothed_gain",
    f"""WITH RECURSIVE {GAIN}, m AS MATERIALIZED (SELECT bin, row_number() OVER (PARTITION BY bin ORDER BY frame) - 1 AS k, frame, g FROM (SELECT frame, bin, avg(g) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM g)),
s AS (SELECT bin, k, frame, 0.55 + 0.45 * g AS v FROM m WHERE k = 0 UNION ALL SELECT m.bin, m.k, m.frame, 0.55 * s.v + 0.45 * m.g FROM s JOIN m ON m.bin = s.bin AND m.k = s.k + 1) SELECT frame, bin, round(v, 5) AS gain FROM s""",
)
def _(spark, sf_dir):
    mags = spectral.dft(model.frames(spark, sf_dir), 64)
    return rounded(spectral.smooth_gain(spectral.denoise_gain(mags, spectral.noise_profile(mags), reduction_db=4000.0)), 5)


@query("w9_delayed_power", f"WITH {DFT} SELECT frame, bin, round(sqrt(greatest(0, mag * mag - 0.25 * coalesce(lag(mag * mag, 3) OVER (PARTITION BY bin ORDER BY frame), 0)) / greatest(mag * mag, 1e-30)), 5) AS gain FROM mags")
def _(spark, sf_dir):
    return rounded(spectral.late_gain(spectral.dft(model.frames(spark, sf_dir), 64), delay=3, share=0.25), 5)


@query(
    "r12_hum_search",
    f"""WITH {EVENT}, c AS (SELECT round(m + k * 0.1, 6) AS hz FROM (VALUES (50.0), (60.0)) t(m), range(-10, 11) r(k)), p AS (SELECT recording, hz::DOUBLE AS hz, (pow(sum(x * cos(2 * pi() * hz / 8000 * n)), 2) + pow(sum(x * sin(2 * pi() * hz / 8000 * n)), 2)) / (count(*) * count(*)) AS p FROM ev, c GROUP BY ALL)
SELECT recording, arg_max(hz, struct_pack(a := round(p, 12), b := -hz)) AS hz, round(max(p), 6) AS power, round(max(p) / avg(p), 5) AS prominence FROM p GROUP BY recording""",
)
def _(spark, sf_dir):
    found = repair.hum_search(_users(spark, sf_dir), RATE)
    return found.select("recording", "hz", F.round("power", 6).alias("power"), F.round("prominence", 5).alias("prominence"))
