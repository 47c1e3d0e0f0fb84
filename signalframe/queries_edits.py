"""Queries of the timeline's edits, rendering and sessions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model
from .operators import edits, timeline
from .plans import session
from .queries import CLIPS, EVENT, QUERIES, SQL, query, rounded  # noqa: F401

FADED = f"{CLIPS}, fc AS (SELECT *, 0::BIGINT AS source_start, clip_id % 20 AS fade_in, source_id % 15 AS fade_out FROM clips), fe AS (SELECT *, timeline_start + length AS e FROM fc)"


def _clips(spark, sf_dir) -> DataFrame:
    return model.clips(spark, sf_dir).withColumns({"source_start": F.lit(0).cast("long"), "fade_in": F.col("clip_id") % 20, "fade_out": F.col("source_id") % 15})


def _sources(spark, sf_dir) -> DataFrame:
    return model.event_signal(spark, sf_dir).select(F.col("recording").alias("source_id"), "n", "x")


FADE = """(CASE WHEN fade_in > 0 AND i < fade_in THEN i / fade_in::DOUBLE ELSE 1 END) * (CASE WHEN fade_out > 0 AND length - i <= fade_out THEN (length - i) / fade_out::DOUBLE ELSE 1 END)"""
SOUND = f"""{FADED}, {EVENT}, p AS (SELECT timeline_start + i AS n, sum(gain * x * {FADE}) AS x FROM (SELECT *, s.n - source_start AS i FROM fc JOIN ev s ON s.recording = fc.source_id WHERE s.n >= source_start AND s.n - source_start < length) GROUP BY 1)"""


@query("p11_e11_render_with_fades", f"WITH {SOUND} SELECT g.n, round(coalesce(x, 0), 9) AS x FROM range(0, (SELECT max(timeline_start + length) FROM fc)) g(n) LEFT JOIN p ON p.n = g.n")
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    return rounded(timeline.render(clips, _sources(spark, sf_dir), 0, timeline.duration(clips)), 9)


@query("p11_clip_gain", f"WITH {FADED} SELECT clip_id, i, round(gain * {FADE}, 6) AS gain FROM fc, range(0, 150) t(i) WHERE i < length")
def _(spark, sf_dir):
    c = _clips(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    return rounded(c.select("clip_id", "i", timeline.clip_gain(F.col("i"), F.col("length"), F.col("gain"), F.col("fade_in"), F.col("fade_out")).alias("gain")))


_COLS = "clip_id, source_id, source_start, timeline_start, length, round(gain, 6)::DOUBLE AS gain, fade_in, fade_out"


def _plain(df: DataFrame, *more: str) -> DataFrame:
    return df.select("clip_id", "source_id", "source_start", "timeline_start", "length", F.round("gain", 6).alias("gain"), "fade_in", "fade_out", *more)


@query(
    "e1_append_sources",
    f"""WITH {FADED}, d AS (SELECT max(e) AS d, max(clip_id) + 1 AS k FROM fe), s AS (SELECT n_name AS name, 100 + 10 * n_nationkey AS frames, row_number() OVER (ORDER BY n_name) - 1 AS r FROM nation)
SELECT k + 2 * r + 1 AS clip_id, k + 2 * r AS source_id, name, frames::BIGINT AS length, CAST(d + sum(frames) OVER (ORDER BY name) - frames AS BIGINT) AS timeline_start FROM s, d""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    new = model.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (100 + 10 * F.col("n_nationkey")).cast("long").alias("frames"))
    last = clips.agg(F.max("clip_id")).first()[0]
    sources, made = edits.append_sources(new, last + 1, timeline.duration(clips))
    return made.join(sources.select("source_id", "name"), "source_id").select("clip_id", "source_id", "name", "length", "timeline_start")


@query(
    "e2_split_with_fades",
    f"""WITH {FADED}, m AS (SELECT max(e) // 2 AS m FROM fe), h AS (SELECT *, timeline_start < m AND e > m AS cut FROM fe, m)
SELECT clip_id, source_id, source_start, timeline_start, CASE WHEN cut THEN m - timeline_start ELSE length END AS length, round(gain, 6)::DOUBLE AS gain, fade_in, CASE WHEN cut THEN 0 ELSE fade_out END AS fade_out, 0::INT AS part FROM h
UNION ALL SELECT clip_id, source_id, m - timeline_start, m, e - m, round(gain, 6)::DOUBLE, 0, fade_out, 1::INT FROM h WHERE cut""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    return _plain(timeline.split_at(clips, timeline.duration(clips) // 2), "part")


@query(
    "e3_trim_clips",
    f"""WITH {FADED}, t AS (SELECT *, timeline_start + clip_id % 9 - 3 AS ns, length - clip_id % 7 * 20 AS nl, (SELECT count(*) FROM events WHERE user_id = source_id) AS f FROM fc),
u AS (SELECT *, CASE WHEN nl <= 0 THEN 'length must be positive' WHEN ns < 0 THEN 'start is negative' WHEN source_start + ns - timeline_start < 0 THEN 'starts before the source' WHEN f > 0 AND source_start + ns - timeline_start + nl > f THEN 'ends after the source' END AS error FROM t)
SELECT clip_id, source_id, CASE WHEN error IS NULL THEN source_start + ns - timeline_start ELSE source_start END AS source_start, CASE WHEN error IS NULL THEN ns ELSE timeline_start END AS timeline_start, CASE WHEN error IS NULL THEN nl ELSE length END AS length,
round(gain, 6)::DOUBLE AS gain, CASE WHEN error IS NULL THEN least(fade_in, nl) ELSE fade_in END AS fade_in, CASE WHEN error IS NULL THEN least(fade_out, nl) ELSE fade_out END AS fade_out, error FROM u""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    wanted = clips.select("clip_id", (F.col("timeline_start") + F.col("clip_id") % 9 - 3).alias("new_start"), (F.col("length") - F.col("clip_id") % 7 * 20).alias("new_length"))
    frames = model.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.count("*").alias("frames"))
    return _plain(edits.trim(clips, wanted, frames), "error")


@query(
    "e4_move_and_duplicate",
    f"""WITH {FADED}, k AS (SELECT max(clip_id) + 1 AS k FROM fc), mv AS (SELECT clip_id, source_id, source_start, CASE WHEN timeline_start - 500 >= 0 THEN timeline_start - 500 ELSE timeline_start END AS timeline_start, length, gain, fade_in, fade_out FROM fc)
SELECT {_COLS} FROM mv UNION ALL SELECT k + row_number() OVER (ORDER BY clip_id) - 1, source_id, source_start, timeline_start + 9000, length, round(gain, 6)::DOUBLE, fade_in, fade_out FROM mv, k""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    last = clips.agg(F.max("clip_id")).first()[0]
    moved = edits.move(clips, clips.select("clip_id", (F.col("timeline_start") - 500).alias("new_start"))).drop("error")
    return _plain(edits.duplicate(moved, moved.select("clip_id", (F.col("timeline_start") + 9000).alias("new_start")), last + 1))


@query(
    "e5_gain_and_fades",
    f"""WITH {FADED}, t AS (SELECT *, clip_id % 13 * 100.0 - 100 AS g, clip_id % 90 AS a, source_id % 90 AS b FROM fc), u AS (SELECT *, CASE WHEN g < 0 OR g > 1000 THEN 'gain must lie between 0 and 1000' END AS ge, CASE WHEN a + b > length THEN 'fades exceed the clip' END AS fe2 FROM t)
SELECT clip_id, round(CASE WHEN ge IS NULL THEN g ELSE gain END, 6)::DOUBLE AS gain, CASE WHEN fe2 IS NULL THEN a ELSE fade_in END AS fade_in, CASE WHEN fe2 IS NULL THEN b ELSE fade_out END AS fade_out, ge AS gain_error, fe2 AS fade_error FROM u""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    louder = edits.set_gain(clips, clips.select("clip_id", (F.col("clip_id") % 13 * 100.0 - 100).alias("new_gain"))).withColumnRenamed("error", "gain_error")
    faded = edits.set_fades(louder, clips.select("clip_id", (F.col("clip_id") % 90).alias("new_in"), (F.col("source_id") % 90).alias("new_out")))
    return faded.select("clip_id", F.round("gain", 6).alias("gain"), "fade_in", "fade_out", "gain_error", F.col("error").alias("fade_error"))


_PAIRS = "pr AS (SELECT *, lead(clip_id) OVER o AS nx, row_number() OVER o AS r FROM fc WINDOW o AS (ORDER BY timeline_start, clip_id))"


@query(
    "e8_crossfade",
    f"""WITH {FADED}, {_PAIRS}, q AS (SELECT a.clip_id AS ai, b.clip_id AS bi, a.clip_id % 120 AS x, b.timeline_start - (a.timeline_start + a.length - a.clip_id % 120) AS sh, a.length AS al, b.length AS bl FROM pr a JOIN pr b ON b.clip_id = a.nx WHERE a.r % 2 = 1),
w AS (SELECT *, CASE WHEN x <= 0 THEN 'length must be positive' WHEN x > al OR x > bl THEN 'longer than one of the clips' WHEN bl - sh <= 0 THEN 'would consume the second clip' END AS error FROM q)
SELECT clip_id, source_id, source_start + CASE WHEN b.error IS NULL THEN coalesce(b.sh, 0) ELSE 0 END AS source_start, timeline_start - CASE WHEN b.error IS NULL THEN coalesce(b.sh, 0) ELSE 0 END AS timeline_start, length - CASE WHEN b.error IS NULL THEN coalesce(b.sh, 0) ELSE 0 END AS length,
round(gain, 6)::DOUBLE AS gain, CASE WHEN b.bi IS NOT NULL AND b.error IS NULL THEN b.x ELSE fade_in END AS fade_in, CASE WHEN a.ai IS NOT NULL AND a.error IS NULL THEN a.x ELSE fade_out END AS fade_out, coalesce(a.error, b.error) AS error FROM fc LEFT JOIN w a ON a.ai = clip_id LEFT JOIN w b ON b.bi = clip_id""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    order = model.number(clips.select("clip_id", "timeline_start"), ["timeline_start", "clip_id"], "r")
    later = order.select((F.col("r") - 1).alias("r"), F.col("clip_id").alias("second"))
    pairs = order.filter(F.col("r") % 2 == 0).join(later, "r").select(F.col("clip_id").alias("first"), "second", (F.col("clip_id") % 120).alias("cross"))
    return _plain(edits.crossfade(clips, pairs), "error")


@query(
    "e9_range_gain",
    f"""WITH {FADED}, m AS (SELECT max(e) // 3 AS a, 2 * (max(e) // 3) AS b FROM fe),
c AS (SELECT clip_id, gain, p FROM (SELECT *, unnest(CASE WHEN timeline_start < a AND e > b THEN [{{'s': timeline_start, 'l': a - timeline_start}}, {{'s': a, 'l': b - a}}, {{'s': b, 'l': e - b}}] WHEN timeline_start < a AND e > a THEN [{{'s': timeline_start, 'l': a - timeline_start}}, {{'s': a, 'l': e - a}}]
WHEN timeline_start < b AND e > b THEN [{{'s': timeline_start, 'l': b - timeline_start}}, {{'s': b, 'l': e - b}}] ELSE [{{'s': timeline_start, 'l': length}}] END) AS p FROM fe, m)),
d AS (SELECT *, p.s >= a AND p.s + p.l <= b AS i FROM c, m)
SELECT clip_id, p.s AS timeline_start, p.l AS length, round(CASE WHEN i AND gain * 800 <= 1000 THEN gain * 800 ELSE gain END, 6)::DOUBLE AS gain, CASE WHEN i AND gain * 800 > 1000 THEN 'gain must lie between 0 and 1000' END AS error FROM d""",
)
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    third = timeline.duration(clips) // 3
    return edits.range_gain(clips, third, 2 * third, 800.0).select("clip_id", "timeline_start", "length", F.round("gain", 6).alias("gain"), "error")


_LEFT = """k AS (SELECT clip_id, source_id, source_start, timeline_start, least(e, a) - timeline_start AS length, gain, fade_in, CASE WHEN e <= a THEN fade_out WHEN e > b THEN 0 ELSE least(fade_out, a - timeline_start) END AS fade_out FROM fe, r WHERE timeline_start < a
UNION ALL SELECT clip_id, source_id, source_start + greatest(timeline_start, b) - timeline_start, greatest(timeline_start, b), e - greatest(timeline_start, b), gain, CASE WHEN timeline_start >= b THEN fade_in WHEN timeline_start < a THEN 0 ELSE least(fade_in, e - b) END, fade_out FROM fe, r WHERE e > b)"""


@query("e10_flatten_range", f"WITH {SOUND}, r AS (SELECT max(e) // 3 AS a, max(e) // 3 + 2000 AS b FROM fe), {_LEFT} SELECT {_COLS}, NULL::DOUBLE AS energy FROM k UNION ALL SELECT 900000002, 900000001, 0, a, b - a, 1.0, 0, 0, round((SELECT coalesce(sum(x * x), 0) FROM p, r WHERE n >= a AND n < b), 4) FROM r")
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    a = timeline.duration(clips) // 3
    flat, sources = edits.flatten_range(clips, _sources(spark, sf_dir), a, a + 2000, 900000001, 900000002)
    energy = sources.filter("source_id = 900000001").agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("energy"))
    return _plain(flat).join(F.broadcast(energy)).withColumn("energy", F.when(F.col("source_id") == 900000001, F.col("energy")))


@query("e9_range_fade", f"WITH {FADED}, r AS (SELECT max(e) // 3 AS a, max(e) // 3 + 2000 AS b FROM fe), {_LEFT} SELECT clip_id, timeline_start, length, fade_in, fade_out FROM k UNION ALL SELECT 900000002, a, 2000, 2000, 0 FROM r")
def _(spark, sf_dir):
    """More than one clip lies in the range, so it is flattened first; then the one clip carries the curve."""
    clips = _clips(spark, sf_dir)
    a = timeline.duration(clips) // 3
    if edits.range_fade(clips, a, a + 2000, True)[1] != 1:
        clips, _ = edits.flatten_range(clips, _sources(spark, sf_dir), a, a + 2000, 900000001, 900000002)
    return edits.range_fade(clips, a, a + 2000, True)[0].select("clip_id", "timeline_start", "length", "fade_in", "fade_out")


@query(
    "e13_cut_and_paste",
    f"""WITH {FADED}, r AS (SELECT 3000 AS a, 4000 AS b), {_LEFT}, cut AS (SELECT clip_id, CASE WHEN timeline_start >= 4000 THEN timeline_start - 1000 ELSE timeline_start END AS s, length AS l FROM k),
ins AS (SELECT clip_id, CASE WHEN s >= 8000 THEN s + 1000 ELSE s END AS s, CASE WHEN s < 8000 AND s + l > 8000 THEN 8000 - s ELSE l END AS l FROM cut UNION ALL SELECT clip_id, 9000, s + l - 8000 FROM cut WHERE s < 8000 AND s + l > 8000)
SELECT clip_id, s AS timeline_start, l AS length FROM ins UNION ALL SELECT 900000002, 8000, 1000""",
)
def _(spark, sf_dir):
    left, _ = edits.cut_range(_clips(spark, sf_dir), _sources(spark, sf_dir), 3000, 4000)
    return edits.paste(left, 8000, 1000, 900000001, 900000002).select("clip_id", "timeline_start", "length")


@query("e13_clipboard", f"WITH {SOUND} SELECT g.n, round(coalesce(x, 0), 6) AS x FROM range(0, 1000) g(n) LEFT JOIN p ON p.n = g.n + 3000")
def _(spark, sf_dir):
    return rounded(edits.cut_range(_clips(spark, sf_dir), _sources(spark, sf_dir), 3000, 4000)[1])


@query("e13_trim_to_selection", f"WITH {FADED}, m AS (SELECT max(e) // 4 AS a, 3 * (max(e) // 4) AS b FROM fe) SELECT clip_id, greatest(timeline_start, a) - a AS timeline_start, source_start + greatest(timeline_start, a) - timeline_start AS source_start, least(e, b) - greatest(timeline_start, a) AS length FROM fe, m WHERE timeline_start < b AND e > a")
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    d = timeline.duration(clips)
    return edits.keep_range(clips, d // 4, 3 * (d // 4), d).select("clip_id", "timeline_start", "source_start", "length")


@query("o2_ordered_insert", f"WITH {FADED}, b AS (SELECT clip_id, source_id, timeline_start FROM fc UNION ALL SELECT clip_id + 1000000000, source_id, timeline_start + 18 FROM fc) SELECT clip_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY timeline_start, clip_id) AS place FROM b")
def _(spark, sf_dir):
    clips = _clips(spark, sf_dir)
    more = clips.withColumns({"clip_id": F.col("clip_id") + 1000000000, "timeline_start": F.col("timeline_start") + 18})
    return edits.insert_ordered(clips, more).select("clip_id", "source_id", "place")


@query(
    "o11_range_intersection",
    f"WITH {FADED}, d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 7 AS s, l_partkey * 7 + 5 + l_suppkey % 40 AS e FROM lineitem) SELECT clip_id AS id, d.id AS other, greatest(timeline_start, s) AS start, least(fe.e, d.e) AS stop FROM fe JOIN d ON timeline_start < d.e AND s < fe.e",
)
def _(spark, sf_dir):
    a = _clips(spark, sf_dir).select(F.col("clip_id").alias("id"), F.col("timeline_start").alias("start"), (F.col("timeline_start") + F.col("length")).alias("stop"))
    li = model.table(spark, sf_dir, "lineitem")
    b = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), (F.col("l_partkey") * 7).cast("long").alias("start"), (F.col("l_partkey") * 7 + 5 + F.col("l_suppkey") % 40).cast("long").alias("stop"))
    return edits.intersect(a, b)


@query("e6_e7_markers", f"WITH {FADED}, d AS (SELECT clip_id, CASE WHEN timeline_start >= 6000 THEN timeline_start - 2000 WHEN timeline_start > 4000 THEN 4000 ELSE timeline_start END AS p FROM fc) SELECT clip_id, CASE WHEN p >= 5000 THEN p + 800 ELSE p END AS position FROM d")
def _(spark, sf_dir):
    m = _clips(spark, sf_dir).select("clip_id", F.col("timeline_start").alias("position"))
    return edits.shift_markers(edits.shift_markers(m, 4000, 6000), 5000, length=800)


@query("k10_consolidate", "SELECT c_custkey AS source_id, '/sessions/one/' || regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') || '-' || c_custkey || '.wav' AS path FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    """Of all sources, those without a path."""
    s = model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_name")).alias("path"))
    return edits.unwritten(s, "/sessions/one").select("source_id", "path")


@query("s8_silent_source", f"WITH {CLIPS}, g AS (SELECT source_id, max(length) AS f FROM clips WHERE source_id NOT IN (SELECT user_id FROM events) GROUP BY 1) SELECT source_id, unnest(range(0, f)) AS n, 0.0::DOUBLE AS x FROM g")
def _(spark, sf_dir):
    clips = model.clips(spark, sf_dir)
    missing = clips.join(_sources(spark, sf_dir).select("source_id").distinct(), "source_id", "left_anti")
    frames = missing.groupBy("source_id").agg(F.max("length").alias("f"))
    return frames.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("f") - 1)).alias("n"), F.lit(0.0).alias("x"))


@query(
    "e12_o7_undo_history",
    """WITH e AS (SELECT event_id, event_type, ts, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events), v AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS version FROM e),
l AS (SELECT CAST(version AS BIGINT) AS version, event_type AS label, count(*) AS edits, max(event_id) AS last FROM v GROUP BY 1, 2) SELECT version, label, edits FROM l WHERE version > (SELECT max(version) FROM l) - 128""",
)
def _(spark, sf_dir):
    """Edits with the label of the tip join its version; the newest 128 versions stay."""
    e = model.number(model.table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"])
    return session.coalesced(e.select("n", F.col("event_type").alias("label")), 128)
