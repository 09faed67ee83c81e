"""Queries of series (G1-G8) and statistics (A1-A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.operators import ordering as od
from stratum.operators import series as sr
from stratum.operators import stats as st
from stratum.plans import sql as S
from stratum.plans.registry import query
from stratum.session import table

L, OV = 16, 0.25
STRIDE = sr.segment_stride(L, OV)  # 12

_SEG_SQL = S.with_(S.F5) + f""",
seg AS (
  SELECT series_id, CAST(win AS INTEGER) AS win, CAST(pos - win * {STRIDE} AS INTEGER) AS i, value
  FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - {L - 1}) / {float(STRIDE)})) AS BIGINT),
                               CAST(floor(pos / {float(STRIDE)}) AS BIGINT) + 1)) AS win FROM f5)),
nrm AS (
  SELECT *, 1e-8 + sqrt(avg(value * value) OVER (PARTITION BY series_id, win)) AS scale FROM seg)
"""


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("g1_segment", _SEG_SQL + "SELECT series_id, win, i, value FROM seg")
def g1_segment(spark, sf_dir):
    return sr.segment(fx.series(spark, sf_dir), L, OV).select("series_id", "win", "i", "value")


@query("g2_rms_normalise", _SEG_SQL + """
SELECT series_id, win, i, round(value / scale, 6) AS value, round(scale, 6) AS scale FROM nrm""")
def g2_rms_normalise(spark, sf_dir):
    n = sr.rms_normalise(sr.segment(fx.series(spark, sf_dir), L, OV))
    return n.select("series_id", "win", "i", _r("value").alias("value"), _r("scale").alias("scale"))


@query("g2_rms_restore", _SEG_SQL + "SELECT series_id, win, i, round(value, 6) AS value FROM seg")
def g2_rms_restore(spark, sf_dir):
    n = sr.rms_restore(sr.rms_normalise(sr.segment(fx.series(spark, sf_dir), L, OV)))
    return n.select("series_id", "win", "i", _r("value").alias("value"))


@query("g3_overlap_add", _SEG_SQL + f"""
SELECT series_id, pos, round(sum(w * v) / sum(w), 6) AS value
FROM (SELECT series_id, CAST(win * {STRIDE} + i AS INTEGER) AS pos,
             0.5 - abs((i + 1) / {float(L + 1)} - 0.5) AS w, value / scale AS v FROM nrm)
GROUP BY series_id, pos""")
def g3_overlap_add(spark, sf_dir):
    """G1 -> G2 (normalise each window) -> G3: recombined normalised signal."""
    n = sr.rms_normalise(sr.segment(fx.series(spark, sf_dir), L, OV))
    o = sr.overlap_add(n, L, STRIDE)
    return o.select("series_id", "pos", _r("value").alias("value"))


_FRAMES_SQL = S.with_(S.F5) + """,
lens AS (SELECT series_id, max(pos) + 1 AS n FROM f5 GROUP BY series_id),
fr AS (
  SELECT series_id, CAST(win AS INTEGER) AS win, CAST(pos - win * 8 AS INTEGER) AS i, value
  FROM (SELECT f5.*, unnest(range(CAST(greatest(0, ceil((pos - 15) / 8.0)) AS BIGINT),
                                  CAST(least(floor(pos / 8.0), floor((n - 16) / 8.0)) AS BIGINT) + 1)) AS win
        FROM f5 JOIN lens USING (series_id)))
"""


@query("g1_frames", _FRAMES_SQL + "SELECT series_id, win, i, value FROM fr")
def g1_frames(spark, sf_dir):
    """Frames of 16 every 8 positions, incomplete last frame dropped."""
    return sr.frames(fx.series(spark, sf_dir, materialize=True), 16, 8).select("series_id", "win", "i", "value")


@query("g3_overlap_add_envelope", _FRAMES_SQL + """
SELECT series_id, pos, round(CASE WHEN ww > 1e-11 THEN wv / ww END, 6) AS value
FROM (SELECT series_id, CAST(win * 8 + i AS INTEGER) AS pos, sum(w * value) AS wv, sum(w * w) AS ww
      FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() / 16 * i) AS w FROM fr) GROUP BY ALL)""")
def g3_overlap_add_envelope(spark, sf_dir):
    o = sr.overlap_add_envelope(sr.frames(fx.series(spark, sf_dir, materialize=True), 16, 8), 16, 8)
    return o.select("series_id", "pos", _r("value").alias("value"))


@query("g4_log_ops", """
SELECT event_id, round(ln(greatest(value, 1e-7)), 6) AS safe_log,
       round(sign(value) * ln(1 + abs(value)), 6) AS symlog,
       round(sign(sign(value) * ln(1 + abs(value))) * (exp(abs(sign(value) * ln(1 + abs(value)))) - 1), 6)
         AS roundtrip
FROM events""")
def g4_log_ops(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", _r(sr.safe_log("value")).alias("safe_log"), _r(sr.symlog("value")).alias("symlog"),
                     _r(sr.symexp(sr.symlog("value"))).alias("roundtrip"))


@query("g5_limit_peak", S.with_(S.F5) + """,
pk AS (SELECT series_id, max(abs(value)) AS mx FROM f5 GROUP BY series_id)
SELECT series_id, pos, round(value * CASE WHEN mx > 0 THEN least(0.99 / mx, 1.0) ELSE 1.0 END, 6) AS value,
       round(greatest(-0.99, least(0.99, value)), 6) AS clamped
FROM f5 JOIN pk USING (series_id)""")
def g5_limit_peak(spark, sf_dir):
    """Both modes in one pass: ``clamped`` is a projection, ``value`` is rescaled by the peak."""
    s = sr.limit_peak(fx.series(spark, sf_dir, materialize=True), rescale=False, out_col="clamped")
    r = sr.limit_peak(s, rescale=True)
    return r.select("series_id", "pos", _r("value").alias("value"), _r("clamped").alias("clamped"))


def _stereo(spark, sf_dir):
    s = fx.series(spark, sf_dir, materialize=True)
    return s.select("series_id", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("channel"), F.col("value").alias("value")),
        F.struct(F.lit(1).alias("channel"), (F.col("value") * 0.5).alias("value")))).alias("c")).select(
        "series_id", "pos", "c.channel", "c.value")


@query("g6_downmix", S.with_(S.F5) + """
SELECT series_id, pos, round((value + value * 0.5) / 2, 6) AS value FROM f5""")
def g6_downmix(spark, sf_dir):
    d = sr.convert_channels(_stereo(spark, sf_dir), 1, channels=2)
    return d.select("series_id", "pos", _r("value").alias("value"))


@query("g6_expand_channels", S.with_(S.F5) + """
SELECT series_id, pos, CAST(c AS INTEGER) AS channel, value FROM f5, range(3) t(c)""")
def g6_expand_channels(spark, sf_dir):
    mono = fx.series(spark, sf_dir).withColumn("channel", F.lit(0))
    return sr.convert_channels(mono, 3, channels=1).select("series_id", "pos", "channel", "value")


@query("g7_pad_series", S.with_(S.F5) + """,
lens AS (SELECT series_id, max(pos) + 1 AS n FROM f5 GROUP BY series_id),
ext AS (SELECT series_id, n, CAST((ceil((n - 16) / 8.0 + 1) - 1) * 8 + 16 - n AS INTEGER) AS extra FROM lens),
pp AS (SELECT series_id, n, CASE WHEN n <= 5 THEN 6 ELSE n END AS n2, unnest(range(-5, n + 5 + extra)) AS p FROM ext),
src AS (
  SELECT series_id, p, CASE WHEN p >= n + 5 THEN NULL WHEN p < 0 THEN -p WHEN p >= n2 THEN 2 * (n2 - 1) - p ELSE p END AS s
  FROM pp)
SELECT src.series_id, CAST(p + 5 AS INTEGER) AS pos, coalesce(f5.value, 0.0) AS value
FROM src LEFT JOIN f5 ON f5.series_id = src.series_id AND f5.pos = src.s""")
def g7_pad_series(spark, sf_dir):
    p = sr.pad_series(fx.series(spark, sf_dir, materialize=True), 5, 5, mode="reflect", extra_for=(16, 8))
    return p.select("series_id", "pos", "value")


@query("g7_unpad_series", S.with_(S.F5) + "SELECT series_id, pos, value FROM f5")
def g7_unpad_series(spark, sf_dir):
    """pad (zero, 4 / 7) then unpad: the original series back."""
    p = sr.pad_series(fx.series(spark, sf_dir, materialize=True), 4, 7, mode="zero")
    return sr.unpad_series(p, 4, 7).select("series_id", "pos", "value")


@query("g8_resample_series", """
WITH ev AS (SELECT user_id AS series_id, epoch_us(ts) AS t, event_id, value FROM events),
span AS (SELECT series_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY series_id),
grid AS (
  SELECT series_id, unnest(range(CAST(ceil(lo / 3600000000.0) * 3600000000 AS BIGINT), hi + 1, 3600000000)) AS t
  FROM span),
prv AS (SELECT g.series_id, g.t, arg_max(e.value, e.event_id) AS pv, max(e.t) AS pt
        FROM grid g JOIN ev e ON e.series_id = g.series_id AND e.t = (
          SELECT max(t) FROM ev x WHERE x.series_id = g.series_id AND x.t <= g.t)
        GROUP BY g.series_id, g.t),
nxt AS (SELECT g.series_id, g.t, arg_min(e.value, e.event_id) AS nv, min(e.t) AS nt
        FROM grid g JOIN ev e ON e.series_id = g.series_id AND e.t = (
          SELECT min(t) FROM ev x WHERE x.series_id = g.series_id AND x.t >= g.t)
        GROUP BY g.series_id, g.t)
SELECT series_id, t AS t_us,
       round(CASE WHEN nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt)::DOUBLE / (nt - pt)::DOUBLE END, 6) AS value
FROM prv JOIN nxt USING (series_id, t)""")
def g8_resample_series(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", "value")
    r = sr.resample_series(ev, 3600)
    return r.select("series_id", "t_us", _r("value").alias("value"))


# ------------------------------------------------------------------ statistics
@query("a1_quantised_cdf", S.with_(S.F7) + f""",
full_ AS (
  SELECT g.grp, CAST(s.symbol AS INTEGER) AS symbol, coalesce(f7.n, 0) AS n
  FROM (SELECT DISTINCT grp FROM f7) g CROSS JOIN range(64) s(symbol)
  LEFT JOIN f7 ON f7.grp = g.grp AND f7.symbol = s.symbol),
pdf AS (SELECT grp, symbol, floor((n::DOUBLE / sum(n) OVER (PARTITION BY grp)) / 1e-8) * 1e-8 AS p FROM full_),
rng AS (SELECT grp, symbol, CAST(floor({(1 - 2 * 64 / 2**24) * 2**24!r} * p) + 2 AS BIGINT) AS range FROM pdf)
SELECT grp, symbol, range, CAST(sum(range) OVER (PARTITION BY grp ORDER BY symbol) AS BIGINT) AS cdf FROM rng""")
def a1_quantised_cdf(spark, sf_dir):
    return st.quantised_cdf(fx.symbols(spark, sf_dir), cardinality=64, total_range_bits=24)


@query("a2_weighted_metrics", S.with_(S.F6) + """
SELECT name, round(sum(value * weight) / sum(weight), 6) AS avg_value FROM f6 GROUP BY name""")
def a2_weighted_metrics(spark, sf_dir):
    return st.weighted_metrics(fx.metrics(spark, sf_dir)).select("name", _r("avg_value").alias("avg_value"))


@query("a3_assert_uniform", S.with_(S.F6) + """
SELECT CAST(count(*) AS BIGINT) AS n_workers, CAST(min(c) AS BIGINT) AS min_count, CAST(max(c) AS BIGINT) AS max_count,
       CAST(sum(c) AS BIGINT) AS total, sum(c) = min(c) * count(*) AS uniform
FROM (SELECT worker, count(*) AS c FROM f6 GROUP BY worker)""")
def a3_assert_uniform(spark, sf_dir):
    return st.assert_uniform(fx.metrics(spark, sf_dir), "worker")


@query("a4_topk_average", S.with_(S.F8) + """,
files AS (SELECT DISTINCT file FROM f8 WHERE starts_with(file, 'vocos_')),
ranked AS (SELECT file, rank() OVER (ORDER BY substr(file, length(file) - 10, 6)) AS r FROM files)
SELECT name, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value
FROM (SELECT f8.name, unnest(f8.vec) AS x, unnest(range(len(f8.vec))) AS pos
      FROM f8 JOIN ranked USING (file)
      WHERE r <= 3 AND (starts_with(name, 'backbone.') OR starts_with(name, 'head.')
                        OR starts_with(name, 'feature_extractor.')))
GROUP BY name, pos""")
def a4_topk_average(spark, sf_dir):
    t = st.topk_average(fx.checkpoints(spark, sf_dir))
    return t.select("name", F.col("pos").cast("int"), _r("value").alias("value"))


@query("a5_rolling_throughput", S.with_(S.F5.replace(", value", ", value, epoch_us(ts) / 1e6 AS time_s")) + """
SELECT series_id, pos,
  round(CASE WHEN dt > 0 THEN (pos + 1 - first_s) / dt END, 6) AS samples_per_sec,
  round(CASE WHEN dt > 0 THEN (sv - first_v) / dt END, 6) AS items_per_sec
FROM (SELECT series_id, pos,
        time_s - first(time_s) OVER w AS dt, first(pos + 1) OVER w AS first_s,
        sum(value) OVER w AS sv, first(value) OVER w AS first_v
      FROM f5 WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""")
def a5_rolling_throughput(spark, sf_dir):
    """Events per user as training-log records: samples = records so far, items = running value."""
    ev = table(spark, sf_dir, "events")
    ev = ev.select("user_id", "ts", "event_id", "value", (sr.micros(ev, "ts") / F.lit(1e6)).alias("time_s"),
                   F.col("ts").cast("date").alias("_chunk"))
    s = od.dense_position(ev, ["user_id"], "_chunk", ["ts", "event_id"])
    rec = s.select(F.col("user_id").alias("series_id"), F.col("_pos").cast("int").alias("pos"), "time_s",
                   (F.col("_pos") + 1).cast("double").alias("samples"), "value")
    r = sr.rolling_throughput(rec, window=50, items_col="value", items_are_increments=True, chunk_rows=16)
    return r.select("series_id", "pos", _r("samples_per_sec").alias("samples_per_sec"),
                    _r("items_per_sec").alias("items_per_sec"))
