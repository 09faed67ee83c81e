"""Queries of vector quantisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.operators import ordering as od
from stratum.operators import vq
from stratum.plans import sql as S
from stratum.plans.registry import query
from stratum.session import checkpoint_dir


def _vsum(c):
    return F.round(F.aggregate(F.col(c) if isinstance(c, str) else c, F.lit(0.0), lambda a, x: a + x), 6)


def _nearest_sql(name: str, src: str, id_col: str, vec: str, layer: int) -> str:
    return f"""{name}_d AS (
  SELECT s.{id_col} AS id, c.code,
         list_sum(list_transform(range(1, len(s.{vec}) + 1), lambda i: (s.{vec}[i] - c.centroid[i]) ** 2)) AS dist
  FROM {src} s JOIN f4 c ON c.layer = {layer}),
{name} AS (
  SELECT id AS {id_col}, code FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, code) AS rn FROM {name}_d) WHERE rn = 1)"""


_RVQ = S.with_(S.F4, S.VECS, _nearest_sql("l0", "vecs", "vec_id", "vec", 0)) + """,
res AS (
  SELECT v.vec_id, v.vec, l0.code AS code0, c.centroid AS c0,
         list_transform(range(1, len(v.vec) + 1), lambda i: v.vec[i] - c.centroid[i]) AS r
  FROM vecs v JOIN l0 USING (vec_id) JOIN f4 c ON c.layer = 0 AND c.code = l0.code),
""" + _nearest_sql("l1", "res", "vec_id", "r", 1) + """,
rvq AS (
  SELECT res.vec_id, res.vec, res.code0, l1.code AS code1, res.c0, c.centroid AS c1, res.r
  FROM res JOIN l1 USING (vec_id) JOIN f4 c ON c.layer = 1 AND c.code = l1.code)
"""


@query("v1_sample_vectors", S.with_(S.VECS) + f"""
SELECT CAST(row_number() OVER (ORDER BY {S.key('vec_id', 5)}, vec_id) - 1 AS INTEGER) AS slot, vec_id
FROM vecs ORDER BY {S.key('vec_id', 5)}, vec_id LIMIT 16""")
def v1_sample_vectors(spark, sf_dir):
    s = od.sample_vectors(fx.vectors(spark, sf_dir), "vec_id", 16, seed=5)
    return s.select(F.col("slot").cast("int"), "vec_id")


@query("v3_code_histogram", S.with_(S.F2) + """
SELECT CAST(r.code AS INTEGER) AS code, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM range(4096) r(code) LEFT JOIN (SELECT c AS code, count(*) AS n FROM (SELECT unnest(codes) AS c FROM f2) GROUP BY c) x
  ON x.code = r.code""")
def v3_code_histogram(spark, sf_dir):
    return vq.code_histogram(fx.utterances(spark, sf_dir), "codes", 4096)


@query("v4_assign_code", S.with_(S.F4, S.VECS, _nearest_sql("l0", "vecs", "vec_id", "vec", 0)) +
       "SELECT vec_id, CAST(code AS INTEGER) AS code FROM l0")
def v4_assign_code(spark, sf_dir):
    return vq.assign_code(fx.vectors(spark, sf_dir), fx.codebook(spark, sf_dir), layer=0)


@query("v5_lookup_code", S.with_(S.F4, S.VECS, _nearest_sql("l0", "vecs", "vec_id", "vec", 0)) + """
SELECT l0.vec_id, CAST(l0.code AS INTEGER) AS code, round(list_sum(c.centroid), 6) AS centroid_sum
FROM l0 JOIN f4 c ON c.layer = 0 AND c.code = l0.code""")
def v5_lookup_code(spark, sf_dir):
    cb = fx.codebook(spark, sf_dir)
    codes = vq.assign_code(fx.vectors(spark, sf_dir), cb, layer=0)
    return vq.lookup_code(codes, cb, 0).select("vec_id", "code", _vsum("centroid").alias("centroid_sum"))


@query("v6_rvq_encode", _RVQ + "SELECT vec_id, CAST(code0 AS INTEGER) AS code0, CAST(code1 AS INTEGER) AS code1 FROM rvq")
def v6_rvq_encode(spark, sf_dir):
    e = vq.rvq_encode(fx.vectors(spark, sf_dir), fx.codebook(spark, sf_dir), mode="residual")
    return e.select("vec_id", F.element_at("codes", 1).alias("code0"), F.element_at("codes", 2).alias("code1"))


@query("v6_rvq_decode", _RVQ + """
SELECT vec_id, round(list_sum(f), 6) AS feature_sum, round(list_sum(list_transform(f, lambda x: x * x)), 6) AS feature_sq
FROM (SELECT vec_id, list_transform(range(1, len(c0) + 1), lambda i: c0[i] + c1[i]) AS f FROM rvq)""")
def v6_rvq_decode(spark, sf_dir):
    cb = fx.codebook(spark, sf_dir)
    e = vq.rvq_encode(fx.vectors(spark, sf_dir), cb, mode="residual")
    d = vq.rvq_decode(e, cb, bins=16)
    return d.select("vec_id", _vsum("features").alias("feature_sum"),
                    _vsum(F.transform("features", lambda x: x * x)).alias("feature_sq"))


@query("v7_single_stage_vq", S.with_(S.F4, S.VECS, _nearest_sql("l0", "vecs", "vec_id", "vec", 0),
                                     _nearest_sql("l1", "vecs", "vec_id", "vec", 1)) + """
SELECT l0.vec_id, CAST(l0.code AS INTEGER) AS code0, CAST(l1.code AS INTEGER) AS code1,
       round(list_sum(c.centroid), 6) AS quantized_sum
FROM l0 JOIN l1 USING (vec_id) JOIN f4 c ON c.layer = 1 AND c.code = l1.code""")
def v7_single_stage_vq(spark, sf_dir):
    """V7 forward: every layer quantises the same input; the output is the last layer's vector."""
    e = vq.rvq_encode(fx.vectors(spark, sf_dir), fx.codebook(spark, sf_dir), mode="parallel", with_quantized=True)
    return e.select("vec_id", F.element_at("codes", 1).alias("code0"), F.element_at("codes", 2).alias("code1"),
                    _vsum("quantized").alias("quantized_sum"))


@query("v8_codes_to_features", S.with_(S.F2, S.F4) + """
, steps AS (
  SELECT doc_id, unnest(range(0, len(codes))) AS step, codes FROM f2)
SELECT doc_id, CAST(step AS INTEGER) AS step, round(list_sum(list_transform(range(1, 65), lambda i: a.centroid[i] + b.centroid[i])), 6) AS feature_sum
FROM (SELECT doc_id, step, codes[step + 1] % 16 AS k0, codes[len(codes) - step] % 16 AS k1 FROM steps) x
JOIN f4 a ON a.layer = 0 AND a.code = x.k0 JOIN f4 b ON b.layer = 1 AND b.code = x.k1""")
def v8_codes_to_features(spark, sf_dir):
    """Every utterance's F2 codes (mod 16) as layer 0 and, reversed in time, as layer 1 -> one feature vector per step."""
    layer = F.transform("codes", lambda c: F.pmod(c, F.lit(16)))
    u = fx.utterances(spark, sf_dir).select("doc_id", F.array(layer, F.reverse(layer)).alias("codes"))
    d = vq.codes_to_features(u, fx.codebook(spark, sf_dir), id_col="doc_id", bins=16)
    return d.select("doc_id", "step", _vsum("features").alias("feature_sum"))


@query("v11_quantisation_error", _RVQ + """,
losses AS (
  SELECT list_avg(list_transform(range(1, len(vec) + 1), lambda i: (vec[i] - c0[i]) ** 2)) AS l0,
         list_avg(list_transform(range(1, len(r) + 1), lambda i: (r[i] - c1[i]) ** 2)) AS l1 FROM rvq),
per AS (SELECT 0 AS layer, avg(l0) AS mse FROM losses UNION ALL SELECT 1, avg(l1) FROM losses)
SELECT CAST(layer AS INTEGER) AS layer, round(mse, 6) AS mse FROM per
UNION ALL SELECT -1, round(avg(mse), 6) FROM per""")
def v11_quantisation_error(spark, sf_dir):
    q = vq.quantisation_error(fx.vectors(spark, sf_dir), fx.codebook(spark, sf_dir))
    return q.select(F.col("layer").cast("int"), F.round("mse", 6).alias("mse"))


def _ema_state(spark, sf_dir):
    cb = fx.codebook(spark, sf_dir).where(F.col("layer") == 0)
    return cb.select("code", "centroid", F.lit(1.0).alias("cluster_size"), F.col("centroid").alias("embed_avg"))


_EMA_SQL = S.with_(S.F4, S.VECS, _nearest_sql("asg", "vecs", "vec_id", "vec", 0)) + """,
cnt AS (SELECT code, count(*) AS n FROM asg GROUP BY code),
sums AS (
  SELECT code, list(s ORDER BY d) AS s FROM (
    SELECT a.code, i AS d, sum(v.vec[i]) AS s FROM asg a JOIN vecs v USING (vec_id), range(1, 65) t(i)
    GROUP BY a.code, i) GROUP BY code),
st AS (
  SELECT c.code, 1.0::DOUBLE * 0.99::DOUBLE + coalesce(n, 0)::DOUBLE * (1.0::DOUBLE - 0.99::DOUBLE) AS cs,
         CASE WHEN s IS NULL THEN list_transform(c.centroid, lambda a: a * 0.99::DOUBLE)
              ELSE list_transform(range(1, len(c.centroid) + 1),
                                  lambda i: c.centroid[i] * 0.99::DOUBLE + s[i] * (1.0::DOUBLE - 0.99::DOUBLE)) END AS ea
  FROM f4 c LEFT JOIN cnt USING (code) LEFT JOIN sums USING (code) WHERE c.layer = 0),
fin AS (
  SELECT code, cs, ea, (cs + 1e-5) / (sum(cs) OVER () + 16 * 1e-5) * sum(cs) OVER () AS sm FROM st),
ema AS (SELECT code, cs, ea, list_transform(ea, lambda a: a / sm) AS centroid FROM fin)
"""


@query("v9_ema_update", _EMA_SQL + """
SELECT CAST(code AS INTEGER) AS code, round(cs, 6) AS cluster_size, round(list_sum(centroid), 6) AS centroid_sum
FROM ema""")
def v9_ema_update(spark, sf_dir):
    st = vq.ema_update(_ema_state(spark, sf_dir), fx.vectors(spark, sf_dir))
    return st.select("code", F.round("cluster_size", 6).alias("cluster_size"), _vsum("centroid").alias("centroid_sum"))


@query("v10_expire_codes", _EMA_SQL + f""",
samp AS (
  SELECT CAST(row_number() OVER (ORDER BY {S.key('vec_id', 0)}, vec_id) - 1 AS INTEGER) AS code, vec
  FROM vecs ORDER BY {S.key('vec_id', 0)}, vec_id LIMIT 16)
SELECT CAST(e.code AS INTEGER) AS code, e.cs < 2 AS expired,
       round(CASE WHEN e.cs < 2 THEN 1.0 ELSE e.cs END, 6) AS cluster_size,
       round(list_sum(CASE WHEN e.cs < 2 THEN s.vec ELSE e.centroid END), 6) AS centroid_sum
FROM ema e LEFT JOIN samp s USING (code)""")
def v10_expire_codes(spark, sf_dir):
    vecs = fx.vectors(spark, sf_dir)
    st = vq.ema_update(_ema_state(spark, sf_dir), vecs)
    ex = vq.expire_codes(st, vecs, threshold=2, seed=0)
    return ex.select("code", "expired", F.round("cluster_size", 6).alias("cluster_size"),
                     _vsum("centroid").alias("centroid_sum"))


@query("v12_bandwidth", S.with_(S.F2) + """
SELECT doc_id, CAST(len(codes) AS BIGINT) AS n_frames, round(len(codes) / 75.0, 6) AS duration_s,
       CAST(len(codes) * 12 AS BIGINT) AS bits, round(len(codes) * 12 * 75.0 / (len(codes) * 1000.0), 6) AS kbps,
       6 AS n_q_target
FROM f2""")
def v12_bandwidth(spark, sf_dir):
    r = vq.bandwidth_report(fx.utterances(spark, sf_dir), n_q=1, bins=4096, target_bandwidth=6.0)
    return r.select("doc_id", "n_frames", "duration_s", "bits", "kbps", "n_q_target")


def _nearest_in(name: str, src: str, book: str) -> str:
    return f"""{name}_d AS (
  SELECT s.vec_id AS id, b.code,
         list_sum(list_transform(range(1, len(s.vec) + 1), lambda i: (s.vec[i] - b.c[i]) ** 2)) AS dist
  FROM {src} s, {book} b),
{name} AS (
  SELECT id AS vec_id, code FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, code) AS rn FROM {name}_d) WHERE rn = 1)"""


def _update(name: str, assign: str, prev: str, src: str = "vecs", dim: int = 64) -> str:
    return f"""{name}_s AS (
  SELECT code, list(m ORDER BY d) AS c FROM (
    SELECT a.code, t.d, avg(v.vec[t.d]) AS m FROM {assign} a JOIN {src} v USING (vec_id), range(1, {dim + 1}) t(d)
    GROUP BY a.code, t.d) GROUP BY code),
{name} AS (SELECT p.code, coalesce(s.c, p.c) AS c FROM {prev} p LEFT JOIN {name}_s s USING (code))"""


_KMEANS2 = S.with_(S.VECS) + f""",
init AS (
  SELECT CAST(row_number() OVER (ORDER BY {S.key('vec_id', 0)}, vec_id) - 1 AS INTEGER) AS code, vec AS c
  FROM vecs ORDER BY {S.key('vec_id', 0)}, vec_id LIMIT 16),
{_nearest_in('a1', 'vecs', 'init')},
{_update('m1', 'a1', 'init')},
{_nearest_in('a2', 'vecs', 'm1')},
{_update('m2', 'a2', 'm1')}
SELECT m2.code, CAST(coalesce(b.n, 0) AS BIGINT) AS bins, round(list_sum(m2.c), 6) AS centroid_sum
FROM m2 LEFT JOIN (SELECT code, count(*) AS n FROM a2 GROUP BY code) b USING (code)"""


@query("v2_kmeans_two_rounds", _KMEANS2)
def v2_kmeans_two_rounds(spark, sf_dir):
    """k-means with 2 Lloyd rounds: the SQL oracle unrolls the same rounds."""
    km = vq.kmeans(fx.vectors(spark, sf_dir), 16, n_iters=2, seed=0)
    return km.select("code", "bins", _vsum("centroid").alias("centroid_sum"))


@query("v2_kmeans")
def v2_kmeans(spark, sf_dir):
    """Iterative (no SQL oracle): 16 means, 10 Lloyd rounds over all embeddings."""
    km = vq.kmeans(fx.vectors(spark, sf_dir), 16, n_iters=10, seed=0)
    return km.select("code", "bins", _vsum("centroid").alias("centroid_sum"))


@query("v2b_init_codebook")
def v2b_init_codebook(spark, sf_dir):
    """Initialise a codebook table once in the shared checkpoint folder; a second call reuses it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/codebook-{uuid.uuid4().hex}"
    vecs = fx.vectors(spark, sf_dir)
    vq.init_codebook(vecs, 16, path, n_iters=3)
    cb = vq.init_codebook(vecs, 16, path, n_iters=3)  # existing table: returned untouched
    return cb.select("layer", "code", "cluster_size", _vsum("centroid").alias("centroid_sum"))


# ---------------------------------------------------------------------- J2 end to end
_J2_SQL = S.with_(S.F5) + f""",
lens AS (SELECT series_id, max(pos) + 1 AS n FROM f5 GROUP BY series_id),
clips AS (SELECT f5.* FROM f5 JOIN lens USING (series_id) WHERE n >= 32),
clen AS (SELECT series_id, max(pos) + 1 AS n FROM clips GROUP BY series_id),
fr AS (
  SELECT series_id, win, CAST(pos - win * 8 AS INTEGER) AS i, value
  FROM (SELECT c.*, unnest(range(CAST(greatest(0, ceil((pos - 15) / 8.0)) AS BIGINT),
                                 CAST(least(floor(pos / 8.0), floor((n - 16) / 8.0)) AS BIGINT) + 1)) AS win
        FROM clips c JOIN clen USING (series_id))),
nrm AS (SELECT *, value / (1e-8 + sqrt(avg(value * value) OVER (PARTITION BY series_id, win))) AS v FROM fr),
fvecs AS (
  SELECT series_id::VARCHAR || ':' || win::VARCHAR AS vec_id, series_id, win, list(v ORDER BY i) AS vec
  FROM nrm GROUP BY series_id, win),
init AS (
  SELECT CAST(row_number() OVER (ORDER BY {S.key('vec_id', 0)}, vec_id) - 1 AS INTEGER) AS code, vec AS c
  FROM fvecs ORDER BY {S.key('vec_id', 0)}, vec_id LIMIT 16),
{_nearest_in('a1', 'fvecs', 'init')},
{_update('m1', 'a1', 'init', 'fvecs', 16)},
{_nearest_in('a2', 'fvecs', 'm1')},
{_update('m2', 'a2', 'm1', 'fvecs', 16)},
{_nearest_in('a3', 'fvecs', 'm2')}
SELECT f.series_id, CAST(count(*) AS BIGINT) AS n_frames,
       md5(array_to_string(list(a3.code ORDER BY f.win), ',')) AS codes_md5
FROM fvecs f JOIN a3 USING (vec_id) GROUP BY f.series_id"""


@query("j2_tokenise_series", _J2_SQL)
def j2_tokenise_series(spark, sf_dir):
    """J2 on series: clips of at least 32 samples (P7) -> frames of 16 every 8 (G1) -> RMS
    normalised (G2) -> a 16-code codebook fitted by k-means (V2, 2 rounds) -> nearest code per
    frame (V4) -> one codes array per clip."""
    from stratum.plans.jobs import tokenise_series

    codes, _ = tokenise_series(fx.series(spark, sf_dir, materialize=True), 16, 8, 32, 16, kmeans_iters=2)
    return codes.select("series_id", F.size("codes").cast("bigint").alias("n_frames"),
                        F.md5(F.array_join("codes", ",")).alias("codes_md5"))
