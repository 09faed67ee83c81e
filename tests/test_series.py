import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratum.operators import series as sr


def _series(spark, values_by_id):
    rows = [(sid, i, float(v)) for sid, vals in values_by_id.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "series_id long, pos int, value double")


def test_segment_overlap_add_identity(spark):
    rng = np.random.default_rng(0)
    df = _series(spark, {1: rng.normal(size=50), 2: rng.normal(size=7)})
    seg = sr.segment(df, 8, 0.25)
    back = sr.overlap_add(seg, 8, sr.segment_stride(8, 0.25)).toPandas().sort_values(["series_id", "pos"])
    orig = df.toPandas().sort_values(["series_id", "pos"])
    assert np.allclose(back.value.to_numpy(), orig.value.to_numpy())


def test_rms_restore_identity_and_zero_series(spark):
    df = _series(spark, {1: [0.0, 0.0, 0.0], 2: [1.0, -2.0, 3.0]})
    seg = sr.segment(df, None)
    n = sr.rms_normalise(seg)
    r = sr.rms_restore(n).toPandas().sort_values(["series_id", "pos"])
    assert np.allclose(r.value, [0, 0, 0, 1, -2, 3])
    peak = sr.limit_peak(df).toPandas().sort_values(["series_id", "pos"])
    assert np.allclose(peak.value, [0, 0, 0, 0.33, -0.66, 0.99])


def _pad1d_reflect(x, left, right):
    n = len(x)
    m = max(left, right)
    extra = m - n + 1 if n <= m else 0
    xe = np.concatenate([x, np.zeros(extra)])
    p = np.pad(xe, (left, right), mode="reflect")
    return p[: len(p) - extra]


def test_reflect_pad_short_and_long(spark):
    data = {1: [1.0, 2.0, 3.0], 2: list(np.arange(1.0, 11.0))}
    out = sr.pad_series(_series(spark, data), 4, 4, mode="reflect").toPandas()
    for sid, vals in data.items():
        got = out[out.series_id == sid].sort_values("pos").value.to_numpy()
        assert np.allclose(got, _pad1d_reflect(np.array(vals), 4, 4))


def test_pad_unpad_roundtrip(spark):
    df = _series(spark, {1: [1.0, 2.0, 3.0, 4.0]})
    back = sr.unpad_series(sr.pad_series(df, 2, 3), 2, 3).toPandas().sort_values("pos")
    assert list(back.value) == [1.0, 2.0, 3.0, 4.0]


def test_halo_rolling_equals_plain_window(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"series_id": 1, "pos": np.arange(n), "time_s": np.cumsum(rng.random(n)),
                        "samples": np.arange(1, n + 1).astype(float), "items": np.cumsum(rng.random(n))})
    df = spark.createDataFrame(pdf)
    got = sr.rolling_throughput(df, window=50, chunk_rows=16).toPandas().sort_values("pos")
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-49, 0)
    dt = F.col("time_s") - F.first("time_s").over(w)
    ref = df.select("pos", F.when(dt > 0, (F.col("items") - F.first("items").over(w)) / dt).alias("r")) \
        .toPandas().sort_values("pos")
    assert np.allclose(got.items_per_sec.fillna(-1).to_numpy(), ref.r.fillna(-1).to_numpy())


def test_convert_channels_errors(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0)], "series_id long, channel int, pos int, value double")
    try:
        sr.convert_channels(df, 1, channels=3)
        raise AssertionError
    except ValueError:
        pass


def test_results_do_not_depend_on_session_time_zone(spark):
    import __spark_entry__ as E
    from tests.conftest import SMOKE

    qs = E.queries()
    base = {n: sorted(map(tuple, qs[n](spark, SMOKE).collect())) for n in ("g3_overlap_add", "g8_resample_series",
                                                                           "a5_rolling_throughput")}
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for n, rows in base.items():
            assert sorted(map(tuple, qs[n](spark, SMOKE).collect())) == rows, n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_resampling_makes_the_grid_chunk_by_chunk(spark):
    """Chunks of any length give the same grid, shorter or longer than a step, and no array outgrows its chunk."""
    ev = spark.sql("""SELECT cast(s AS bigint) series_id, timestamp_seconds(1700000003 + i * 977 + s * 31) ts, cast(i AS bigint) event_id, cast(i * i % 17 AS double) value
                      FROM VALUES (0), (1), (2) v(s) LATERAL VIEW explode(sequence(0, 40 - 20 * s)) AS i""")
    want = None
    for chunk in (86_400, 3_600, 250):
        got = sorted(tuple(r) for r in sr.resample_series(ev, 300, chunk_seconds=chunk).collect())
        want = want or got
        assert got == want and len(got) > 100


def test_resampling_neither_shuffles_nor_sorts_grid_points(spark):
    """Points are made last, from pairs of neighbouring events: above the step that makes them nothing sorts, joins or deals."""
    ev = spark.sql("""SELECT cast(s AS bigint) series_id, timestamp_seconds(1700000003 + i * 977) ts, cast(i AS bigint) event_id, cast(i AS double) value
                      FROM VALUES (0), (1) v(s) LATERAL VIEW explode(sequence(0, 40)) AS i""")
    plan = sr.resample_series(ev, 300)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert "Generate" in plan and not any(x in above for x in ("Join", "Window", "Sort", "Aggregate", "Repartition")), plan


def test_resampling_across_empty_chunks_ties_and_rows_without_keys(spark):
    day, t0 = 86_400, 1_700_006_400  # a midnight
    rows = [(1, t0 + 1800, 1, 1.0), (1, t0 + 3 * day, 2, 4.0), (1, t0 + 3 * day, 3, 5.0), (1, t0 + 3 * day + 3600, 4, 6.0),
            (None, t0, 5, 1.0), (None, t0 + 7200, 6, 3.0), (None, t0 + day, 7, 9.0), (2, None, 8, 1.0)]
    ev = spark.createDataFrame(rows, "series_id long, s long, event_id long, value double").selectExpr("series_id", "timestamp_seconds(s) ts", "event_id", "value")
    got = {(r[0], r[1] // 1_000_000 - t0): r[2] for r in sr.resample_series(ev, 3600).collect()}
    assert sorted(t for s, t in got if s == 1) == list(range(3600, 3 * day + 3601, 3600)) and not any(s == 2 for s, _ in got)
    assert got[1, 3 * day] == 5.0 and got[1, 3 * day + 3600] == 6.0
    assert np.isclose(got[1, day], 1.0 + 3.0 * (day - 1800) / (3 * day - 1800))
    assert [got[None, t] for t in (0, 3600, 7200, 10_800, day)] == [1.0, 2.0, 3.0, None, 9.0] and len([1 for s, _ in got if s is None]) == 25
