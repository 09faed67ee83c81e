import numpy as np

from stratum.operators import stats as st


def _np_cdf(counts, bits, roundoff=1e-8, min_range=2):
    pdf = np.array(counts, dtype=float) / sum(counts)
    pdf = np.floor(pdf / roundoff) * roundoff
    total = 2**bits
    alpha = min_range * len(pdf) / total
    ranges = np.floor((1 - alpha) * total * pdf).astype(np.int64) + min_range
    return np.cumsum(ranges)


def test_quantised_cdf_matches_numpy(spark):
    counts = [5, 0, 3, 9]
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate(counts) if c], "grp string, symbol int, n long")
    got = st.quantised_cdf(df, 4, 16).orderBy("symbol").toPandas()
    assert list(got.cdf) == list(_np_cdf(counts, 16))
    assert (np.diff(got.cdf) >= 2).all() and got.cdf.iloc[-1] <= 2**16


def test_topk_keeps_ties(spark):
    rows = [(f"vocos_{i}_0.{m}000.ckpt", "head.w", [float(i)]) for i, m in enumerate([1, 1, 2, 2, 3])]
    rows.append(("other_9_0.0000.ckpt", "head.w", [100.0]))
    rows.append(("vocos_0_0.1000.ckpt", "misc.w", [7.0]))
    df = spark.createDataFrame(rows, "file string, name string, vec array<double>")
    out = st.topk_average(df, 3).toPandas()
    # metrics 0.1000, 0.1000, 0.2000, 0.2000 all kept (rank <= 3), other_ and misc. dropped
    assert list(out.name) == ["head.w"] and out.value.iloc[0] == (0 + 1 + 2 + 3) / 4


def test_assert_uniform(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (1,)], "worker int")
    assert st.assert_uniform(df).first().uniform
    df2 = spark.createDataFrame([(0,), (0,), (1,)], "worker int")
    assert not st.assert_uniform(df2).first().uniform
