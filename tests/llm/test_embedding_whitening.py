from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from stratum.llm.embedding_whitening import bit_planes, cross_products, pack_vectors, quantise, unpack_vectors, whiten
from stratum.llm.queries import QUERIES

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                     T.StructField("label", T.IntegerType()), T.StructField("_id", T.StringType()), T.StructField("x", T.StringType()),
                     T.StructField("_v", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "a", "b", 2) for i, v in rows], VECS)


def brute(rows, top=4):
    """Exact centring in fractions, then numpy's eigenvectors."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, tuple(int(np.floor(256.0 * c)) for c in v)) for i, v in ok]
    fit = sorted(set(x for _, x in xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n) for j in range(d)]
                  for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:top]
    out = []
    for i, x in xs:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        w = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s)]) @ u[:, order] / np.sqrt(e[order])
        out += [(i, c + 1, n, dev, w[c], e[k] / np.trace(v)) for c, k in enumerate(order)]
    return out


def check(got, want):
    sign = {}
    by = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    got = sorted(((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got), key=by)
    want = sorted(want, key=by)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[5] == pytest.approx(w[5], rel=1e-9)
        if abs(w[4]) > 1e-3:
            assert sign.setdefault(g[1], np.sign(g[4] * w[4])) == np.sign(g[4] * w[4])
        assert abs(g[4]) == pytest.approx(abs(w[4]), rel=1e-7, abs=1e-8)


def rows_of(rng, n, d):
    return [(int(i), (rng.normal(size=d) * np.linspace(2, 0.1, d)).tolist()) for i in range(n)]


def test_planes_hold_every_bit():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 1 << 20, (131, 5)).astype(np.uint64)
    y[:, 2] = 0
    words, dim, bit = bit_planes(y)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :131].astype(np.uint64)
    back = np.zeros_like(y)
    for line, c, b in zip(bits, dim, bit):
        back[:, c] += line << np.uint64(b)
    assert (back == y).all() and 2 not in dim


@pytest.mark.parametrize("low, high", [(-300, 300), (5, 6), (-(1 << 40), 1 << 40), (-(1 << 62), 1 << 62)])
def test_cross_products_are_exact(low, high):
    x = np.random.default_rng(2).integers(low, high, (201, 4))
    x[0] = [np.iinfo(np.int64).min, np.iinfo(np.int64).max, low, low] if high > 1 << 60 else x[0]
    sums, cross = cross_products(x)
    exact = x.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (cross == exact.T @ exact).all()


def test_packed_vectors_are_canonical():
    x = np.array([[1, -128], [127, 0], [128, 0], [-129, 5], [1 << 20, 0], [-(1 << 31), 1], [1 << 31, 0], [np.iinfo(np.int64).min, 1], [0, 0]])
    packed = pack_vectors(x)
    assert [b[0] for b in packed.to_pylist()] == [1, 1, 2, 2, 4, 4, 8, 8, 1]
    mixed = pa.concat_arrays([packed, pack_vectors(np.zeros((2, 0), np.int64)), pack_vectors(np.ones((1, 3), np.int64))])
    back = {int(r): v.tolist() for at, m in unpack_vectors(mixed) for r, v in zip(at, m)}
    assert [back[i] for i in range(len(mixed))] == [*x.tolist(), [], [], [1, 1, 1]]


def test_quantise_floors_and_saturates():
    got = quantise(np.array([0.0, -0.0, 0.5, -0.001, 1e300, -1e308])).tolist()
    assert got == [0, 0, 128, -1, np.iinfo(np.int64).max, np.iinfo(np.int64).min]


def test_against_brute_force_with_copies_nulls_and_bad_rows(spark):
    rng = np.random.default_rng(7)
    rows = rows_of(rng, 300, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are copies of one vector
    good = rows + [rows[5], (None, rows[6][1]), (None, [0.0] * 6)]
    bad = [(2000, None), (2001, [None] + [1.0] * 5), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    got = whiten(frame(spark, good + bad)).collect()
    check(got, brute(good))
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] <= 1e-8


def test_few_dimensions_constant_dimension_and_rank(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(a), 0.25, 2 * float(a)]) for i, a in enumerate(rng.integers(-200, 200, 50) / 256)]
    got = whiten(frame(spark, rows)).collect()
    check(got, [w for w in brute(rows, top=1)])


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-(1 << 40), 1 << 40, 3) / 256.0).tolist()) for i in range(70)]
    check(whiten(frame(spark, rows)).collect(), brute(rows))


def test_vectors_of_another_length_have_no_components(spark):
    rows = rows_of(np.random.default_rng(4), 40, 3)
    got = whiten(frame(spark, rows + [(900, [1.0, 2.0]), (901, [])])).collect()
    check(got, brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_without_variance_there_are_no_rows(spark, rows):
    assert whiten(frame(spark, rows)).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rows = rows_of(np.random.default_rng(11), 200, 5)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["op13_embedding_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    check(out.collect(), brute(rows))
