"""Operator 13: embedding whitening from an exact, bit-sliced scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import discard, materialise

LIMB = 30
_STATS = "d int, i int, j int, limb int, v bigint"


# ------------------------------------------------------------------ vectors as bytes
def quantise(values: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * c) as int64; what lies outside int64 becomes its nearest bound."""
    with np.errstate(over="ignore"):
        f = np.floor(values * scale)
    inside = np.where((f >= -2.0**63) & (f < 2.0**63), f, 0.0).astype(np.int64)
    top = np.iinfo(np.int64)
    return np.where(f >= 2.0**63, top.max, np.where(f < -2.0**63, top.min, inside))


def pack_vectors(x: np.ndarray) -> pa.Array:
    """Rows of int64 as bytes: the width in bytes of an entry (1, 2, 4 or 8, the least that holds the row), then the
    entries. Equal vectors have equal bytes and the reverse."""
    most = np.maximum(x.max(axis=1, initial=-1), ~x.min(axis=1, initial=0)) if len(x) else np.zeros(0, np.int64)
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    parts, order = [], []
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        if len(rows):
            body = x[rows].astype(f"<i{w}").view(np.uint8).reshape(len(rows), -1)
            block = np.concatenate([np.full((len(rows), 1), w, np.uint8), body], axis=1)
            kind = pa.binary(block.shape[1])
            parts.append(pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [None, pa.py_buffer(block.tobytes())]).cast(pa.binary()))
            order.append(rows)
    if not parts:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def unpack_vectors(packed: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as an int64 matrix) for each length and width among ``packed``."""
    kind = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    at = np.frombuffer(packed.buffers()[1], kind)[packed.offset:packed.offset + len(packed) + 1].astype(np.int64)
    if not len(packed):
        return
    raw = np.frombuffer(packed.buffers()[2], np.uint8)
    shape = np.stack([np.diff(at), raw[at[:-1]].astype(np.int64)], axis=1)
    for size, w in np.unique(shape, axis=0):
        rows = np.flatnonzero((shape[:, 0] == size) & (shape[:, 1] == w))
        block = raw[at[rows][:, None] + np.arange(1, size)]
        yield rows, np.ascontiguousarray(block).view(f"<i{w}").reshape(len(rows), -1).astype(np.int64)


# ------------------------------------------------------------------ the bit-sliced scatter
def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of ``y`` (uint64, rows by dimensions): one line of 64-bit words across the rows for each
    dimension and bit in use, with the dimension and the bit of each line, by dimension."""
    used = [int(v).bit_length() for v in y.max(axis=0)]
    words, dims, bits = [], [], []
    for bit in range(max(used, default=0)):
        cols = np.array([c for c, n in enumerate(used) if n > bit])
        flags = ((y[:, cols] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(flags, axis=0, bitorder="little")
        padded = np.zeros((-(-len(packed) // 8) * 8, len(cols)), np.uint8)
        padded[:len(packed)] = packed
        words.append(np.ascontiguousarray(padded.T).view("<u8"))
        dims.append(cols)
        bits.append(np.full(len(cols), bit))
    if not words:
        return np.zeros((0, 1), "<u8"), np.zeros(0, int), np.zeros(0, int)
    dim, bit = np.concatenate(dims), np.concatenate(bits)
    order = np.lexsort((bit, dim))
    return np.concatenate(words)[order], dim[order], bit[order]


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and cross-products of an int64 matrix, as Python integers.

    The columns are shifted by their minima so that no entry is negative; the product sum of two shifted columns is the sum
    over their bit planes a, b of 2^(a + b) times the number of rows where both bits are set. The shift is undone in integers."""
    n, d = x.shape
    low = x.min(axis=0)
    planes, dim, bit = bit_planes(x.astype(np.uint64) - low.astype(np.uint64))
    both = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        both[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    both += np.triu(both, 1).T
    small = len(bit) == 0 or 2 * int(bit.max()) + int(n).bit_length() + 14 < 63
    weight = (1 << bit) if small else np.array([1 << int(b) for b in bit], dtype=object)
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    if len(planes):
        first = np.flatnonzero(np.diff(dim, prepend=-1))
        used = dim[first]
        weighted = (both if small else both.astype(object)) * weight[:, None] * weight[None, :]
        y = np.add.reduceat(np.add.reduceat(weighted, first, axis=0), first, axis=1)
        cross[np.ix_(used, used)] = y.astype(object)
        ones = np.diagonal(both) if small else np.diagonal(both).astype(object)
        sums[used] = np.add.reduceat(ones * weight, first).astype(object)
    low = low.astype(object)
    cross = cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, cross


def _limbs(v: int) -> Iterator[tuple[int, int]]:
    """An integer as (k, digit) with v the sum of digit * 2^(LIMB * k), so that sums of digits stay in 64 bits."""
    k = 0
    while not -(1 << LIMB) <= v < 1 << LIMB:
        yield k, v & ((1 << LIMB) - 1)
        v >>= LIMB
        k += 1
    yield k, v


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row counts (i = j = -1), sums (j = -1) and cross-products (i <= j) of a task's vectors, by their length d."""
    found: dict[int, list] = {}
    for b in batches:
        for _, x in unpack_vectors(b.column(0)):
            sums, cross = cross_products(x)
            have = found.setdefault(x.shape[1], [0, 0, 0])
            found[x.shape[1]] = [have[0] + len(x), have[1] + sums, have[2] + cross]
    for d, (n, sums, cross) in found.items():
        rows = [(d, -1, -1, k, v) for k, v in _limbs(int(n))]
        for i in range(d):
            rows += [(d, i, -1, k, v) for k, v in _limbs(int(sums[i]))]
            rows += [(d, i, j, k, v) for j in range(i, d) for k, v in _limbs(int(cross[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in list(zip(*rows))[:4]] + [pa.array([r[4] for r in rows], pa.int64())],
                                         ["d", "i", "j", "limb", "v"])


@dataclass
class Whitener:
    """What the fit list gives: n vectors of ``dim`` entries, their sums, and the components by falling eigenvalue."""

    n: int
    dim: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Whitened components (rows by components) and the exact deviation of each row of ``x``."""
        most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        small = most * most * max(1, self.dim) < 1 << 62
        sums = np.array(self.sums, dtype=np.int64 if small else object)
        off = (x if small else x.astype(object)) * self.n - sums
        w = (off / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)
        return w, (off * off).sum(axis=1).tolist()


def solve(n: int, dim: int, sums: list, cross: dict, components: int, least: float) -> Whitener:
    """Centres in integers (n * cross-product - product of sums), divides by n^2 once, then takes the eigenvectors.

    Components whose eigenvalue is not above ``least`` times the largest are left out: they can't be scaled to unit variance."""
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * cross[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v) if dim else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    order = [k for k in order if values[k] > least * values.max()]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))]) if len(order) else np.ones(0)
    return Whitener(n, dim, sums, values[order], vectors * sign, float(np.trace(v)))


def fit_whitener(fit: DataFrame, components: int = 4, least: float = 1e-12) -> Whitener:
    """The whitener of a table of distinct packed vectors (column x).

    Each task sums its batches by bit planes, the sums are added up by Spark, digit by digit and exactly; the driver gets the
    sums of one vector length: d * (d + 3) / 2 numbers, whatever the rows. Vectors of the commonest length make the list (of
    equally common ones the longest)."""
    stats = fit.mapInArrow(_scatter, _STATS).groupBy("d", "i", "j", "limb").agg(F.sum("v").alias("v"))
    stats = materialise(stats, "op13-stats")
    size = stats.where("i = -1").groupBy("d").agg(F.sum(F.col("v") * F.pow(F.lit(2.0), F.col("limb") * LIMB)).alias("n"))
    first = size.orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return Whitener(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    total: dict = {}
    for i, j, limb, v in stats.where(F.col("d") == first["d"]).select("i", "j", "limb", "v").toLocalIterator():
        total[i, j] = total.get((i, j), 0) + (v << (LIMB * limb))
    discard(stats)
    return solve(total[-1, -1], first["d"], [total[i, -1] for i in range(first["d"])], total, components, least)


def _projected(rows: DataFrame, by: Whitener, id_type: str) -> DataFrame:
    """(_id, deviation as text, w) of the rows (_id, x) that have the whitener's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in unpack_vectors(b.column(1)):
                if x.shape[1] != by.dim:
                    continue
                w, deviation = by.project(x)
                ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([str(v) for v in deviation], pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(w).reshape(-1)))], ["_id", "deviation", "w"])

    return rows.mapInArrow(run, f"_id {id_type}, deviation string, w array<double>")


def whiten(embeddings: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding", least: float = 1e-12) -> DataFrame:
    """One row per remaining input row and component: ``id_col``, component (from 1), n, deviation (decimal(38,0)), whitened,
    explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries go. An entry c becomes x = floor(scale * c). The fit list is each
    distinct x vector once, whatever its number of copies; all covariances are over it, with divisor n. ``deviation`` is the sum
    over dimensions of (n * x - S)^2, exact (null beyond 38 digits). ``identity_error`` is measured: the largest absolute entry of the whitened fit
    list's covariance, as Spark computes it over the rows, minus the identity.

    Components are numbered by falling eigenvalue; equal eigenvalues share their plane in any rotation, the sign makes
    the largest entry of an eigenvector positive. Components without variance are left out, so a table of fewer than two distinct vectors
    gives no rows, as an empty table does. Only vectors of the commonest length have components; repeated rows and null ids come
    out each. Two short shuffles (distinct packed vectors, with copies combined before; sums), then map stages."""
    spark = embeddings.sparkSession
    id_type = embeddings.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            size = np.asarray(v.value_lengths().to_numpy(zero_copy_only=False))
            flat = v.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = quantise(flat[at[rows][:, None] + np.arange(d)], scale)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pack_vectors(x)], ["_id", "x"])

    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col(id_col).alias("_id"), v.alias("_v")).where(F.col("_v").isNotNull() & finite)
    rows = materialise(rows.mapInArrow(pack, f"_id {id_type}, x binary"), "op13-rows")
    fit = materialise(rows.select("x").distinct(), "op13-fit")
    by = fit_whitener(fit, components, least)
    k = len(by.values)
    error = float("nan")
    if k:
        w = _projected(fit.select(F.lit(None).cast("int").alias("_id"), "x"), by, "int").select(*[F.get("w", F.lit(c)).alias(f"w{c}") for c in range(k)])
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        got = w.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
        error = max(abs(got[p] - (a == b)) for p, (a, b) in enumerate(pairs))
    discard(fit)
    if not k:
        rows = rows.limit(0)
    explained = F.array(*[F.lit(float(e / by.trace)) for e in by.values]) if k else F.array().cast("array<double>")
    return _projected(rows, by, id_type) \
        .select(F.col("_id").alias(id_col), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("_c", "whitened")) \
        .select(id_col, (F.col("_c") + 1).alias("component"), F.lit(by.n).cast("bigint").alias("n"), "deviation", "whitened",
                F.get(explained, F.col("_c")).alias("explained"), F.lit(error).alias("identity_error"))
