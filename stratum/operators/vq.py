"""Vector quantisation (V1-V12) over a table of vectors ``(id, vec array<double>)`` and a
codebook table ``(layer, code, centroid array<double>)``.

A codebook is bounded (layers x bins x dim; 4096 x 128 doubles = 4 MB per layer at most), so it is
collected once and shipped to every task inside the ``mapInPandas`` closure (a broadcast).
Vectors stream through Arrow batches and are compared with the codebook in numpy blocks;
rows are never exploded against codes, so N x K pairs never exist as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum import constants as C
from stratum.operators.ordering import sample_vectors
from stratum.session import path_exists

MAX_CODEBOOK_BYTES = 256 << 20  # larger codebooks are refused rather than shipped to every task
_FETCH_ROWS = 1 << 20


def load_codebook(codebook: DataFrame, layer_col: str = "layer", code_col: str = "code",
                  vec_col: str = "centroid") -> dict[int, np.ndarray]:
    """Collect a (bounded) codebook to {layer: matrix[bins, dim]}; missing codes are NaN rows."""
    first = codebook.select(vec_col).first()
    if first is None:
        raise ValueError("empty codebook")
    most = min(_FETCH_ROWS, MAX_CODEBOOK_BYTES // (8 * max(1, len(first[0]))))
    rows = codebook.select(layer_col, code_col, vec_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"codebook of over {most} rows of {len(first[0])} doubles; {MAX_CODEBOOK_BYTES >> 20} MB are shipped at most")
    out: dict[int, np.ndarray] = {}
    dims = {len(r[vec_col]) for r in rows}
    if len(dims) != 1:
        raise ValueError("codebook vectors differ in length")
    dim = dims.pop()
    for layer in sorted({r[layer_col] for r in rows}):
        bins = 1 + max(r[code_col] for r in rows if r[layer_col] == layer)
        m = np.full((bins, dim), np.nan)
        for r in rows:
            if r[layer_col] == layer:
                m[r[code_col]] = np.asarray(r[vec_col], dtype=np.float64)
        out[layer] = m
    return out


def nearest(x: np.ndarray, embed: np.ndarray, exact: bool = False) -> np.ndarray:
    """Index of the closest codebook row by squared Euclidean distance; ties go to the lowest index.

    Distances come from the BLAS form |x|^2 - 2 x.e + |e|^2. Rows whose best two distances are
    closer than that form's rounding error are recomputed with direct differences in float64,
    so the answer equals the direct computation (``exact=True`` uses it for every row)."""
    k, d = embed.shape
    valid = ~np.isnan(embed).any(axis=1)
    e = np.where(valid[:, None], embed, 0.0)
    out = np.empty(len(x), dtype=np.int32)
    if len(x) == 0:
        return out

    def direct(rows: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 24) // max(1, k * d))
        res = np.empty(len(rows), dtype=np.int32)
        for s in range(0, len(rows), step):
            blk = rows[s:s + step]
            dist = ((blk[:, None, :] - e[None, :, :]) ** 2).sum(axis=-1)
            dist[:, ~valid] = np.inf
            res[s:s + step] = np.argmin(dist, axis=1)
        return res

    if exact or k < 2:
        return direct(x)
    e2 = (e * e).sum(axis=1)
    step = max(1, (1 << 24) // k)
    for s in range(0, len(x), step):
        blk = x[s:s + step]
        x2 = (blk * blk).sum(axis=1)
        dist = x2[:, None] - 2.0 * (blk @ e.T) + e2[None, :]
        dist[:, ~valid] = np.inf
        two = np.partition(dist, 1, axis=1)[:, :2]
        best = np.argmin(dist, axis=1)
        scale = x2 + np.max(e2[valid]) if valid.any() else x2
        close = (two[:, 1] - two[:, 0]) <= 1e-9 * (scale + 1.0)
        if close.any():
            best[close] = direct(blk[close])
        out[s:s + step] = best
    return out


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def rvq_encode(df: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "vec",
               n_q: int | None = None, mode: str = "residual", with_quantized: bool = False,
               keep: list[str] | None = None) -> DataFrame:
    """V6/V7 encode: ``codes`` array<int>, one per layer. ``keep`` names further columns to carry along.

    mode="residual" (V6, and V7's encode): each layer quantises the residual left by the
    previous layers. mode="parallel" (V7 forward): every layer quantises the same input and
    ``quantized`` is the last layer's vector. ``loss`` holds the per-layer mean squared error
    between the layer input and its code (the commitment term)."""
    keep = keep or []
    books = load_codebook(codebook)
    layers = sorted(books)[: n_q or len(books)]
    mats = [books[layer] for layer in layers]

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = _matrix(pdf[vec_col])
            codes, losses = [], []
            residual = x.copy()
            quantized = np.zeros_like(x)
            for m in mats:
                inp = residual if mode == "residual" else x
                c = nearest(inp, m) if len(inp) else np.zeros(0, dtype=np.int32)
                q = m[c] if len(inp) else np.zeros_like(inp)
                losses.append(((q - inp) ** 2).mean(axis=1) if len(inp) else np.zeros(0))
                codes.append(c)
                if mode == "residual":
                    residual = residual - q
                    quantized = quantized + q
                else:
                    quantized = q
            out = pdf[[id_col, *keep]].copy()
            out["codes"] = list(np.stack(codes, axis=1).astype(np.int32)) if len(x) else []
            out["loss"] = list(np.stack(losses, axis=1)) if len(x) else []
            if with_quantized:
                out["quantized"] = list(quantized)
            yield out

    kept = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"{id_col} long, {kept}codes array<int>, loss array<double>"
    if with_quantized:
        schema += ", quantized array<double>"
    return df.select(id_col, *keep, vec_col).mapInPandas(fn, schema)


def assign_code(df: DataFrame, codebook: DataFrame, layer: int = 0, id_col: str = "vec_id",
                vec_col: str = "vec", keep: list[str] | None = None) -> DataFrame:
    """V4: nearest code of one codebook layer (tie -> lowest code)."""
    cb = codebook.where(F.col("layer") == layer)
    enc = rvq_encode(df, cb, id_col, vec_col, n_q=1, keep=keep)
    return enc.select(id_col, *(keep or []), F.element_at("codes", 1).alias("code"))


def lookup_code(codes: DataFrame, codebook: DataFrame, layer: int = 0, code_col: str = "code") -> DataFrame:
    """V5: code -> centroid by an equi join with the (bounded, broadcast) codebook."""
    cb = F.broadcast(codebook.where(F.col("layer") == layer).select(F.col("code").alias(code_col), "centroid"))
    return codes.join(cb, code_col, "left")


def rvq_decode(codes: DataFrame, codebook: DataFrame, id_col: str = "vec_id", codes_col: str = "codes",
               bins: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """V6 decode / V8 codes_to_features: sum over layers of centroid[layer][code].

    The layers are stacked into one matrix indexed by layer * bins + code (V8) and shipped to
    the tasks (bounded); each Arrow batch is a numpy gather + sum. No shuffle."""
    keep = keep or []
    books = load_codebook(codebook)
    nb = bins or max(m.shape[0] for m in books.values())
    dim = next(iter(books.values())).shape[1]
    stacked = np.full((len(books) * nb, dim), np.nan)
    for i, layer in enumerate(sorted(books)):
        m = books[layer]
        stacked[i * nb:i * nb + m.shape[0]] = m

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sizes = np.array([len(cs) for cs in pdf[codes_col]], dtype=np.int64)
            flat = np.concatenate([*(np.asarray(cs, dtype=np.int64) for cs in pdf[codes_col]), np.zeros(0, np.int64)])
            starts = np.cumsum(sizes) - sizes
            vectors = stacked[(np.arange(len(flat)) - np.repeat(starts, sizes)) * nb + flat]
            sums = np.zeros((len(sizes), dim))
            if len(flat):
                sums[sizes > 0] = np.add.reduceat(vectors, starts[sizes > 0], axis=0)
            feats = list(sums)
            yield pdf[[id_col, *keep]].assign(features=feats)

    kept = "".join(f"{c} {codes.schema[c].dataType.simpleString()}, " for c in [id_col, *keep])
    return codes.select(id_col, *keep, codes_col).mapInPandas(fn, f"{kept}features array<double>")


def codes_to_features(codes: DataFrame, codebook: DataFrame, id_col: str = "series_id", codes_col: str = "codes",
                      bins: int | None = None) -> DataFrame:
    """V8 over time: ``codes`` holds, layer after layer, the codes of a clip's L steps (array of arrays); every
    step gets the sum over layers of centroid[layer][code]. Returns (id, step, features), one row per step."""
    layers = F.size(codes_col)
    steps = codes.where(layers > 0).select(F.col(id_col), F.col(codes_col).alias("_c"),
                                           F.posexplode(F.element_at(codes_col, 1)).alias("step", "_c0"))
    per = steps.select(id_col, "step", F.transform("_c", lambda layer: F.get(layer, F.col("step"))).alias("_codes"))
    return rvq_decode(per, codebook, id_col, "_codes", bins, keep=["step"])


def code_histogram(codes: DataFrame, codes_col: str = "codes", bins: int = C.CODE_VOCAB_SIZE) -> DataFrame:
    """V3: count per code including codes never used (right join with 0..bins-1)."""
    spark = codes.sparkSession
    counts = codes.select(F.explode(codes_col).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    allc = spark.range(bins).select(F.col("id").cast("int").alias("code"))
    return allc.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def quantisation_error(df: DataFrame, codebook: DataFrame, id_col: str = "vec_id", vec_col: str = "vec",
                       weight: float = 1.0, mode: str = "residual") -> DataFrame:
    """Per layer, mean over vectors of the mean squared error between layer input and its
    code, times ``weight``; plus layer -1 = the mean over layers."""
    enc = rvq_encode(df, codebook, id_col, vec_col, mode=mode)
    per = enc.select(F.posexplode("loss").alias("layer", "l")).groupBy("layer").agg(
        (F.avg("l") * F.lit(weight)).alias("mse"))
    overall = per.agg(F.lit(-1).alias("layer"), F.avg("mse").alias("mse"))
    return per.unionByName(overall)


# ---------------------------------------------------------------------- k-means, EMA, expiry
#: Tasks that merge the partitions' sums; at most so many rows a code are left.
SUM_LANES = 16


def _partial_sums(df: DataFrame, vec_col: str, means: np.ndarray, final: bool = False) -> DataFrame:
    """(code, n, s): vectors and their sum per nearest code, SUM_LANES rows a code at most, with ``final`` one. Each partition sums its
    own vectors as one array a code; the lanes merge whole arrays, however many partitions there are."""
    k, d = means.shape

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(k, dtype=np.int64)
        s = np.zeros((k, d))
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = _matrix(pdf[vec_col])
            c = nearest(x, means)
            n += np.bincount(c, minlength=k)
            np.add.at(s, c, x)
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"code": used.astype(np.int32), "n": n[used], "s": list(s[used])})

    schema = "code int, n long, s array<double>"

    def merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, d))
        for pdf in it:
            if len(pdf):
                codes = pdf["code"].to_numpy()
                np.add.at(n, codes, pdf["n"].to_numpy())
                np.add.at(s, codes, _matrix(pdf["s"]))
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"code": used.astype(np.int32), "n": n[used], "s": list(s[used])})

    parts = df.select(vec_col).mapInPandas(fn, schema)
    lanes = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(SUM_LANES))).repartition(SUM_LANES, "lane")
    merged = lanes.select("code", "n", "s").mapInPandas(merge, schema)
    return merged.repartition("code").mapInPandas(merge, schema) if final else merged


def kmeans(df: DataFrame, k: int, n_iters: int = C.KMEANS_ITERS, id_col: str = "vec_id", vec_col: str = "vec",
           seed: int = 0, materialize: bool = False) -> DataFrame:
    """V2: Lloyd rounds from k sampled rows (V1). Each round ships the k means to the tasks,
    which return per-partition partial sums (k rows each), merged as arrays in SUM_LANES tasks; only
    k * SUM_LANES rows per round reach the driver. An empty cluster keeps its previous mean. Returns (code, centroid, bins) where
    ``bins`` counts the last assignment (made before the last mean update). ``materialize``
    checkpoints the (id, vector) input once, for inputs whose plan is costly to re-run per round."""
    spark = df.sparkSession
    data = df.select(id_col, vec_col)
    if materialize:
        from stratum.session import checkpoint_dir

        checkpoint_dir(spark)
        data = data.checkpoint(eager=True)
    init = sample_vectors(data, id_col, k, seed).orderBy("slot").collect()
    means = np.stack([np.asarray(r[vec_col], dtype=np.float64) for r in init])
    bins = np.zeros(k, dtype=np.int64)
    for _ in range(n_iters):
        rows = _partial_sums(data, vec_col, means).collect()
        bins = np.zeros(k, dtype=np.int64)
        sums = np.zeros_like(means)
        for r in rows:
            bins[r["code"]] += r["n"]
            sums[r["code"]] += np.asarray(r["s"])
        new = sums / np.maximum(bins, 1)[:, None]
        means = np.where((bins == 0)[:, None], means, new)
    rows = list(zip(range(k), means.tolist(), bins.tolist()))
    return spark.createDataFrame(rows, "code int, centroid array<double>, bins long")


def init_codebook(df: DataFrame, k: int, path: str, n_iters: int = C.KMEANS_ITERS, id_col: str = "vec_id",
                  vec_col: str = "vec", layer: int = 0, seed: int = 0, start: str = "kmeans") -> DataFrame:
    """One-time initialisation. If a codebook table exists at ``path`` it is returned
    untouched; otherwise k-means runs and embed = embed_avg = means, cluster_size = bins.
    ``start="random"`` skips the rounds: uniform values within sqrt(6 / dim) of 0, sizes 0."""
    spark = df.sparkSession
    if path_exists(spark, path):
        return spark.read.parquet(path)
    if start == "random":
        dim = len(df.select(vec_col).first()[0])
        bound = math.sqrt(6.0 / dim)
        values = np.random.default_rng(seed).uniform(-bound, bound, (k, dim))
        km = spark.createDataFrame(list(zip(range(k), values.tolist(), [0] * k)), "code int, centroid array<double>, bins long")
    else:
        km = kmeans(df, k, n_iters, id_col, vec_col, seed)
    cb = km.select(F.lit(layer).alias("layer"), "code", F.col("centroid"), F.col("bins").cast("double")
                   .alias("cluster_size"), F.col("centroid").alias("embed_avg"))
    cb.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def ema_update(state: DataFrame, batch: DataFrame, decay: float = C.EMA_DECAY, eps: float = C.EMA_EPSILON,
               id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """V9: one EMA step of a codebook layer ``state(code, centroid, cluster_size, embed_avg)``
    with a batch of vectors assigned to their nearest code:

        cluster_size <- d * cluster_size + (1 - d) * count
        embed_avg    <- d * embed_avg    + (1 - d) * sum of assigned vectors
        smoothed     =  (cluster_size + eps) / (sum(cluster_size) + K * eps) * sum(cluster_size)
        centroid     =  embed_avg / smoothed
    """
    book = load_codebook(state.select(F.lit(0).alias("layer"), "code", "centroid"))[0]
    parts = _partial_sums(batch.select(id_col, vec_col), vec_col, book, final=True)
    agg = parts.select("code", F.col("n").cast("double").alias("_n"),
                       F.when(F.col("n") > 0, F.col("s")).alias("_sum"))
    st = state.join(agg, "code", "left").withColumn("_n", F.coalesce("_n", F.lit(0.0)))
    d = F.lit(decay)
    st = st.withColumn("cluster_size", F.col("cluster_size") * d + F.col("_n") * (1 - d))
    st = st.withColumn("embed_avg", F.when(
        F.col("_sum").isNull(), F.transform("embed_avg", lambda a: a * d)).otherwise(
        F.zip_with("embed_avg", "_sum", lambda a, s: a * d + s * (1 - d))))
    k = state.count()  # number of codes (bounded)
    w = Window.partitionBy()  # over the codebook only: K rows
    total = F.sum("cluster_size").over(w)
    smoothed = (F.col("cluster_size") + F.lit(eps)) / (total + F.lit(k * eps)) * total
    st = st.withColumn("_sm", smoothed)
    return st.select("code", F.transform("embed_avg", lambda a: a / F.col("_sm")).alias("centroid"),
                     "cluster_size", "embed_avg")


def expire_codes(state: DataFrame, batch: DataFrame, threshold: float = C.DEAD_CODE_THRESHOLD,
                 id_col: str = "vec_id", vec_col: str = "vec", seed: int = 0) -> DataFrame:
    """Codes whose EMA size is below ``threshold`` take a sampled batch row (V1, slot =
    code) as centroid; their embed_avg is reset to it and cluster_size to 1."""
    k = state.count()
    samples = sample_vectors(batch.select(id_col, vec_col), id_col, k, seed).select(
        F.col("slot").cast("int").alias("code"), F.col(vec_col).alias("_new"))
    j = state.join(F.broadcast(samples), "code", "left")
    dead = F.col("cluster_size") < F.lit(float(threshold))
    return j.select(
        "code",
        F.when(dead, F.col("_new")).otherwise(F.col("centroid")).alias("centroid"),
        F.when(dead, F.lit(1.0)).otherwise(F.col("cluster_size")).alias("cluster_size"),
        F.when(dead, F.col("_new")).otherwise(F.col("embed_avg")).alias("embed_avg"),
        dead.alias("expired"))


# ---------------------------------------------------------------------- bandwidth
def frame_rate(sample_rate: int = C.SAMPLE_RATE, ratios=C.ENCODER_RATIOS) -> int:
    return math.ceil(sample_rate / math.prod(ratios))


def bits_per_code(bins: int) -> int:
    b = int(math.log2(bins))
    if 2**b != bins:
        raise ValueError("quantizer bins must be a power of 2")
    return b


def quantizers_for_bandwidth(bandwidth: float | None, bins: int, rate: int, default_n_q: int) -> int:
    """n_q = max(1, floor(bw * 1000 / (log2(bins) * frame_rate))), or the default when bw is
    missing or <= 0."""
    if bandwidth and bandwidth > 0:
        return int(max(1, math.floor(bandwidth * 1000 / (bits_per_code(bins) * rate))))
    return default_n_q


def bandwidth_report(codes: DataFrame, codes_col: str = "codes", n_q: int = 1, bins: int = C.CODE_VOCAB_SIZE,
                     rate: int | None = None, target_bandwidth: float | None = None,
                     supported: tuple[float, ...] | None = None) -> DataFrame:
    """Per clip, frames, duration, bits and kbps of its codes, and the number of
    quantisers a target bandwidth allows."""
    fr = rate or frame_rate()
    if supported is not None and target_bandwidth not in supported:
        raise ValueError(f"unsupported bandwidth {target_bandwidth}; choose one of {supported}")
    bpc = bits_per_code(bins)
    nq_target = quantizers_for_bandwidth(target_bandwidth, bins, fr, n_q)
    frames = F.size(codes_col)
    return (codes.withColumn("n_frames", frames.cast("bigint"))
            .withColumn("duration_s", F.round(frames / F.lit(float(fr)), 6))
            .withColumn("bits", (frames * F.lit(n_q * bpc)).cast("bigint"))
            .withColumn("kbps", F.round(F.try_divide(F.col("bits").cast("double") * F.lit(float(fr)),
                                                     frames.cast("double") * F.lit(1000.0)), 6))
            .withColumn("n_q_target", F.lit(nq_target)))
