"""The reference's data jobs as Spark job functions composed from the operators.

quality_filter_job (J1): shards -> samples -> recogniser (U1) -> CER filter (P4-P6) -> cer in the
metadata (P9) -> shards (S3). tokenise_series_job (J2): clips -> length filter (P7) -> frames (G1) ->
RMS normalisation (G2) -> codebook (V2, or a given one) -> nearest code per frame (V4) -> codes
per clip -> JSON lines (S4). pack_corpus_job (J3): token rows (T1-T9) -> written once ->
lengths -> packs (K6) -> gather (K9) -> Parquet (S6).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum import constants as C
from stratum.functions import batch_udf as bu
from stratum.operators import filtering as flt
from stratum.operators import packing as pk
from stratum.operators.common import write_once
from stratum.session import checkpoint_dir
from stratum.sources import files as fs
from stratum.sources import shards as sh


def quality_filter_job(spark: SparkSession, shard_paths: list[str] | DataFrame, out_dir: str,
                       make_recogniser: Callable[[], Callable[[np.ndarray], np.ndarray]],
                       input_member: str | None = None, threshold: float = C.CER_THRESHOLD,
                       min_rows_per_file: int = C.SHARD_MIN_ROWS, batch_size: int = 128) -> int:
    """Keep the samples whose transcript scores CER < threshold and write them as shards. The ``json`` member keeps
    everything it held, of any type, and gains ``pred`` and ``cer``.

    The recogniser gets the bytes of ``input_member`` (such as "mp3"); None feeds it the reference text, for text models and
    tests. It runs once per sample: what it kept is written before files are formed. Returns the number of files."""
    recognise = bu.score_batches(make_recogniser, T.StringType(), batch_size=batch_size)
    samples = sh.read_shards(spark, shard_paths).withColumn("_doc", F.decode(F.col("members")["json"], "UTF-8")) \
        .withColumn("json", F.from_json("_doc", "text string"))
    heard = F.col("members")[input_member] if input_member else F.col("json.text")
    scored = samples.withColumn("json", F.col("json").withField("pred", recognise(heard)))
    kept = flt.quality_filter(scored, threshold, "json")
    old = F.map_filter(F.from_json("_doc", "map<string, variant>"), lambda k, v: ~k.isin("pred", "cer"))
    new = F.from_json(F.to_json(F.struct("json.pred", "json.cer")), "map<string, variant>")
    out = kept.select("key", F.map_concat(
        F.map_filter("members", lambda k, v: k != F.lit("json")),
        F.create_map(F.lit("json"), F.encode(F.to_json(F.map_concat(old, new)), "UTF-8"))).alias("members"))
    return sh.write_shards(out, out_dir, min_rows_per_file)


def tokenise_series(series: DataFrame, frame_len: int, hop: int, min_samples: int, n_codes: int,
                    kmeans_iters: int = C.KMEANS_ITERS, codebook: DataFrame | None = None, seed: int = 0):
    """J2 on a long table (series_id, pos, value): returns (codes per clip, codebook). Clips shorter
    than ``min_samples`` are dropped before any heavy step; frames are RMS-normalised vectors of
    ``frame_len`` values; without a ``codebook`` one is fitted by k-means on all frames."""
    from stratum.operators import series as sr
    from stratum.operators import vq

    n = series.groupBy("series_id").agg((F.max("pos") + 1).alias("_n_samples"))
    clips = flt.min_duration(series.join(n, "series_id"), "_n_samples", min_samples).drop("_n_samples")
    fr = sr.rms_normalise(sr.frames(clips, frame_len, hop))
    vecs = (fr.groupBy("series_id", "win").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_s"))
            .select("series_id", "win", F.concat_ws(":", "series_id", "win").alias("vec_id"),
                    F.transform("_s", lambda x: x["value"]).alias("vec")))
    checkpoint_dir(series.sparkSession)
    vecs = vecs.checkpoint(eager=True)  # frame vectors are read by every k-means round and the assignment
    if codebook is None:
        km = vq.kmeans(vecs, n_codes, n_iters=kmeans_iters, seed=seed)
        codebook = km.select(F.lit(0).alias("layer"), "code", "centroid")
    codes = vq.assign_code(vecs, codebook, 0, id_col="series_id", keep=["win"])
    per = codes.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("win", "code"))).alias("_c"))
    return per.select("series_id", F.transform("_c", lambda x: x["code"]).alias("codes")), codebook


def tokenise_series_job(series: DataFrame, out_dir: str, frame_len: int, hop: int, min_samples: int,
                        n_codes: int, kmeans_iters: int = C.KMEANS_ITERS,
                        min_rows_per_file: int = C.JSONL_MIN_ROWS) -> int:
    """J2 written as JSON lines (at least ``min_rows_per_file`` rows per file); returns the file count."""
    codes, _ = tokenise_series(series, frame_len, hop, min_samples, n_codes, kmeans_iters)
    return fs.write_jsonl(codes, out_dir, min_rows_per_file)


def pack_corpus_job(rows: DataFrame, out_dir: str, capacity: int = C.PACK_CAPACITY, seed: int = 0,
                    n_buckets: int = C.PACK_BUCKETS) -> DataFrame:
    """Token rows (seq_id, input_ids, labels) are written once, packed on their lengths and
    gathered into packs written as Parquet. Packs depend on ``n_buckets`` and never on the number of rows. Returns the
    written packs."""
    rows = write_once(rows, "packed-rows")  # by column and compressed: a row checkpoint is several times that
    lengths = rows.select("seq_id", F.size("input_ids").alias("length"))
    assign = pk.pack_next_fit(lengths, capacity=capacity, seed=seed, n_buckets=n_buckets)
    packs = pk.materialise_packs(assign, rows)
    fs.write_packed(packs, out_dir)
    return rows.sparkSession.read.parquet(out_dir)
