"""Streaming queries (K12, V9s, S7): each runs its stream to completion over a driver table
and returns the result as a DataFrame."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.operators import ordering as od
from stratum.operators import packing as pk
from stratum.plans import sql as S
from stratum.plans.q_sources import _f9, _scratch
from stratum.plans.q_tokens import _SFT, sft_rows
from stratum.plans.q_vq import _EMA_SQL, _ema_state, _vsum
from stratum.plans.registry import query
from stratum.session import path_exists
from stratum.streaming import feed, jobs
from stratum.streaming import pack_stream as ps

MAXLEN, BUF, RANKS, WORKERS = 2048, 100, 4, 2


def _lane_rows(spark, sf_dir):
    f3 = fx.sequences(spark, sf_dir)
    lanes = pk.assign_lanes(f3, "seq_id", RANKS, WORKERS)
    return lanes.withColumn("_key", od.hash_key("seq_id", 0, 0)).select("lane", "seq_id", "length", "_key")


def _wait(q, rows_out, out, expected, limit_s=900):
    """Until ``expected`` rows are out. A stream that fails, ends early or takes over ``limit_s`` seconds raises: no result is
    returned from part of the rows."""
    deadline = time.time() + limit_s
    while True:
        if q.exception() is not None:
            raise RuntimeError(f"stream failed: {q.exception()}")
        done = (rows_out().first()[0] or 0) if path_exists(SparkSession.getActiveSession(), out) else 0
        if done >= expected:
            return
        if not q.isActive or time.time() > deadline:
            raise RuntimeError(f"stream gave {done} of {expected} rows")
        time.sleep(2)


def _lane_report(packs, key=("lane", "pack_no")):
    """Per lane: rows and tokens, whether every pack fits and has a number of its own, each row is in one pack, and the ids themselves."""
    ex = packs.withColumn("_seq", F.explode("seq_ids"))
    ids = ex.groupBy("lane").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.countDistinct("_seq").alias("_d"),
                                 F.sum(F.conv(F.substring(F.md5(F.col("_seq").cast("string")), 1, 8), 16, 10).cast("bigint")).cast("bigint").alias("id_sum"))
    per = packs.groupBy("lane").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens"),
                                    F.bool_and(F.col("n_tokens") <= MAXLEN).alias("_fits"),
                                    (F.count(F.lit(1)) == F.countDistinct(*key)).alias("_keys"))
    return ids.join(per, "lane").select("lane", "n_rows", "n_tokens", "id_sum", (F.col("_fits") & F.col("_keys") & (F.col("_d") == F.col("n_rows"))).alias("fits"))


_LANES_SQL = S.with_(S.F3) + f"""
SELECT CAST(lane AS INTEGER) AS lane, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length) AS BIGINT) AS n_tokens,
       CAST(sum(('0x' || substr(md5(seq_id::VARCHAR), 1, 8))::BIGINT) AS BIGINT) AS id_sum, true AS fits
FROM (SELECT seq_id, {S.md5_int("'0:lane:' || seq_id::VARCHAR")} % {RANKS * WORKERS} AS lane, length FROM f3)
WHERE length <= {MAXLEN} GROUP BY lane"""


@query("k12_pack_stream", _LANES_SQL)
def k12_pack_stream(spark, sf_dir):
    """Batch twin of the streaming packer (flush at the end): every row packed once per lane."""
    return _lane_report(ps.pack_lanes_batch(_lane_rows(spark, sf_dir), MAXLEN, BUF), ("lane", "bucket", "pack_no"))


@query("k12_pack_stream_live", _LANES_SQL)
def k12_pack_stream_live(spark, sf_dir):
    """The packer as a Structured Streaming query over the lane rows written as files; idle
    lanes flush on a processing-time timeout. Same rows per lane as the batch twin."""
    src = _scratch(spark, "lanes")
    rows = _lane_rows(spark, sf_dir)
    expected = rows.where(F.col("length") <= MAXLEN).count()
    rows.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out, ckpt = _scratch(spark, "packs"), _scratch(spark, "packs-ckpt")
    q = (ps.pack_stream(stream, MAXLEN, BUF, flush_after_ms=2000).writeStream.format("parquet")
         .option("checkpointLocation", ckpt).option("path", out).trigger(processingTime="1 second").start())
    try:
        _wait(q, lambda: spark.read.schema(ps.PACK_SCHEMA).parquet(out).select(F.sum(F.size("seq_ids"))), out, expected)
    finally:
        err = q.exception()
        q.stop()
    if err is not None:
        raise RuntimeError(f"packing stream failed: {err}")
    return _lane_report(spark.read.schema(ps.PACK_SCHEMA).parquet(out))


@query("v9s_ema_stream", _EMA_SQL + """
SELECT CAST(code AS INTEGER) AS code, round(cs, 6) AS cluster_size, round(list_sum(centroid), 6) AS centroid_sum
FROM ema""")
def v9s_ema_stream(spark, sf_dir):
    """EMA codebook update as a stream over the embeddings table (one micro-batch per file)."""
    src = jobs.stream_from_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    root, ckpt = _scratch(spark, "codebook"), _scratch(spark, "codebook-ckpt")
    cb = jobs.run_ema_stream(spark, src, _ema_state(spark, sf_dir), root, ckpt)
    return cb.select("code", F.round("cluster_size", 6).alias("cluster_size"), _vsum("centroid").alias("centroid_sum"))


@query("s7_incremental_stream", """
SELECT CAST(ceil(greatest(1, count(*) // 10) / 32.0) AS BIGINT) AS n_batches, CAST(count(*) AS BIGINT) AS n_rows
FROM documents""")
def s7_incremental_stream(spark, sf_dir):
    """Incremental shard job as a stream: <= 32 new shards per group, up to 256 groups a micro-batch."""
    root, _ = _f9(spark, sf_dir)

    def process(samples):
        return samples.select("output", F.col("key").cast("bigint").alias("doc_id"), F.decode(F.col("members")["txt"], "UTF-8").alias("text"))

    res = jobs.run_shard_stream(spark, root, _scratch(spark, "inc-out"), _scratch(spark, "inc-ckpt"), process, groups_at_once=256)
    return res.agg(F.count(F.lit(1)).cast("bigint").alias("n_batches"), F.sum("n_rows").cast("bigint").alias("n_rows"))


@query("k12_feed_stream", _SFT + f""",
lanes AS (SELECT doc_id, len(ids) AS length,
                 {S.md5_int("'0:lane:' || doc_id::VARCHAR")} % {RANKS * WORKERS} AS lane FROM sft)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length) AS BIGINT) AS n_tokens, true AS all_padded
FROM lanes WHERE length <= {MAXLEN}""")
def k12_feed_stream(spark, sf_dir):
    """SFT token rows, laid out by lane and order, feed a stream of (lane, seq_id, length); the stateful packer emits packs, and each
    micro-batch gathers its token rows from the partitions that hold them and pads them to 2048 (foreachBatch)."""
    rows = pk.assign_lanes(sft_rows(spark, sf_dir).withColumnRenamed("doc_id", "seq_id"), "seq_id", RANKS, WORKERS)
    store = feed.store_tokens(rows, _scratch(spark, "feed-tokens"), stretches=8)
    lanes = feed.lane_order(store, spark)
    expected = lanes.where(F.col("length") <= MAXLEN).count()
    src, out, ckpt = _scratch(spark, "feed-in"), _scratch(spark, "feed-out"), _scratch(spark, "feed-ckpt")
    lanes.repartitionByRange(4, "_key").sortWithinPartitions("_key").write.parquet(src)
    stream = spark.readStream.schema(lanes.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = (ps.pack_stream(stream, MAXLEN, BUF, flush_after_ms=2000).writeStream
         .foreachBatch(feed.feed_writer(store, out, MAXLEN)).option("checkpointLocation", ckpt)
         .trigger(processingTime="1 second").start())
    schema = "pack_key string, n_rows long, n_tokens long, input_ids array<bigint>, labels array<bigint>"
    try:
        _wait(q, lambda: spark.read.schema(schema).parquet(out).agg(F.sum("n_rows")), out, expected)
    finally:
        err = q.exception()
        q.stop()
    if err is not None:
        raise RuntimeError(f"feed stream failed: {err}")
    fed = spark.read.schema(schema).parquet(out)
    return fed.agg(F.sum("n_rows").cast("bigint").alias("n_rows"), F.sum("n_tokens").cast("bigint").alias("n_tokens"),
                   F.bool_and((F.size("input_ids") == MAXLEN) & (F.size("labels") == MAXLEN)).alias("all_padded"))
