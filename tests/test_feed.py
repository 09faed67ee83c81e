import os
import time

from pyspark.sql import functions as F

from stratum.streaming import feed
from stratum.streaming import pack_stream as ps


def _tokens(spark, n=600, lanes=3):
    rows = spark.range(n).select(F.col("id").alias("seq_id"), F.pmod("id", F.lit(lanes)).cast("int").alias("lane"))
    ids = F.transform(F.sequence(F.lit(0), (F.col("seq_id") % 37).cast("int")), lambda i: F.col("seq_id") * 100 + i)
    return rows.withColumn("input_ids", ids).withColumn("labels", F.transform("input_ids", lambda x: -x))


def _files_read(df):
    """Files that a plan of one scan opens, by the scan's own metric."""
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    df._jdf.queryExecution().toRdd().count()
    return scan.metrics().get("numFiles").get().value()


def test_store_holds_every_row_in_its_own_part(spark, tmp_path):
    store = feed.store_tokens(_tokens(spark), str(tmp_path / "s"), stretches=8)
    got = store.read(spark)
    assert got.count() == 600 and got.where(F.col("part") != store.part()).count() == 0
    assert {r.lane for r in got.where("part < 8").select("lane").distinct().collect()} == {0}
    order = [r._key for r in feed.lane_order(store, spark).where("lane = 1").withColumn("p", store.part()).orderBy("p", "_key").collect()]
    assert order == sorted(order)  # parts follow the order of the feed


def test_only_the_parts_of_a_batch_are_opened(spark, tmp_path):
    store = feed.store_tokens(_tokens(spark), str(tmp_path / "s"), stretches=8)
    assert _files_read(store.read(spark).select("seq_id")) == 24
    assert _files_read(store.read(spark, [3, 17]).select("seq_id")) == 2
    assert store.read(spark, []).count() == 0


def test_batch_is_gathered_from_its_parts(spark, tmp_path):
    rows = _tokens(spark)
    store = feed.store_tokens(rows, str(tmp_path / "s"), stretches=8)
    one = [r.seq_id for r in store.read(spark).where("part = 9").orderBy("seq_id").collect()]
    packs = spark.createDataFrame([(1, 0, one[:4], [1] * 4, 9), (1, 1, one[4:6], [1] * 2, 9)], ps.PACK_SCHEMA)
    out = str(tmp_path / "o")
    feed.feed_writer(store, out, 200)(packs, 0)
    feed.feed_writer(store, out, 200)(packs, 0)  # a replay replaces its own output
    feed.feed_writer(store, out, 200)(packs.limit(0), 1)
    got = {r.pack_key: r for r in spark.read.parquet(out).collect()}
    tokens = {r.seq_id: r.input_ids for r in rows.collect()}
    want = {"1:0": sum((tokens[i] for i in one[:4]), []), "1:1": sum((tokens[i] for i in one[4:6]), [])}
    assert {k: r.input_ids[:r.n_tokens] for k, r in got.items()} == want
    assert all(len(r.input_ids) == len(r.labels) == 200 for r in got.values())


def test_files_read_per_trigger_follow_the_batch(spark, tmp_path):
    """In feed order a micro-batch of a sixth of the rows touches about a sixth of the parts, besides those of the buffered rows."""
    store = feed.store_tokens(_tokens(spark), str(tmp_path / "s"), stretches=12)
    lanes = feed.lane_order(store, spark)
    keys = [r._key for r in lanes.select("_key").orderBy("_key").collect()]
    src, out = str(tmp_path / "in"), str(tmp_path / "o")
    for i in range(6):
        lo, hi = keys[i * 100], keys[i * 100 + 99]
        lanes.where((F.col("_key") >= lo) & (F.col("_key") <= hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)  # the file stream goes by modification time
    stream = spark.readStream.schema(lanes.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ps.pack_stream(stream, 100, 5, flush_after_ms=2000).writeStream.foreachBatch(feed.feed_writer(store, out, 100))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start())
    n = 0
    try:
        until = time.time() + 120
        while n < 600 and time.time() < until:
            assert q.exception() is None
            time.sleep(1)
            if any(x.startswith("batch=") for x in (os.listdir(out) if os.path.isdir(out) else [])):
                n = spark.read.schema("n_rows long").parquet(out).agg(F.sum("n_rows")).first()[0] or 0
    finally:
        q.stop()
    members = spark.read.parquet(out + "/_packs")
    assert n == 600 and members.select("seq_id").distinct().count() == members.count() == 600
    per = members.groupBy("batch").agg(F.collect_set("part").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    for r in per:
        files = _files_read(store.read(spark, sorted(r.p)).select("seq_id"))
        assert files == len(r.p) <= 36 * r.n / 600 + 3 * 3, (r.n, files)  # 36 parts; up to 4 buffered rows and a cut stretch a lane
    got = spark.read.parquet(out)
    assert got.where(F.size("input_ids") != 100).count() == 0
