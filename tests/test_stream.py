import os
import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratum.operators import ordering as od
from stratum.streaming import pack_stream as ps


def _rows(spark, n=600):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"seq_id": np.arange(n), "length": rng.integers(1, 400, n)})
    df = spark.createDataFrame(pdf).withColumn("lane", F.pmod("seq_id", F.lit(3)).cast("int"))
    return df.withColumn("_key", od.hash_key("seq_id"))


def test_take_pack_removes_exactly_chosen():
    seq, lens = list(range(10)), [5] * 10
    cs, cl, rs, rl = ps.take_pack(seq, lens, 12, 0, 0)
    assert len(cs) == 2 and sorted(cs + rs) == seq and sum(cl) <= 12


def test_batch_twin_packs_every_row_once(spark):
    df = _rows(spark)
    packs = ps.pack_lanes_batch(df, max_length=1000, buf_size=20, n_buckets=2).toPandas()
    ids = sorted(i for s in packs.seq_ids for i in s)
    assert ids == list(range(600)) and packs.n_tokens.max() <= 1000


def test_stream_equals_batch_twin_as_rows(spark):
    df = _rows(spark)
    src = tempfile.mkdtemp(prefix="stratum-stream-")
    df.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "in"))
    out = os.path.join(src, "out")
    q = (ps.pack_stream(stream, 1000, 20, flush_after_ms=1000).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", os.path.join(src, "ck"))
         .trigger(processingTime="500 milliseconds").start())
    try:
        deadline = time.time() + 120
        n = 0
        while time.time() < deadline and n < 600:
            time.sleep(1)
            try:
                n = spark.read.schema(ps.PACK_SCHEMA).parquet(out).select(F.sum(F.size("seq_ids"))).first()[0] or 0
            except Exception:  # noqa: BLE001
                n = 0
    finally:
        q.stop()
    got = spark.read.schema(ps.PACK_SCHEMA).parquet(out).toPandas()
    assert sorted(i for s in got.seq_ids for i in s) == list(range(600))
    assert got.n_tokens.max() <= 1000
