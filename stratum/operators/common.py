"""Small plan helpers shared by operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
HOT_FLOOR = 256
HOT_KEY_BYTES = 4096


SPREAD_BYTES = 128 << 20


def spread(df: DataFrame, min_partitions: int | None = None, factor: int = 1) -> DataFrame:
    """Round-robin the rows over ``min_partitions`` tasks (default: ``factor`` x the cluster's
    parallelism; a factor above 1 lets rows of very different cost even out over many small
    tasks) before a CPU-heavy per-row step, where the optimiser's estimate of its size is below
    ``SPREAD_BYTES`` per core: a scan that small may be a single task. Larger inputs are left as they are. The
    estimate comes from the plan alone; nothing is run for it, and the rows are the same either way."""
    sc = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES * sc.defaultParallelism:
        return df.repartition(min_partitions or factor * sc.defaultParallelism)
    return df


def write_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back, for plans that read it several times: it
    is computed once, survives lost executors and is read by column."""
    from stratum.session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stratum/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark, mb: int = 8) -> None:
    """Bound the Arrow batches that go to Python by bytes, so what a worker holds doesn't grow with the rows of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n_col: str) -> DataFrame:
    """Inner join of written ``rows`` with one row per key of ``groups`` (also written), where a few keys may hold much of
    ``rows``. ``n_col`` is the key's number of rows.

    Keys with over max(HOT_FLOOR, total / HOT_SHARE) rows, so HOT_SHARE of them at most, meet their rows in a broadcast join
    where those lie; only the others are shuffled. Text keys longer than HOT_KEY_BYTES are never broadcast."""
    total = groups.agg(F.sum(n_col)).first()[0] or 0
    hot = F.col(n_col) > max(HOT_FLOOR, total // HOT_SHARE)
    if dict(groups.dtypes)[key] in ("string", "binary"):
        hot = hot & (F.octet_length(key) <= HOT_KEY_BYTES)
    few = F.broadcast(groups.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(groups.where(~hot).drop(n_col), key)
    return rows.join(few.drop(n_col), key).unionByName(rest)
