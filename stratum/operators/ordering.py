"""Ordering operators without a single-partition window (K1, K2, K7, K13, V1) and the
two-phase position helper they share.

Global order is defined by a hash key ``md5('<seed+epoch>:<id>')``. Its leading 8 hex digits,
scaled to ``n_buckets``, give a bucket that is monotone in the key, so

    global position = position inside the bucket + number of rows in earlier buckets.

Answers per bucket (K7, K2 per bucket, packing) take ``n_buckets`` as an argument. Global positions don't
depend on it; there it may grow with the row count (one bucket per million rows), and so does the offset
table, one row per bucket, that is broadcast. Buckets are uniform because md5 is; no bucket is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TWO32 = float(2**32)


def hash_key(id_col, seed: int = 0, epoch: int = 0) -> Column:
    """K1 key: md5 of '<seed+epoch>:<id>' (same bytes in DuckDB)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed + epoch)), F.lit(":"), c.cast("string")))


def key_bucket(key: Column, n_buckets: int) -> Column:
    """Bucket monotone in the hex key: floor(int(first 8 hex digits) * n_buckets / 2^32)."""
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(lead * F.lit(float(n_buckets)) / F.lit(_TWO32)).cast("int")


def hash_int(s: Column, digits: int = 15) -> Column:
    """Leading ``digits`` hex digits of md5(s) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(s), 1, digits), 16, 10).cast("bigint")


def dense_position(df: DataFrame, partition_cols: list[str], chunk_col: str, order_cols: list[str],
                   out: str = "_pos") -> DataFrame:
    """0-based dense position inside each ``partition_cols`` group, ordered by ``order_cols``.

    ``chunk_col`` must be monotone in ``order_cols`` (e.g. the day of a timestamp). Rows are
    numbered inside (group, chunk) and shifted by the row count of earlier chunks, so one heavy
    group is spread over many tasks instead of one.
    """
    keys = [*partition_cols, chunk_col]
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    numbered = df.withColumn("_rn", F.row_number().over(w))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wc = Window.partitionBy(*partition_cols).orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"))
    return (numbered.join(offsets, keys, "inner")
            .withColumn(out, F.col("_off") + F.col("_rn") - 1).drop("_rn", "_off"))


ROWS_PER_BUCKET = 1_000_000


def auto_buckets(df: DataFrame, n_buckets: int | None) -> int:
    """The given bucket count, or one that keeps each bucket near ``ROWS_PER_BUCKET`` rows (at
    least 64), so a bucket's window is one modest task at any scale. Counting is one cheap job."""
    if n_buckets:
        return n_buckets
    return max(64, -(-df.count() // ROWS_PER_BUCKET))


def with_epoch_order(df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0,
                     n_buckets: int | None = None) -> DataFrame:
    """Adds ``_key`` (hash key) and ``bucket`` (monotone in ``_key``)."""
    nb = auto_buckets(df, n_buckets)
    return (df.withColumn("_key", hash_key(id_col, seed, epoch))
            .withColumn("bucket", key_bucket(F.col("_key"), nb)))


def _bucket_offsets(df: DataFrame, value: Column | None, name: str) -> DataFrame:
    """Prefix over the bucket table (n_buckets rows): rows/values in all earlier buckets."""
    agg = F.count(F.lit(1)) if value is None else F.sum(value)
    per = df.groupBy("bucket").agg(agg.alias("_b"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.select("bucket", F.coalesce(F.sum("_b").over(w), F.lit(0)).cast("bigint").alias(name)))


def epoch_permutation(df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0,
                      n_buckets: int | None = None) -> DataFrame:
    """K1: seeded shuffle; ``perm_pos`` = 0-based global position, every row exactly once."""
    k = with_epoch_order(df, id_col, seed, epoch, n_buckets)
    w = Window.partitionBy("bucket").orderBy("_key", id_col)
    local = k.withColumn("_rn", F.row_number().over(w))
    off = _bucket_offsets(k, None, "_off")
    return (local.join(off, "bucket", "inner")
            .withColumn("perm_pos", (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
            .drop("_rn", "_off"))


def running_total(df: DataFrame, id_col: str, length_col: str, seed: int = 0, epoch: int = 0,
                  n_buckets: int | None = None, per_bucket: bool = False) -> DataFrame:
    """K2: inclusive cumulative length in shuffled order (``cum``), global or per bucket. What ``per_bucket`` gives depends
    on the buckets, so it asks for ``n_buckets``; the global answer is the same for any number."""
    if per_bucket and not n_buckets:
        raise ValueError("per_bucket needs n_buckets")
    k = with_epoch_order(df, id_col, seed, epoch, n_buckets)
    w = Window.partitionBy("bucket").orderBy("_key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    local = k.withColumn("cum", F.sum(length_col).over(w).cast("bigint"))
    if per_bucket:
        return local
    off = _bucket_offsets(k, F.col(length_col), "_off")
    return local.join(off, "bucket", "inner").withColumn("cum", F.col("cum") + F.col("_off")).drop("_off")


def budget_boundary(df: DataFrame, id_col: str, length_col: str, budget: int, n_buckets: int, seed: int = 0,
                    epoch: int = 0) -> DataFrame:
    """K7: for every row i (as a start) the number of rows j >= i in its bucket whose running total
    is <= running total before i + budget (``searchsorted(cumsum[i:], s + c*n, 'right')``).

    Expressed as an as-of count: probes (bound) and data (cum) are merged in one ordered window
    per bucket; the running count of data rows at a probe is the answer. No pairs are formed.
    """
    rt = running_total(df, id_col, length_col, seed, epoch, n_buckets, per_bucket=True)
    wn = Window.partitionBy("bucket").orderBy("_key", id_col)
    rt = rt.withColumn("_rn", F.row_number().over(wn))
    data = rt.select("bucket", F.col("cum").alias("_v"), F.lit(0).alias("_probe"),
                     F.lit(None).cast("bigint").alias(id_col), F.lit(None).cast("bigint").alias("_rn"))
    probes = rt.select("bucket", (F.col("cum") - F.col(length_col) + F.lit(budget)).cast("bigint").alias("_v"),
                       F.lit(1).alias("_probe"), F.col(id_col).cast("bigint"), F.col("_rn").cast("bigint"))
    w = Window.partitionBy("bucket").orderBy("_v", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    merged = data.unionByName(probes).withColumn("_cnt", F.sum(F.lit(1) - F.col("_probe")).over(w))
    return (merged.where(F.col("_probe") == 1)
            .select("bucket", id_col, (F.col("_cnt") - F.col("_rn") + 1).cast("bigint").alias("boundary")))


def sample_rows(df: DataFrame, id_col: str, m: int, seed: int = 0, n_buckets: int | None = None) -> DataFrame:
    """M uniform draws with replacement. Draw i picks dense index
    int(md5('<seed>:draw:<i>')[:15]) % n of the K1 order (seed), joined by equality."""
    indexed = epoch_permutation(df, id_col, seed, 0, n_buckets)
    n = df.count()  # one scalar to the driver
    if n == 0:
        return indexed.drop("_key", "bucket").withColumn("draw", F.lit(None).cast("bigint")).limit(0)
    draws = df.sparkSession.range(m).withColumnRenamed("id", "draw").select(
        "draw",
        F.pmod(hash_int(F.concat(F.lit(f"{seed}:draw:"), F.col("draw").cast("string"))), F.lit(n))
        .alias("perm_pos"))
    return draws.join(indexed.drop("_key", "bucket"), "perm_pos", "inner")


def sample_vectors(df: DataFrame, id_col: str, k: int, seed: int = 0, n_buckets: int | None = None) -> DataFrame:
    """V1: k rows without replacement when n >= k (the k smallest hash keys; a top-k, so the
    limit is the feature), otherwise k draws with replacement (K13). Adds ``slot`` 0..k-1."""
    n = df.count()
    if n >= k:
        keyed = df.withColumn("_key", hash_key(id_col, seed, 0))
        top = keyed.orderBy("_key", id_col).limit(k)
        return top.withColumn("slot", F.row_number().over(Window.orderBy("_key", id_col)) - 1).drop("_key")
    s = sample_rows(df, id_col, k, seed, n_buckets)
    return s.withColumnRenamed("draw", "slot").drop("perm_pos")


def dense_index(df: DataFrame, out: str = "_idx") -> tuple[DataFrame, int]:
    """``df`` with a 0-based dense position in no particular order, and its row count. The rows are written
    once to ``spark.checkpoint.dir``, so whatever made them runs once and both uses see the same partitions."""
    from stratum.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    s = df.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    per = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = F.broadcast(per.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off")))
    n = per.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    return s.join(off, "_pid").withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint")).drop("_mid", "_pid", "_loc", "_off"), int(n)


def even_files(indexed: DataFrame, n: int, min_rows: int, index_col: str = "_idx", task_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Rows with their number in 0..n-1 dealt to max(1, n // min_rows) files of floor or ceil of n / files rows
    each, by a ``file`` column; returns (rows, files). One partition per file, or with ``task_bytes`` one per run of neighbouring
    files of about that many bytes by the optimiser's estimate (never fewer partitions than cores, if there are as many files)."""
    files = max(1, n // min_rows)
    out = indexed.withColumn("file", F.floor(F.col(index_col) * F.lit(files) / F.lit(max(n, 1))).cast("int"))
    if task_bytes is None:
        return out.repartitionById(files, F.col("file")), files
    size = int(str(indexed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = min(files, max(2 * indexed.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)))
    return out.repartitionById(tasks, F.floor(F.col("file") * F.lit(tasks) / F.lit(files)).cast("int")), files


def global_rank(df: DataFrame, order_cols: list, n_parts: int | None = None, out: str = "_rank") -> DataFrame:
    """0-based dense position of every row in a total order, without a single-partition window.

    Range-partition on the order (Spark samples the keys, so a heavy key range is split),
    sort inside partitions, take each row's index inside its partition, and add the row count
    of all earlier partitions (a table with one row per partition, broadcast). The numbered
    data is checkpointed to ``spark.checkpoint.dir`` first so both uses see the same partitions.
    ``order_cols`` must be a total order (end with a unique column).
    """
    spark = df.sparkSession
    from stratum.session import checkpoint_dir

    checkpoint_dir(spark)
    # at least the shuffle partitions, and enough that a range partition holds ~2M rows
    n = n_parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // 2_000_000))
    s = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.checkpoint(eager=True)
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_loc", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    per = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = F.broadcast(per.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off")))
    return (s.join(off, "_pid", "inner").withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_mid", "_pid", "_loc", "_off"))
