"""Helpers shared by the operators: table access, written intermediates, joins that survive hot keys and
connected components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratum.session import checkpoint_dir, table

HOT_SHARE = 1000
HOT_FLOOR = 256
#: With this setting a query's shuffle files are deleted at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_columns(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table and no others, so extra columns can't clash with an operator's own."""
    return table(spark, sf_dir, name).select(*cols)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder named by ``spark.checkpoint.dir`` and read it back.

    The table survives lost executors, is computed once and cuts the lineage; columnar files are a
    fraction of the size of a row checkpoint. The shuffle files that it was made from go at once: else they stay on disk until
    the driver happens to collect its garbage, and large steps pile up theirs."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stratum-llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before else spark.conf.unset(SHUFFLE_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound the Arrow batches of texts by bytes, so a batch of very long documents stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Return to the system what this process has freed. A Python worker serves one stage after another, and what the last
    one's libraries hold unused would come on top of the next one's. Without glibc only Arrow's part goes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_col: str, spread: Column,
                sizes: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Left join of ``rows`` with one row per key of ``groups`` where single keys may hold much of ``rows``.

    ``n_col`` of ``groups`` is the number of rows of the key. Keys with over max(HOT_FLOOR, total / HOT_SHARE)
    rows, HOT_SHARE of them at most whatever the data, are broadcast; their rows are then scattered by
    ``spread`` in the shuffle join that serves all the others. Null keys match nothing. ``sizes``: sum and maximum of
    ``n_col``, where they are known; else a job finds them."""
    total, most = sizes or groups.agg(F.sum(n_col), F.max(n_col)).first()
    at = max(HOT_FLOOR, (total or 0) // HOT_SHARE)
    vals = [c for c in groups.columns if c not in keys]
    if (most or 0) <= at:
        return rows.join(groups, keys, "left")
    hot = groups.where(F.col(n_col) > at).select(*keys, *[F.col(c).alias(f"_h_{c}") for c in vals], F.lit(True).alias("_hot"))
    # 0 for every key, but not a literal: a constant would leave the join's keys and with it the rows' hash partitioning
    cold = groups.where(F.col(n_col) <= at).withColumn("_salt", F.least(F.col(n_col), F.lit(0)).cast("bigint"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("bigint")))
    out = left.join(cold, [*keys, "_salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", c).alias(c) for c in vals])


#: 2^22 flags in 128 bitmaps of 4 KB each: such a filter is 512 KB at any input size.
FLAG_SLOTS = 128 * 32768


def flag_slots(n_keys: int, most: int = 1 << 29) -> int:
    """Flags for ``n_keys`` keys: 16 or more a key, so few false hits, in ``most`` flags (64 MB) at most."""
    return min(most, max(FLAG_SLOTS, 1 << (16 * n_keys).bit_length()))


def flag_slot(*cols: Column, slots: int = FLAG_SLOTS) -> Column:
    """The flag that a key falls into."""
    return F.pmod(F.xxhash64(*cols), F.lit(slots))


def flag_filter(keys: DataFrame, slot: Column) -> DataFrame:
    """The flags of ``keys`` as bitmaps of 4,096 bytes each. A row whose flag isn't set has none of the keys; the reverse may
    fail, which only costs work."""
    byte = lambda i: F.conv(F.hex(F.substring("_bits", i + 1, F.lit(1))), 16, 10).cast("int")
    signed = lambda i: (F.pmod(byte(i) + 128, F.lit(256)) - 128).cast("tinyint")
    return keys.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")) \
        .select("_bucket", F.transform(F.sequence(F.lit(0), F.lit(4095)), signed).alias("_bytes"))


def with_flag(rows: DataFrame, flags: DataFrame, slot: Column, out: str) -> DataFrame:
    """``rows`` plus a boolean: whether the row's flag is set."""
    pos = F.bitmap_bit_position("_slot")
    byte = F.get("_bytes", F.floor(pos / 8).cast("int"))
    return rows.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")) \
        .join(F.broadcast(flags), "_bucket", "left") \
        .withColumn(out, F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))).drop("_slot", "_bucket", "_bytes")


def flag_bitmap(keys: DataFrame, col: str, slots: int) -> np.ndarray:
    """The flags of a column of evenly distributed 64-bit keys, as bytes on the driver: a key's flag is at its lowest bits, lowest bit of
    a byte first. ``slots``: their number, a power of two and no less than 32,768."""
    slot = F.col(col).bitwiseAND(F.lit(slots - 1))
    found = keys.select(F.shiftright(slot, 15).alias("_bucket"), slot.bitwiseAND(F.lit(32767)).alias("_bit")) \
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")).toArrow()
    out = np.zeros((slots >> 15, 4096), np.uint8)
    for bucket, bits in zip(found["_bucket"].to_pylist(), found["_bits"]):
        out[bucket] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1)


#: Rows of two ids, 4 MB, that are worth a task of their own.
TASK_ROWS = 1 << 18


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` narrow rows in no more tasks than these need, and no fewer than there are cores. Every task costs
    the driver memory, however little it reads, and only Spark's own coalescing, where it is on, would spare them."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def _written_edges(edges: DataFrame) -> tuple[DataFrame, int]:
    """``edges`` written, and their number."""
    seen = Observation()
    return materialise(edges.observe(seen, F.count(F.lit(1)).alias("n")), "cc"), seen.get["n"]


def _min_neighbours(edges: DataFrame, n: int) -> tuple[DataFrame, tuple[int | None, int | None], int]:
    """(u, m, _n) of ``n`` edges, with m the smallest v of u and _n its edges; their sum and maximum; and how many nodes forbid that
    the edges are stars around their smallest nodes. The numbers are observed while the table is written, without a job of their own."""
    seen = Observation()
    mins = few_tasks(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), n)
    loose = F.count_if((F.col("m") < F.col("u")) & (F.col("_n") > 1))
    mins = materialise(mins.observe(seen, F.sum("_n").alias("total"), F.max("_n").alias("most"), loose.alias("loose")), "cc-min")
    return mins, (seen.get["total"], seen.get["most"]), seen.get["loose"]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node reachable from it.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) as joins and minima; each round's edge
    table is written to the shared folder. It has settled when every node either is smaller than all its neighbours or has
    one only: then that one is of the first kind, and the minima are the result. No component is gathered in one task; hubs go
    through ``join_groups``. Raises if it hasn't settled after ``max_rounds`` (logarithmic in practice)."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("_two")).where("_two").select("u", "v").distinct()
    e, n = _written_edges(e)
    for _ in range(max_rounds):
        down = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        mins, sizes, loose = _min_neighbours(e.unionByName(down), 2 * n)
        if not loose:
            discard(e)
            return mins.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        large = materialise(few_tasks(join_groups(down, mins, ["u"], "_n", F.col("v"), sizes), n)
                            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "cc")
        low, sizes, _ = _min_neighbours(large, n)
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = few_tasks(join_groups(large, low, ["u"], "_n", F.col("v"), sizes), n).select(F.explode(pairs).alias("_e")).select("_e.*")
        old = e
        e, n = _written_edges(few_tasks(small.where("u <> v").distinct(), 2 * n))
        discard(old, large, mins, low)
    raise RuntimeError("connected components did not settle")
