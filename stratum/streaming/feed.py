"""The feed of a trainer, where every micro-batch reads only the token rows that it needs.

Token rows are laid out once per epoch in the order in which the packer meets them: Parquet partitioned by ``part``, which is (lane,
stretch of the lane's hash order). Packs taken from neighbouring rows therefore lie in a few partitions, and a micro-batch opens
those partitions' folders alone; the rest of the table is neither listed nor read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import packing as pk
from stratum.operators.ordering import hash_key, key_bucket

STORE_SCHEMA = "seq_id bigint, lane int, length int, input_ids array<bigint>, labels array<bigint>, part int"


@dataclass(frozen=True)
class TokenStore:
    """Token rows under ``path``, ``stretches`` partitions to a lane in the hash order of (seed, epoch)."""

    path: str
    stretches: int
    seed: int = 0
    epoch: int = 0

    def part(self, lane: str = "lane", seq_id: str = "seq_id") -> Column:
        """The partition of a row, from its lane and id alone."""
        return (F.col(lane) * self.stretches + key_bucket(hash_key(seq_id, self.seed, self.epoch), self.stretches)).cast("int")

    def read(self, spark: SparkSession, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some (existing) partitions, whose folders are the only ones listed."""
        reader = spark.read.schema(STORE_SCHEMA)
        if parts is None:
            return reader.parquet(self.path)
        if not parts:
            return spark.createDataFrame([], STORE_SCHEMA)
        return reader.option("basePath", self.path).parquet(*[f"{self.path}/part={p}" for p in parts])


def store_tokens(rows: DataFrame, path: str, stretches: int = 64, seed: int = 0, epoch: int = 0) -> TokenStore:
    """Write token rows (seq_id, lane, input_ids, labels) as a ``TokenStore``. One shuffle by partition; hashing spreads the rows
    evenly, so choose ``stretches`` for the size of a partition. It decides what is read, never what a batch holds."""
    store = TokenStore(path.rstrip("/"), stretches, seed, epoch)
    laid = rows.select(F.col("seq_id").cast("bigint").alias("seq_id"), F.col("lane").cast("int").alias("lane"), F.size("input_ids").alias("length"),
                       "input_ids", "labels").withColumn("part", store.part())
    laid.repartition("part").sortWithinPartitions("part", hash_key("seq_id", seed, epoch), "seq_id") \
        .write.mode("overwrite").partitionBy("part").parquet(store.path)
    return store


def lane_order(store: TokenStore, spark: SparkSession) -> DataFrame:
    """What the packer is fed: (lane, seq_id, length, _key); no token column is read."""
    return store.read(spark).select("lane", "seq_id", "length", hash_key("seq_id", store.seed, store.epoch).alias("_key"))


def feed_writer(store: TokenStore, out_dir: str, max_length: int, pad_id: int = 0):
    """foreachBatch function: the packs of a micro-batch are gathered with their token rows (K9) and right-padded to
    ``max_length`` (K10), then written to ``out_dir/batch=<id>``.

    The members of the packs are written first, to ``out_dir/_packs/batch=<id>``, so the packer's state is read once; they name the
    partitions to open (lanes times stretches at most). Both outputs overwrite, so a batch that is replayed replaces its own. A batch
    without packs writes nothing but its empty list of members."""
    root = out_dir.rstrip("/")

    def fn(packs: DataFrame, batch_id: int) -> None:
        spark = packs.sparkSession
        members = packs.select(F.concat_ws(":", "lane", "pack_no").alias("pack_key"), "lane", F.posexplode("seq_ids").alias("pos", "seq_id")) \
            .withColumn("part", store.part())
        at = f"{root}/_packs/batch={batch_id}"
        members.write.mode("overwrite").parquet(at)
        members = spark.read.schema(members.schema).parquet(at)
        parts = sorted(r["part"] for r in members.select("part").distinct().collect())
        if not parts:
            return
        gathered = pk.materialise_packs(members, store.read(spark, parts), pack_col="pack_key")
        gathered = gathered.withColumn("n_tokens", F.size("input_ids").cast("bigint"))
        pk.pad_rows(gathered, max_length, pad_id).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return fn
