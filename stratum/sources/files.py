"""JSON-lines / Parquet sinks and loaders, checksums and the incremental shard job
(S4-S8, batch forms)."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum import constants as C
from stratum.session import path_exists


def write_jsonl(df: DataFrame, path: str, min_rows_per_file: int = C.JSONL_MIN_ROWS) -> int:
    """JSON lines with at least ``min_rows_per_file`` rows per file (Spark's
    ``maxRecordsPerFile`` is an upper bound, not this); non-ASCII text is written as is. The rows are
    numbered densely and dealt by number, so no file falls short. Returns the number of files.

    Of n rows in f files, n % f files hold a row more than the others: these are written first, then the others, and then
    the folder has its _SUCCESS. A task writes a run of files of one size, which ``maxRecordsPerFile`` cuts; its rows keep their numbers' order."""
    from stratum.operators.ordering import dense_index

    rows, n = dense_index(df, "_idx")
    files = max(1, n // min_rows_per_file)
    least, more = divmod(n, files)
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    split = more * (least + 1)
    parts = [(F.col("_idx"), rows.where(F.col("_idx") < split), least + 1, more), (F.col("_idx") - split, rows.where(F.col("_idx") >= split), least, files - more)]
    parts = [p for p in parts if p[2] and p[3]]
    if not parts:
        rows.select(*df.columns).coalesce(1).write.mode("overwrite").json(path)
    for k, (at, some, size, count) in enumerate(parts):
        per_task = min(max(1, FILE_ROWS_PER_TASK // size), -(-count // cores))  # files of a task
        task = F.floor(at / F.lit(size * per_task)).cast("int")
        out = some.repartitionById(-(-count // per_task), task).sortWithinPartitions("_idx").select(*df.columns)
        out.write.mode("append" if k else "overwrite").option("maxRecordsPerFile", size) \
            .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(k + 1 == len(parts)).lower()).json(path)
    return files


def load_rows(spark: SparkSession, path: str, ddl: str, fmt: str = "json") -> DataFrame:
    """Load rows with a declared schema (no inference)."""
    return spark.read.schema(ddl).format(fmt).load(path)


def write_packed(df: DataFrame, path: str) -> None:
    """Materialise packed rows as Parquet (rows never pass through the driver)."""
    df.write.mode("overwrite").parquet(path)


def verify_checksum(df: DataFrame, content_col: str, expected_col: str, raise_on_mismatch: bool = False) -> DataFrame:
    """sha256 of the content must start with the expected prefix; mismatches become rows
    (``ok`` = false) or, with ``raise_on_mismatch``, fail the job."""
    digest = F.sha2(F.col(content_col), 256)
    ok = F.startswith(digest, F.col(expected_col))
    out = df.withColumn("sha256", digest).withColumn("ok", ok)
    if raise_on_mismatch:
        out = out.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("Invalid checksum, expected "), F.col(expected_col)))))
    return out


# Rows that a task writes as files of its own.
FILE_ROWS_PER_TASK = 20_000
MANIFEST = "path string, group_id bigint, output string"


def write_counted(rows: DataFrame, path: str) -> int:
    """Write JSON lines, replacing what is there, and return their number as counted while they were written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_groups(rows: DataFrame, out_root: str, group_col: str = "output", names: list[str] | None = None) -> dict[str, int]:
    """Write the rows of many groups as JSON lines in one job, those of a group to ``out_root/<group>`` without ``group_col``. They are
    written aside and each finished folder then takes the place of what is there. Returns the rows of each group: of those that have
    any, or with ``names`` also of the others, whose folders are empty."""
    spark = rows.sparkSession
    aside = f"{out_root.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    # by group, so each is one file; a task's share of groups follows the shuffle's size
    rows.repartition(group_col).write.partitionBy(group_col).json(aside)
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField(group_col, T.StringType())])
    lines = spark.read.schema(schema).text(aside).select(group_col).coalesce(4 * spark.sparkContext.defaultParallelism)
    counts = {**dict.fromkeys(names or [], 0), **{r[0]: r[1] for r in lines.groupBy(group_col).count().collect()}}
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(out_root).getFileSystem(spark._jsc.hadoopConfiguration())

    def place(group: str) -> None:
        done, target = path(f"{aside}/{group_col}={group}"), path(f"{out_root.rstrip('/')}/{group}")
        store.mkdirs(done)
        store.createNewFile(path(done, "_SUCCESS"))
        store.delete(target, True)
        if not store.rename(done, target):
            raise OSError(f"{target} could not be put in place")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(place, counts))
    store.delete(path(aside), True)
    return counts


def pending_shards(listing: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Paths of the listing that no committed group holds (``left_anti`` by path)."""
    paths = listing.select("path").distinct()
    return paths if manifest is None else paths.join(manifest.select("path"), "path", "left_anti")


def shard_groups(paths: DataFrame, group_size: int = C.SHARD_GROUP, first: int = 0) -> DataFrame:
    """S7 (batch twin): group index = ``first`` + position in the sorted paths // group_size, output name
    shard_%03d. One row per file; its position is a dense rank by path."""
    from stratum.operators.ordering import global_rank

    ranked = global_rank(paths.select("path"), [F.col("path")], out="_i")
    return ranked.select("path", (F.floor(F.col("_i") / F.lit(group_size)) + F.lit(first)).cast("bigint").alias("group_id")).withColumn(
        "output", F.format_string("shard_%03d", F.col("group_id")))


def run_incremental(spark: SparkSession, listing: DataFrame, out_root: str, process, group_size: int = C.SHARD_GROUP,
                    manifest_path: str | None = None, groups_at_once: int = 1) -> DataFrame:
    """Process the shards that no earlier run did. The manifest holds one row per processed path, so shards may arrive in any
    order of names; new groups are numbered after the largest committed one. ``process(paths_df) -> DataFrame`` gives
    the rows of one group, written as JSON lines to ``out_root/shard_%03d``; then the group's paths are appended to
    the manifest (commit marker), so a half-written group is redone. Returns (output, n_rows) of this run.

    With ``groups_at_once``, ``process`` gets the paths (path, group_id, output) of up to that many groups, and its rows must keep ``output``, the
    name of their group's folder; all of them are written and committed together, by a few jobs for any number of groups."""
    manifest_path = manifest_path or os.path.join(out_root, "_manifest")
    # with its schema declared, a folder that a failed first run left empty reads as no rows
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path) if path_exists(spark, manifest_path) else None
    first = 0 if manifest is None else manifest.agg(F.coalesce(F.max("group_id") + 1, F.lit(0))).first()[0]
    groups = shard_groups(pending_shards(listing, manifest), group_size, first).checkpoint(eager=True)
    done = []
    if groups_at_once > 1:
        top = groups.agg(F.max("group_id")).first()[0]
        for lo in range(first, -1 if top is None else top + 1, groups_at_once):
            paths = groups.where(F.col("group_id").between(lo, lo + groups_at_once - 1))
            names = [r["output"] for r in paths.select("output").distinct().collect()]
            counts = write_groups(process(paths), out_root, names=names)
            paths.select("path", "group_id", "output").coalesce(1).write.mode("append").parquet(manifest_path)
            done += sorted(counts.items())
        return spark.createDataFrame(done, "output string, n_rows long")
    for g in sorted(r["output"] for r in groups.select("output").distinct().collect()):
        paths = groups.where(F.col("output") == g)
        n = write_counted(process(paths), os.path.join(out_root, g))
        paths.select("path", "group_id", "output").coalesce(1).write.mode("append").parquet(manifest_path)
        done.append((g, n))
    return spark.createDataFrame(done, "output string, n_rows long")
