"""Sequence packing.

Packing moves two columns: the narrow table (seq_id, length). Rows are put in the seeded
hash order of K1 and cut into ``n_buckets`` buckets that are contiguous in that order; each
bucket is packed by one ``applyInPandas`` call (numpy inside, ~rows/n_buckets rows of 16
bytes each). Results are therefore defined per bucket: a pack never crosses a bucket boundary.
``n_buckets`` is an argument, never derived from the data, so a row more or less changes its
own bucket only; choose it so that a bucket's narrow rows fit one task. The token arrays are
joined back once (K9).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum import constants as C
from stratum.operators.ordering import hash_int, with_epoch_order

PACK_ID_SHIFT = 2**32  # pack_id = bucket * 2^32 + pack number inside the bucket

_ASSIGN_SCHEMA = "bucket int, seq_id long, length int, pack_no int, pos int"


def _ordered(df: DataFrame, id_col: str, length_col: str, seed: int, epoch: int, n_buckets: int,
             capacity: int, oversize: str) -> DataFrame:
    if not n_buckets:
        raise ValueError("packs are defined per bucket: give n_buckets")
    narrow = df.select(F.col(id_col).cast("bigint").alias("seq_id"), F.col(length_col).cast("int").alias("length"))
    if oversize == "drop":
        narrow = narrow.where(F.col("length") <= F.lit(capacity))
    elif oversize == "error":
        narrow = narrow.withColumn("length", F.when(F.col("length") <= capacity, F.col("length"))
                                   .otherwise(F.raise_error(F.lit("row longer than pack capacity")).cast("int")))
    return with_epoch_order(narrow, "seq_id", seed, epoch, n_buckets).select("bucket", "_key", "seq_id", "length")


def _positions_in_packs(pack_no: np.ndarray, lengths: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Inside a pack rows go by length desc, seq_id asc."""
    order = np.lexsort((seq, -lengths, pack_no))
    pos = np.empty(len(order), dtype=np.int32)
    sorted_packs = pack_no[order]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_packs)) + 1]
    run = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    pos[order] = run
    return pos


def _next_fit_group(capacity: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "seq_id"], kind="mergesort")
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        packs = np.empty(len(lengths), dtype=np.int32)
        cur, no = 0, 0
        for i, n in enumerate(lengths):
            if i > 0 and cur + n > capacity:
                no += 1
                cur = 0
            cur += n
            packs[i] = no
        seq = pdf["seq_id"].to_numpy()
        return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(dtype=np.int32), "seq_id": seq,
                             "length": lengths.astype(np.int32), "pack_no": packs,
                             "pos": _positions_in_packs(packs, lengths, seq)})

    return fn


def pack_next_fit(df: DataFrame, id_col: str = "seq_id", length_col: str = "length", capacity: int = C.PACK_CAPACITY,
                  seed: int = 0, epoch: int = 0, n_buckets: int = C.PACK_BUCKETS, oversize: str = "drop") -> DataFrame:
    """K6: the corpus packer (multifit with one rank): take rows in shuffled order while the pack
    total stays <= capacity; inside a pack order rows by length desc. ``oversize``: "drop" (P8
    first, default), "error", or "own_pack" (an over-long row becomes its own pack).
    Returns (bucket, seq_id, length, pack_no, pos, pack_id)."""
    o = _ordered(df, id_col, length_col, seed, epoch, n_buckets, capacity, oversize)
    out = o.groupBy("bucket").applyInPandas(_next_fit_group(capacity), _ASSIGN_SCHEMA)
    return out.withColumn("pack_id", F.col("bucket").cast("bigint") * PACK_ID_SHIFT + F.col("pack_no"))


def ffd_assign(lengths: np.ndarray, seq: np.ndarray, capacity: int, max_bins: int | None = None):
    """First-fit decreasing: rows by length desc (tie seq_id asc); each goes to the first bin with
    room, else opens a bin. Returns (bin per row in input order, processing order) or None when
    ``max_bins`` is given and a row does not fit in that many bins.

    The first bin with room is found by a tournament tree over the bins' free space (unopened bins are empty ones), so a row
    takes log(rows) steps however many bins are open. A row longer than the capacity opens a bin of its own."""
    order = np.lexsort((seq, -lengths))
    leaves = 1 << max(len(lengths) - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    sizes = lengths.tolist()
    bins, opened = [0] * len(sizes), 0
    for i in order.tolist():
        size, node = sizes[i], 1
        if room[1] < size:
            node = leaves + opened
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        if node - leaves == opened:
            if max_bins is not None and opened >= max_bins:
                return None
            opened += 1
        bins[i] = node - leaves
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return np.array(bins, dtype=np.int32), order


def _ffd_group(capacity: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        seq = pdf["seq_id"].to_numpy()
        bins, order = ffd_assign(lengths, seq, capacity)
        pos = np.empty(len(lengths), dtype=np.int32)
        counts: dict[int, int] = {}
        for i in order:  # position = insertion order inside the bin
            b = int(bins[i])
            pos[i] = counts.get(b, 0)
            counts[b] = pos[i] + 1
        return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(dtype=np.int32), "seq_id": seq,
                             "length": lengths.astype(np.int32), "pack_no": bins, "pos": pos})

    return fn


def pack_ffd(df: DataFrame, id_col: str = "seq_id", length_col: str = "length", capacity: int = C.PACK_CAPACITY,
             seed: int = 0, epoch: int = 0, n_buckets: int = C.PACK_BUCKETS, oversize: str = "drop") -> DataFrame:
    """K4: first-fit decreasing per bucket; bins numbered in opening order."""
    o = _ordered(df, id_col, length_col, seed, epoch, n_buckets, capacity, oversize)
    out = o.groupBy("bucket").applyInPandas(_ffd_group(capacity), _ASSIGN_SCHEMA)
    return out.withColumn("pack_id", F.col("bucket").cast("bigint") * PACK_ID_SHIFT + F.col("pack_no"))


def ffd_fits(df: DataFrame, n_bins: int, id_col: str = "seq_id", length_col: str = "length",
             capacity: int = C.PACK_CAPACITY, seed: int = 0, epoch: int = 0,
             n_buckets: int = C.PACK_BUCKETS) -> DataFrame:
    """K3: can each bucket's rows be packed into ``n_bins`` bins by FFD? One row per bucket."""
    o = _ordered(df, id_col, length_col, seed, epoch, n_buckets, capacity, "keep")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        res = ffd_assign(pdf["length"].to_numpy(dtype=np.int64), pdf["seq_id"].to_numpy(), capacity, n_bins)
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "n_rows": [len(pdf)],
                             "fits": [res is not None]})

    return o.groupBy("bucket").applyInPandas(fn, "bucket int, n_rows long, fits boolean")


def rank_batches(lengths: np.ndarray, seq: np.ndarray, capacity: int, n: int):
    """K5 on one bucket in shuffled order: (batch_no, rank, pos) per row, -1 for rows of the tail.

    A batch is the longest run of next rows that first-fit decreasing places in ``n`` bins. No run
    beyond n * capacity tokens can be, so a window of that many tokens is shortened row by row until
    it fits. The rows left when a window can't fill all n bins are the tail."""
    batch, rank, pos = (np.full(len(lengths), -1, dtype=np.int32) for _ in range(3))
    ends = np.cumsum(lengths)
    begin, number = 0, 0
    while begin < len(lengths):
        limit = ends[begin] - lengths[begin] + n * capacity
        rows = slice(begin, int(np.searchsorted(ends, limit, side="right")))
        placed = ffd_assign(lengths[rows], seq[rows], capacity, n)
        while placed is None:
            rows = slice(begin, rows.stop - 1)
            placed = ffd_assign(lengths[rows], seq[rows], capacity, n)
        bins = placed[0]
        if len(bins) == 0 or bins.max() + 1 < n:
            break
        batch[rows], rank[rows] = number, bins
        pos[rows] = _positions_in_packs(bins, lengths[rows], seq[rows])
        begin, number = rows.stop, number + 1
    return batch, rank, pos


def pack_multifit(df: DataFrame, n_ranks: int, id_col: str = "seq_id", length_col: str = "length",
                  capacity: int = C.PACK_CAPACITY, seed: int = 0, epoch: int = 0,
                  n_buckets: int = C.PACK_BUCKETS, oversize: str = "drop") -> DataFrame:
    """K5: n ranks at once: the longest prefix that FFD fits in ``n_ranks`` bins forms a batch,
    bin r goes to rank r; stop when a prefix fills fewer than n bins. Output for all ranks;
    tail rows get NULL batch/rank (the reference drops them silently)."""
    o = _ordered(df, id_col, length_col, seed, epoch, n_buckets, capacity, oversize)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "seq_id"], kind="mergesort")
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        seq = pdf["seq_id"].to_numpy()
        b, r, p = rank_batches(lengths, seq, capacity, n_ranks)
        return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(dtype=np.int32), "seq_id": seq,
                             "length": lengths.astype(np.int32),
                             "batch_no": pd.array(np.where(b < 0, None, b), dtype="Int32"),
                             "rank": pd.array(np.where(r < 0, None, r), dtype="Int32"),
                             "pos": pd.array(np.where(p < 0, None, p), dtype="Int32")})

    out = o.groupBy("bucket").applyInPandas(
        fn, "bucket int, seq_id long, length int, batch_no int, rank int, pos int")
    return out.withColumn("batch_id", F.col("bucket").cast("bigint") * PACK_ID_SHIFT + F.col("batch_no"))


def assign_lanes(df: DataFrame, id_col: str, n_ranks: int, n_workers: int, seed: int = 0) -> DataFrame:
    """K8: lane = hash(seed:id) mod ranks*workers; rank = lane div workers; worker = lane mod
    workers; worker seed = rank * workers + worker (= lane)."""
    lanes = n_ranks * n_workers
    lane = F.pmod(hash_int(F.concat(F.lit(f"{seed}:lane:"), F.col(id_col).cast("string"))), F.lit(lanes))
    return (df.withColumn("lane", lane.cast("int"))
            .withColumn("rank", (F.col("lane") / F.lit(n_workers)).cast("int"))
            .withColumn("worker", F.pmod("lane", F.lit(n_workers)).cast("int"))
            .withColumn("worker_seed", F.col("rank") * F.lit(n_workers) + F.col("worker")))


def deal_packs(packs: DataFrame, n_ranks: int, pack_col: str = "pack_id") -> DataFrame:
    """K8 for packs of one rank (K4, K6): the packs of a bucket go round the ranks, so batch b holds the bucket's packs b * n_ranks
    to b * n_ranks + n_ranks - 1. Adds batch_id (as K5 numbers them) and rank; ``pack_col`` alone decides."""
    no = F.pmod(F.col(pack_col), F.lit(PACK_ID_SHIFT))
    bucket = F.floor(F.col(pack_col) / PACK_ID_SHIFT)
    return packs.withColumn("batch_id", (bucket * PACK_ID_SHIFT + F.floor(no / n_ranks)).cast("bigint")) \
        .withColumn("rank", F.pmod(no, F.lit(n_ranks)).cast("int"))


def write_ranks(packs: DataFrame, path: str, batches_per_file: int = 4096) -> None:
    """K8: one folder per rank with its packs in batch order: rows (batch_id, rank, ...) as Parquet partitioned by ``rank``; a
    file holds ``batches_per_file`` or fewer neighbouring batches of one rank, and its name sorts as they do. One shuffle, no
    rank or bucket is a single task."""
    batch = F.col("batch_id")
    w = packs.withColumn("chunk", (F.floor(batch / PACK_ID_SHIFT) * F.lit(1 << 20) + F.floor(F.pmod(batch, F.lit(PACK_ID_SHIFT)) / batches_per_file)).cast("bigint"))
    w.repartition("rank", "chunk").sortWithinPartitions("rank", "chunk", "batch_id").write.mode("overwrite").partitionBy("rank", "chunk").parquet(path)


def read_rank(spark, path: str, rank: int, chunks: tuple[int, int] | None = None) -> DataFrame:
    """The packs of one rank, or of a range of its chunks (both ends included); the other folders aren't opened. Sort by
    batch_id inside a chunk for the rank's order."""
    rows = spark.read.parquet(path).where(F.col("rank") == rank)
    return rows if chunks is None else rows.where(F.col("chunk").between(*chunks))


def split_tail(assign: DataFrame, batch_col: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """K5 rows in a batch, and the tail rows that fill no whole batch (to be reported or packed again)."""
    return assign.where(F.col(batch_col).isNotNull()), assign.where(F.col(batch_col).isNull())


def materialise_packs(assign: DataFrame, rows: DataFrame, pack_col: str | list[str] = "pack_id", id_col: str = "seq_id",
                      ids_col: str = "input_ids", labels_col: str = "labels") -> DataFrame:
    """K9: gather token rows into their packs, concatenated in ``pos`` order. ``pack_col`` names the
    columns that tell packs apart: pack_id for K4 and K6, [batch_id, rank] for K5, whose tail
    (no batch) belongs to no pack; see ``split_tail``.

    One equi join on seq_id and one aggregation on the pack; each pack holds at most
    ``capacity`` tokens, so the collected group is bounded. Position ids restart per member."""
    packs = [pack_col] if isinstance(pack_col, str) else list(pack_col)
    a = assign.dropna(subset=packs).select(*packs, F.col(id_col).alias("_sid"), "pos")
    r = rows.select(F.col(id_col).alias("_sid"), ids_col, labels_col)
    g = (a.join(r, "_sid", "inner").groupBy(*packs)
         .agg(F.array_sort(F.collect_list(F.struct("pos", ids_col, labels_col))).alias("_m"),
              F.count(F.lit(1)).alias("n_rows")))
    return g.select(
        *packs, "n_rows",
        F.flatten(F.transform("_m", lambda m: m[ids_col])).alias(ids_col),
        F.flatten(F.transform("_m", lambda m: m[labels_col])).alias(labels_col),
        F.flatten(F.transform("_m", lambda m: F.when(F.size(m[ids_col]) > 0,
                                                     F.sequence(F.lit(0), F.size(m[ids_col]) - 1))
                              .otherwise(F.array().cast("array<int>")))).alias("position_ids"))


def pad_rows(df: DataFrame, capacity: int, pad_id: int = 0, ids_col: str = "input_ids", labels_col: str = "labels",
             positions_col: str | None = "position_ids") -> DataFrame:
    """Right-pad ids with ``pad_id``, labels with -100, positions with 0..p-1 to ``capacity``.
    A row longer than the capacity is left as is and flagged ``oversize`` (never silently cut)."""
    df = df.withColumn("_n", F.size(ids_col)).withColumn("_p", F.greatest(F.lit(capacity) - F.col("_n"), F.lit(0)))
    p = F.col("_p")
    out = (df.withColumn(ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id).cast("bigint"), p)))
           .withColumn(labels_col, F.concat(F.col(labels_col),
                                            F.array_repeat(F.lit(C.IGNORE_INDEX).cast("bigint"), p))))
    if positions_col:
        tail = F.when(p > 0, F.sequence(F.lit(0), p - 1)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(positions_col, F.concat(F.col(positions_col), tail))
    return out.withColumn("oversize", F.col("_n") > F.lit(capacity)).drop("_n", "_p")


def packing_stats(assign: DataFrame, capacity: int, n_ranks: int = 1, pack_col: str = "pack_id",
                  length_col: str = "length") -> DataFrame:
    """Number of batches and efficiency = used tokens / (batches * capacity * ranks);
    NULL when no batch was formed."""
    packed = assign.where(F.col(pack_col).isNotNull())
    return packed.agg(
        F.countDistinct(pack_col).cast("bigint").alias("n_batches"),
        F.coalesce(F.sum(length_col), F.lit(0)).cast("bigint").alias("used_tokens"),
    ).withColumn("efficiency", F.round(F.try_divide(F.col("used_tokens").cast("double"),
                                                    F.col("n_batches") * F.lit(capacity * n_ranks)), 6))


def longest_row(df: DataFrame, ids_col: str = "input_ids") -> Column:
    """Max row length, as an aggregate expression."""
    return F.max(F.size(ids_col))
