"""Operator 10: sharding by a consistent-hash ring with virtual nodes and bounded loads. Native."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratum.llm.common import materialise, text_or_empty

#: The ring is cut into this many equal cells; a virtual node stands at the start of its cell.
RING_CELLS = 1 << 14
VIRTUAL_NODES = 64


def ring_owners(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = RING_CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes clockwise. A node's place depends on its shard and number alone, so a ring
    with one more shard has all these nodes and some more; of two in one cell the smaller hash stands."""
    at: dict[int, tuple[int, int]] = {}
    for s in range(n_shards):
        for v in range(virtual_nodes):
            h = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big")
            at[h % cells] = min(at.get(h % cells, (h, s)), (h, s))
    return [(c, at[c][1]) for c in sorted(at)]


def bounded_flow(counts: dict[int, int], n_shards: int, virtual_nodes: int = VIRTUAL_NODES,
                 cells: int = RING_CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first, after, shard, slot of first): which ranks of each cell's keys go to which shard.

    Cells are served clockwise from 0. A key goes to the first shard clockwise that has room; the first
    total mod n shards hold one key more than the others. At most cells + n_shards entries."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    ring = ring_owners(n_shards, virtual_nodes, cells)
    out, i = [], 0
    for cell in sorted(counts):
        while i < len(ring) and ring[i][0] < cell:
            i += 1
        first, k = 0, i
        while first < counts[cell]:
            shard = ring[k % len(ring)][1]
            take = min(counts[cell] - first, room[shard] - used[shard])
            if take:
                out.append((cell, first, first + take, shard, used[shard]))
                used[shard] += take
                first += take
            k += 1
    return out


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, shard (0 to n_shards - 1), slot (gapless from 0 in each shard), ``carry``.

    A key's place on the ring is a hash of its id (of its text where the id is null). Keys are taken clockwise by
    (place, id); each goes to the owner of the next virtual node, and past full shards continues clockwise.
    Every shard may hold its exact share, so counts are at most one apart: law ``rows``. Only the row count
    of each of the RING_CELLS cells reaches the driver, and only the flow table (cells + shards entries) goes
    back. A cell's rows are ranked in one sort that spills. Repeated rows are rows of their own; null texts have no bytes. An
    empty table gives an empty result."""
    carry = carry or {}
    place = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit("id"), F.col(id_col).cast("string"))) \
        .otherwise(F.xxhash64(F.lit("text"), text_or_empty(text_col)))
    rows = docs.select(F.col(id_col).alias("_id"), place.alias("_place"), *[v.alias(k) for k, v in carry.items()]) \
        .withColumn("_cell", F.pmod(F.shiftrightunsigned("_place", 20), F.lit(RING_CELLS)).cast("int"))
    rows = materialise(rows, "op10-rows")
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    flow = docs.sparkSession.createDataFrame(
        bounded_flow(counts, n_shards) or [], "_cell int, _first bigint, _after bigint, shard int, _slot bigint")
    w = Window.partitionBy("_cell").orderBy("_place", "_id", *carry)
    ranked = rows.withColumn("_rank", F.row_number().over(w).cast("bigint") - 1)
    f = F.broadcast(flow.withColumnRenamed("_cell", "_fcell"))
    return ranked.join(f, (F.col("_cell") == F.col("_fcell")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_after"))) \
        .select(F.col("_id").alias(id_col), "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"), *carry)


def moved_rows(docs: DataFrame, n_before: int, n_after: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: rows, and how many change their shard when the ring goes from ``n_before`` to ``n_after`` shards.
    Ids must be unique."""
    a = shard_documents(docs, n_before, id_col, text_col).select(id_col, F.col("shard").alias("a"))
    b = shard_documents(docs, n_after, id_col, text_col).select(id_col, F.col("shard").alias("b"))
    return a.join(b, id_col).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
