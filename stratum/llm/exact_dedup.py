"""Operator 1: exact dedup by progressive refinement (length, prefix hash, full hash). Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import flag_filter, flag_slot, join_groups, materialise, text_or_empty, with_flag


def _shared_slots(narrow: DataFrame) -> DataFrame:
    """Bitmaps of the (length, prefix hash) slots that more than one row falls into.

    First the lengths with one row go, then the (length, prefix hash) pairs with one row."""
    pairs = narrow.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    lens = pairs.groupBy("_len").agg(F.sum("n").alias("n_len")).where("n_len > 1")
    twice = pairs.where("n > 1").join(lens, "_len", "left_semi")
    return flag_filter(twice, flag_slot(F.col("_len"), F.col("_prefix")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
                carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, then the ``carry`` expressions over the input row.

    Texts are equal when identical; null counts as empty. The row with the largest id of a group stays.
    1. A narrow table (byte length, hash of the first ``prefix_chars`` characters) is written once; lengths held
       by one row are settled, then (length, prefix) pairs held by one row.
    2. The remaining pairs become a bitmap of fixed size; its false positives only cost work. Rows outside it are
       unique. Only rows inside get a SHA-256 over the full text, so equal groups are (length, SHA-256).
    3. Groups are counted with map-side aggregation; a group that holds much of the table reaches its rows by a
       bounded broadcast (``join_groups``), never in one task.

    Texts are never shuffled. Rows repeated with equal id and text count as copies; exactly one is kept. A null
    id loses against every other; a group of null ids only has keep_id null and one kept row. An empty table
    gives an empty result."""
    text = text_or_empty(text_col)
    narrow = materialise(docs.select(F.octet_length(text).alias("_len"),
                                     F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")), "op1-narrow")
    carry = carry or {}
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *[v.alias(k) for k, v in carry.items()]) \
        .withColumn("_len", F.octet_length("_text"))
    rows = with_flag(rows, _shared_slots(narrow), flag_slot(F.col("_len"), F.xxhash64(F.substring("_text", 1, prefix_chars))), "_flag") \
        .select("_id", *carry, "_len", F.when(F.col("_flag"), F.unhex(F.sha2("_text", 256))).alias("_full"),
                F.monotonically_increasing_id().alias("_row"))
    rows = materialise(rows, "op1-rows")
    groups = rows.where("_full is not null").groupBy("_len", "_full") \
        .agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count(F.lit(1)).alias("group_size"))
    alone = rows.where("_full is null").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), *carry)
    shared = join_groups(rows.where("_full is not null"), groups, ["_len", "_full"], "group_size", F.col("_row")).select(
        F.col("_id").alias(id_col), F.col("_top._id").alias("keep_id"), "group_size",
        (F.col("_top._row") == F.col("_row")).alias("kept"), *carry)
    return alone.unionByName(shared)
