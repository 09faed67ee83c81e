"""Aggregations and statistics (A1-A4): quantised CDF, weighted metrics, worker uniformity,
top-k checkpoint averaging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum import constants as C


def quantised_cdf(counts: DataFrame, cardinality: int, total_range_bits: int, group_col: str = "grp",
                  symbol_col: str = "symbol", n_col: str = "n", roundoff: float = C.CDF_ROUNDOFF,
                  min_range: int = C.CDF_MIN_RANGE, check: bool = True) -> DataFrame:
    """A1: per group, pdf = count / total over symbols 0..cardinality-1 (missing symbols 0),
    rounded down to ``roundoff``; range = floor((1 - alpha) * 2^b * pdf) + min_range with
    alpha = min_range * N / 2^b; cdf = running sum in symbol order. Checks raise in the plan."""
    if min_range < 2:
        raise ValueError(f"a range of {min_range} leaves no room to code a symbol; use 2 or more")
    total_range = 2**total_range_bits
    alpha = min_range * cardinality / total_range
    if alpha > 1:
        raise ValueError(f"{cardinality} symbols of range {min_range} exceed 2^{total_range_bits}")
    # every symbol of every group (groups x cardinality rows): generated per group, no cross join
    full = counts.select(group_col).distinct().select(
        group_col, F.explode(F.sequence(F.lit(0), F.lit(cardinality - 1))).alias(symbol_col)).join(
        counts.select(group_col, F.col(symbol_col).cast("int").alias(symbol_col), n_col), [group_col, symbol_col],
        "left").withColumn(n_col, F.coalesce(F.col(n_col), F.lit(0)))
    tot = F.sum(n_col).over(Window.partitionBy(group_col))
    pdf = F.col(n_col).cast("double") / tot
    if roundoff:
        pdf = F.floor(pdf / F.lit(roundoff)) * F.lit(roundoff)
    ranges = (F.floor(F.lit((1 - alpha) * total_range) * pdf) + F.lit(min_range)).cast("bigint")
    w = Window.partitionBy(group_col).orderBy(symbol_col).rowsBetween(Window.unboundedPreceding, 0)
    out = full.withColumn("range", ranges).withColumn("cdf", F.sum("range").over(w).cast("bigint"))
    if check:
        out = out.withColumn("cdf", F.when(F.col("cdf") <= F.lit(total_range), F.col("cdf")).otherwise(
            F.raise_error(F.lit("quantized cdf exceeds the total range")).cast("bigint")))
    return out.select(group_col, symbol_col, "range", "cdf")


def weighted_metrics(df: DataFrame, name_col: str = "name", value_col: str = "value",
                     weight_col: str = "weight") -> DataFrame:
    """A2: sum(value * weight) / sum(weight) per metric name (partial + final aggregation)."""
    return df.groupBy(name_col).agg(
        (F.sum(F.col(value_col) * F.col(weight_col)) / F.sum(weight_col)).alias("avg_value"))


def assert_uniform(df: DataFrame, worker_col: str = "worker", raise_on_mismatch: bool = False) -> DataFrame:
    """A3: do all workers hold the same number of rows? One report row; with
    ``raise_on_mismatch`` the plan fails like the reference's runtime check."""
    per = df.groupBy(worker_col).agg(F.count(F.lit(1)).alias("_n"))
    rep = per.agg(F.count(F.lit(1)).cast("bigint").alias("n_workers"), F.min("_n").cast("bigint").alias("min_count"),
                  F.max("_n").cast("bigint").alias("max_count"), F.sum("_n").cast("bigint").alias("total"))
    rep = rep.withColumn("uniform", F.col("total") == F.col("min_count") * F.col("n_workers"))
    if raise_on_mismatch:
        rep = rep.withColumn("uniform", F.when(F.col("uniform"), F.lit(True)).otherwise(
            F.raise_error(F.lit("workers hold different numbers of rows")).cast("boolean")))
    return rep


def topk_average(params: DataFrame, k: int = C.TOPK_CHECKPOINTS, file_col: str = "file", name_col: str = "name",
                 vec_col: str = "vec", prefix: str = C.CHECKPOINT_PREFIX,
                 keep_prefixes: tuple[str, ...] = C.CHECKPOINT_PARAM_PREFIXES) -> DataFrame:
    """A4: among files named ``prefix...``, the metric is name characters -11..-6 compared as
    strings; keep files whose metric is among the k lowest (ties kept: rank() <= k); keep
    parameters with one of ``keep_prefixes``; average each parameter elementwise over them."""
    files = (params.select(file_col).distinct().where(F.col(file_col).startswith(prefix))
             .withColumn("_metric", F.substring(F.col(file_col), -11, 6)))
    # one row per checkpoint file: a small table, ranked in one window
    chosen = files.withColumn("_r", F.rank().over(Window.orderBy("_metric"))).where(F.col("_r") <= k)
    keep = F.lit(False)
    for p in keep_prefixes:
        keep = keep | F.col(name_col).startswith(p)
    sel = params.where(keep).join(F.broadcast(chosen.select(file_col)), file_col)
    ex = sel.select(name_col, F.posexplode(vec_col).alias("pos", "_x"))
    return ex.groupBy(name_col, "pos").agg(F.avg("_x").alias("value"))
