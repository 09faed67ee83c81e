"""Projection, filter and nested-record operators of the quality-filter job.

Filters are plain ``where`` clauses so Catalyst pushes them below projections and into the
Parquet scan; the only costly expression (edit distance) runs after every cheaper filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum import constants as C
from stratum.functions.text import cer_score, cer_score_below
from stratum.operators.common import spread


def flatten_meta(df: DataFrame, meta_col: str, meta_ddl: str, keep: list[str] | None = None) -> DataFrame:
    """Parse ``meta_col`` (JSON string or struct) with a declared schema and splat its fields
    to the top level. On a name clash the metadata value wins (it is splatted last)."""
    meta = F.from_json(F.col(meta_col), meta_ddl) if dict(df.dtypes)[meta_col] == "string" else F.col(meta_col)
    parsed = df.withColumn("_meta", meta)
    fields = [f.name for f in parsed.schema["_meta"].dataType.fields]
    base = [c for c in (keep or df.columns) if c != meta_col and c not in fields]
    return parsed.select(*base, *[F.col("_meta")[f].alias(f) for f in fields])


def prune_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Keep only the produced columns (lets Parquet read only those)."""
    return df.select(*keep)


def score_cer(df: DataFrame, ref_col: str = "text", hyp_col: str = "pred", out: str = "cer",
              native: bool = False) -> DataFrame:
    """P5: exact CER score for every row."""
    return spread(df, factor=4).withColumn(out, cer_score(F.col(ref_col), F.col(hyp_col), native))


def cer_filter(df: DataFrame, ref_col: str = "text", hyp_col: str = "pred", threshold: float = C.CER_THRESHOLD,
               out: str = "cer", native: bool = False) -> DataFrame:
    """P5 + P6: keep rows with score < threshold (strict). NULL scores (empty reference) are dropped.
    Rows whose length difference alone reaches the threshold are dropped without a distance."""
    score = cer_score(F.col(ref_col), F.col(hyp_col), native=True) if native \
        else cer_score_below(F.col(ref_col), F.col(hyp_col), threshold)
    return spread(df, factor=4).withColumn(out, score).where(F.col(out) < F.lit(threshold))


def min_duration(df: DataFrame, n_samples_col: str, min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """Keep clips with at least ``min_samples`` samples (inclusive)."""
    return df.where(F.col(n_samples_col) >= F.lit(min_samples))


def max_length(df: DataFrame, length_col: str = "length", cap: int = C.PACK_CAPACITY) -> DataFrame:
    """Drop rows longer than the capacity."""
    return df.where(F.col(length_col) <= F.lit(cap))


def enrich_meta(df: DataFrame, meta_col: str = "json", **fields) -> DataFrame:
    """Add fields inside the nested record (``meta.withField``)."""
    m = F.col(meta_col)
    for name, value in fields.items():
        m = m.withField(name, value)
    return df.withColumn(meta_col, m)


def quality_filter(samples: DataFrame, threshold: float = C.CER_THRESHOLD, meta_col: str = "json") -> DataFrame:
    """J1 without the recogniser: samples carry ``json.text`` and ``json.pred`` (from U1);
    score with squashed whitespace, keep ``cer < threshold`` and record ``cer`` in the record."""
    scored = spread(samples, factor=4).withColumn(
        "_cer", cer_score_below(F.col(f"{meta_col}.text"), F.col(f"{meta_col}.pred"), threshold))
    kept = scored.where(F.col("_cer") < F.lit(threshold))
    return enrich_meta(kept, meta_col, cer=F.col("_cer")).drop("_cer")
