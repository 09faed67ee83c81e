"""Derived fixtures F1-F8 (see FIXTURES.md), built by Spark from the driver tables.

Each one grows with its source table; the DuckDB twins live in ``stratum.plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum import constants as C
from stratum.operators.ordering import dense_position
from stratum.session import table

_ASCII_WS_RUN = r"[^ \t\n\r\f\x0b]+"


def ref_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reference text and a deterministic 'transcript' (deletion-only edits of ASCII characters)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rule = F.pmod(F.col("doc_id"), F.lit(3))
    pred = (F.when(rule == 1, F.regexp_replace("text", "e", ""))
            .when(rule == 2, F.regexp_replace("text", "[.,]", ""))
            .otherwise(F.col("text")))
    return d.withColumn("pred", pred)


def _code_at(doc_id, i):
    return F.conv(F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(":"), i.cast("string"))), 1, 3),
                  16, 10).cast("int")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, text, codes) with 1 + n_chars % 64 codes in 0..4095."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    m = F.lit(1) + F.pmod(F.col("n_chars"), F.lit(64))
    codes = F.transform(F.sequence(F.lit(1), m.cast("int")), lambda i: _code_at(F.col("doc_id"), i))
    return d.select("doc_id", "lang", "text", codes.alias("codes"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, length) with length = whitespace word count of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").alias("seq_id"),
                    F.regexp_count("text", F.lit(_ASCII_WS_RUN)).cast("int").alias("length"))


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two 16-code layers from the whole embeddings table: layer 0 code c = elementwise mean of
    the embeddings with vec_id % 16 = c; layer 1 code c = 0.25 x the mean of those with
    (vec_id div 16) % 16 = c. A partial aggregate per (layer, code, dim)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    l0 = e.select(F.lit(0).alias("layer"), F.pmod("vec_id", F.lit(16)).cast("int").alias("code"), "pos",
                  F.col("x").cast("double").alias("x"))
    l1 = e.select(F.lit(1).alias("layer"), F.pmod(F.floor(F.col("vec_id") / 16), F.lit(16)).cast("int").alias("code"),
                  "pos", F.col("x").cast("double").alias("x"))
    means = l0.unionByName(l1).groupBy("layer", "code", "pos").agg(F.avg("x").alias("x"))
    scale = F.when(F.col("layer") == 1, F.lit(0.25)).otherwise(F.lit(1.0))
    vec = means.groupBy("layer", "code").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    return vec.select("layer", "code", F.transform("_v", lambda s: s["x"] * scale).alias("centroid"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input vectors for quantisation: (vec_id, vec array<double>)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def series(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """events per user as an ordered series (series_id, pos, value); pos = 0.. by (ts, event_id).

    ``materialize`` writes it once to the checkpoint folder, for plans that read it repeatedly."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ev = ev.withColumn("_chunk", F.col("ts").cast("date"))  # calendar day of the wall-clock time
    pos = dense_position(ev, partition_cols=["user_id"], chunk_col="_chunk", order_cols=["ts", "event_id"])
    out = pos.select(F.col("user_id").alias("series_id"), F.col("_pos").cast("int").alias("pos"), "value")
    if materialize:
        from stratum.session import checkpoint_dir

        checkpoint_dir(spark)
        out = out.checkpoint(eager=True)
    return out


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-worker metric rows (worker, name, value, weight)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.pmod("user_id", F.lit(8)).alias("worker"), F.col("event_type").alias("name"),
                     F.col("value"), (F.lit(1) + F.pmod("event_id", F.lit(5))).cast("double").alias("weight"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol counts per group from the F2 codes (grp = lang, symbol = code % 64)."""
    u = utterances(spark, sf_dir)
    return (u.select(F.col("lang").alias("grp"), F.explode("codes").alias("code"))
            .groupBy("grp", F.pmod("code", F.lit(64)).alias("symbol")).agg(F.count(F.lit(1)).alias("n")))


PARAM_NAMES = ("backbone.w", "head.w", "feature_extractor.w", "encoder.w", "backbone.b")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: checkpoint parameter rows (file, name, vec array<double>) from embeddings.

    ckpt = label; file = vocos_<ckpt>_0.<ckpt % 4>000.ckpt (label 9 is named other_...);
    a parameter (ckpt, name) is the elementwise sum of the embeddings with that label and
    name = PARAM_NAMES[vec_id % 5].
    """
    e = table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(n) for n in PARAM_NAMES])
    rows = e.select(
        F.col("label").alias("ckpt"),
        F.element_at(names, (F.pmod("vec_id", F.lit(5)) + 1).cast("int")).alias("name"),
        F.posexplode("embedding").alias("pos", "x"),
    )
    summed = rows.groupBy("ckpt", "name", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    vec = summed.groupBy("ckpt", "name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    file = F.concat(F.when(F.col("ckpt") == 9, F.lit("other_")).otherwise(F.lit(C.CHECKPOINT_PREFIX)),
                    F.col("ckpt").cast("string"), F.lit("_0."), F.pmod("ckpt", F.lit(4)).cast("string"),
                    F.lit("000.ckpt"))
    return vec.select(file.alias("file"), "name", F.transform("_v", lambda s: s["x"]).alias("vec"))


def written(df):
    """``df`` written once to the shared folder and read back, for plans that read it several times."""
    from stratum.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
