"""Queries of the quality-filter job (J1) and the projection/filter layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum import constants as C
from stratum import fixtures as fx
from stratum.functions.text import cer_score_below, squash_ws, strip_text
from stratum.operators.common import spread
from stratum.operators import filtering as flt
from stratum.plans import sql as S
from stratum.plans.registry import query
from stratum.session import table


@query("j1_quality_report", S.with_(S.F1) + f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(*) FILTER (WHERE cer < 10.0) AS BIGINT) AS n_kept,
       round(avg(cer) FILTER (WHERE cer < 10.0), 4) AS avg_cer_kept,
       max(cer) FILTER (WHERE cer < 10.0) AS max_cer_kept
FROM (SELECT lang, {S.cer('text', 'pred')} AS cer FROM f1) GROUP BY lang""")
def j1_quality_report(spark, sf_dir):
    """J1 without the recogniser: F1 pairs -> squash -> CER -> keep cer < 10 -> per language."""
    f1 = spread(fx.ref_hyp(spark, sf_dir), factor=4)  # per-row cost grows with length^2
    scored = f1.withColumn("cer", cer_score_below(F.col("text"), F.col("pred"), C.CER_THRESHOLD))
    kept = F.col("cer") < F.lit(C.CER_THRESHOLD)
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
        F.count(F.when(kept, 1)).cast("bigint").alias("n_kept"),
        F.round(F.avg(F.when(kept, F.col("cer"))), 4).alias("avg_cer_kept"),
        F.max(F.when(kept, F.col("cer"))).alias("max_cer_kept"))


@query("p1_flatten_meta", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def p1_flatten_meta(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("k"), "props")
    return flt.flatten_meta(ev, "props", "k bigint")  # the metadata k wins over the top-level k


@query("p2_prune_columns", "SELECT doc_id, lang, n_chars FROM documents")
def p2_prune_columns(spark, sf_dir):
    return flt.prune_columns(table(spark, sf_dir, "documents"), ["doc_id", "lang", "n_chars"])


_PADDED_SQL = "(chr(12288) || text || chr(160) || chr(10) || chr(31))"


@query("p3_strip_text", f"""
SELECT conv_id, turn, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS text_md5
FROM (SELECT conv_id, turn, {S.strip(_PADDED_SQL)} AS s FROM conversations)""")
def p3_strip_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    padded = F.concat(F.lit("　"), F.col("text"), F.lit(" \n\x1f"))
    s = strip_text(padded)
    return c.select("conv_id", "turn", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("text_md5"))


@query("p4_squash_ws", f"""
SELECT doc_id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS text_md5
FROM (SELECT doc_id, {S.squash('text')} AS s FROM documents)""")
def p4_squash_ws(spark, sf_dir):
    s = squash_ws(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("text_md5"))


@query("p5_cer_score", S.with_(S.F1) + f"SELECT doc_id, {S.cer('text', 'pred')} AS cer FROM f1")
def p5_cer_score(spark, sf_dir):
    return flt.score_cer(fx.ref_hyp(spark, sf_dir)).select("doc_id", "cer")


@query("p6_cer_filter", S.with_(S.F1) + f"""
SELECT doc_id, cer FROM (SELECT doc_id, {S.cer('text', 'pred')} AS cer FROM f1) WHERE cer < 10.0""")
def p6_cer_filter(spark, sf_dir):
    return flt.cer_filter(fx.ref_hyp(spark, sf_dir)).select("doc_id", "cer")


@query("p7_min_duration", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 8000")
def p7_min_duration(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return flt.min_duration(d, "n_chars", C.MIN_SAMPLES)


@query("p8_max_length", S.with_(S.F3) + "SELECT seq_id, length FROM f3 WHERE length <= 4096")
def p8_max_length(spark, sf_dir):
    return flt.max_length(fx.sequences(spark, sf_dir), "length", C.PACK_CAPACITY)


@query("p9_enrich_meta", S.with_(S.F1) + f"""
SELECT doc_id, md5(text) AS text_md5, md5(pred) AS pred_md5, cer
FROM (SELECT doc_id, text, pred, {S.cer('text', 'pred')} AS cer FROM f1) WHERE cer < 10.0""")
def p9_enrich_meta(spark, sf_dir):
    """J1 on shard-shaped samples: json struct<text, pred> gains ``cer`` inside the record."""
    f1 = fx.ref_hyp(spark, sf_dir)
    samples = f1.select("doc_id", F.struct("text", "pred").alias("json"))
    out = flt.quality_filter(samples)
    return out.select("doc_id", F.md5("json.text").alias("text_md5"), F.md5("json.pred").alias("pred_md5"),
                      F.col("json.cer").alias("cer"))
