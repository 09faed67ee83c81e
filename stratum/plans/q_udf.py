"""Queries of the UDF surface."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum import constants as C
from stratum import fixtures as fx
from stratum.functions import batch_udf as bu
from stratum.functions.text import cer_score_below
from stratum.operators.common import spread
from stratum.plans import sql as S
from stratum.plans.q_tokens import _SFT, _vocab
from stratum.plans.registry import query
from stratum.session import table


@query("u1_score_batches", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (WHERE cer < 10.0) AS BIGINT) AS n_kept,
       round(avg(cer) FILTER (WHERE cer < 10.0), 4) AS avg_cer_kept
FROM (SELECT lang, {S.cer('text', "replace(text, 'e', '')")} AS cer FROM documents) GROUP BY lang""")
def u1_score_batches(spark, sf_dir):
    """J1 with a recogniser plugged in through the batch UDF (stub model, batches of 128)."""
    recognise = bu.score_batches(bu.make_stub_recogniser, T.StringType(), batch_size=128)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = spread(d, factor=4).withColumn("pred", recognise("text")).withColumn(
        "cer", cer_score_below(F.col("text"), F.col("pred"), C.CER_THRESHOLD))
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
        F.count(F.when(F.col("cer") < C.CER_THRESHOLD, 1)).cast("bigint").alias("n_kept"),
        F.round(F.avg(F.when(F.col("cer") < C.CER_THRESHOLD, F.col("cer"))), 4).alias("avg_cer_kept"))


@query("u2_map_rows", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def u2_map_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bu.map_rows(d, bu.ByteCounter, "doc_id long, n_bytes long")


@query("u3_tokenise_fn", _SFT + """
SELECT doc_id, CAST(len(ids) AS BIGINT) AS length, md5(array_to_string(ids, ',')) AS ids_md5,
       md5(array_to_string(labels, ',')) AS labels_md5 FROM sft""")
def u3_tokenise_fn(spark, sf_dir):
    fn = bu.make_tokenise_fn(_vocab(spark, sf_dir), use_chat_template=True)
    r = fn(fx.utterances(spark, sf_dir))
    return r.select("doc_id", F.col("length").cast("bigint"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"))
