"""Queries of sources and sinks (S1-S8). Files go to a fresh folder under the shared
``spark.checkpoint.dir``; nothing uses a machine-local temporary folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.operators.common import write_once
from stratum.plans import sql as S
from stratum.plans.q_packing import _SFT_PACKS
from stratum.plans.registry import query
from stratum.session import checkpoint_dir, table
from stratum.sources import files as fs
from stratum.sources import shards as sh
from stratum.streaming import jobs

DOCS_PER_TAR = 10


def _scratch(spark, what: str) -> str:
    return os.path.join(checkpoint_dir(spark).replace("file:", ""), f"{what}-{uuid.uuid4().hex}")


def _f9(spark, sf_dir):
    """documents as shard samples: members <doc_id>.txt (the payload) and <doc_id>.json
    (metadata with the reference text, as in the reference's shards)."""
    d = table(spark, sf_dir, "documents")
    members = F.create_map(F.lit("txt"), F.encode("text", "UTF-8"),
                           F.lit("json"), F.encode(F.to_json(F.struct("text", "lang", "source", "n_chars")),
                                                   "UTF-8"))
    samples = d.select("doc_id", F.col("doc_id").cast("string").alias("key"), members.alias("members"))
    path = _scratch(spark, "shards")
    n_files = sh.write_shards(samples, path, DOCS_PER_TAR, order_col="doc_id")
    return path, n_files


def _shard_paths(spark, root):
    return sh.list_shards(spark, root, sort=False)


_FILES_SQL = f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn,
                          greatest(1, count(*) OVER () // {DOCS_PER_TAR}) AS nf, count(*) OVER () AS n FROM documents),
files AS (SELECT doc_id, rn * nf // n AS file FROM r)
"""


@query("s3_write_shards", _FILES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(min(c) AS BIGINT) AS min_rows, CAST(max(c) AS BIGINT) AS max_rows
FROM (SELECT file, count(*) AS c FROM files GROUP BY file)""")
def s3_write_shards(spark, sf_dir):
    root, _ = _f9(spark, sf_dir)
    rows = sh.read_shards(spark, _shard_paths(spark, root))
    per = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).cast("bigint").alias("n_files"), F.min("c").cast("bigint").alias("min_rows"),
                   F.max("c").cast("bigint").alias("max_rows"))


@query("s1_read_shards", "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents")
def s1_read_shards(spark, sf_dir):
    root, _ = _f9(spark, sf_dir)
    s = sh.shard_samples(sh.read_shards(spark, _shard_paths(spark, root)), "lang string, source string, n_chars long")
    return s.select(F.col("key").cast("bigint").alias("doc_id"),
                    F.md5(F.decode(F.col("members")["txt"], "UTF-8")).alias("text_md5"),
                    F.col("json.lang").alias("lang"), F.col("json.n_chars").alias("n_chars"))


@query("s2_list_shards", _FILES_SQL + """
SELECT 'shard-' || lpad(file::VARCHAR, 6, '0') || '.tar' AS shard,
       CAST(row_number() OVER (ORDER BY file) - 1 AS BIGINT) AS position
FROM (SELECT DISTINCT file FROM files)""")
def s2_list_shards(spark, sf_dir):
    root, _ = _f9(spark, sf_dir)
    listing = sh.list_shards(spark, root, sort=False)
    from stratum.operators.ordering import global_rank

    ranked = global_rank(listing.select(F.regexp_extract("path", r"[^/]+$", 0).alias("shard")), [F.col("shard")],
                         out="position")
    return ranked.select("shard", "position")


@query("s3_overwrite_shards", """
SELECT CAST(greatest(1, n // 25) AS BIGINT) AS n_files, CAST(n AS BIGINT) AS n_rows, true AS least_kept
FROM (SELECT count(*) AS n FROM documents WHERE lang <> 'en')""")
def s3_overwrite_shards(spark, sf_dir):
    """Shards of all documents, then the folder overwritten with some of them: only the new rows are left, in files of at least 25."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("key"), F.create_map(F.lit("txt"), F.encode("text", "UTF-8")).alias("members"), "lang")
    path = _scratch(spark, "overwritten")
    sh.write_shards(rows, path, 10)
    sh.write_shards(rows.where("lang <> 'en'"), path, 25, overwrite=True)
    per = sh.read_shards(spark, _shard_paths(spark, path), members=[]).groupBy("shard").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).cast("bigint").alias("n_files"), F.sum("c").cast("bigint").alias("n_rows"),
                   ((F.min("c") >= 25) | (F.count(F.lit(1)) == 1)).alias("least_kept"))


@query("s4_write_jsonl", """
SELECT CAST(greatest(1, n // 30) AS BIGINT) AS n_files, CAST(n AS BIGINT) AS n_rows, CAST(n // greatest(1, n // 30) AS BIGINT) AS min_rows
FROM (SELECT count(*) AS n FROM documents)""")
def s4_write_jsonl(spark, sf_dir):
    path = _scratch(spark, "jsonl")
    fs.write_jsonl(fx.utterances(spark, sf_dir), path, 30)
    lines = spark.read.text(path).select(F.input_file_name().alias("file")).coalesce(4 * spark.sparkContext.defaultParallelism)
    per = lines.groupBy("file").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).cast("bigint").alias("n_files"), F.sum("c").cast("bigint").alias("n_rows"),
                   F.min("c").cast("bigint").alias("min_rows"))


@query("s5_load_rows", S.with_(S.F2) + """
SELECT doc_id, md5(text) AS text_md5, CAST(len(codes) AS BIGINT) AS n_codes,
       md5(array_to_string(codes, ',')) AS codes_md5 FROM f2""")
def s5_load_rows(spark, sf_dir):
    path = _scratch(spark, "jsonl")
    fs.write_jsonl(fx.utterances(spark, sf_dir), path)
    r = fs.load_rows(spark, path, "doc_id long, lang string, text string, codes array<int>")
    return r.select("doc_id", F.md5("text").alias("text_md5"), F.size("codes").cast("bigint").alias("n_codes"),
                    F.md5(F.array_join("codes", ",")).alias("codes_md5"))


@query("s6_write_packed", _SFT_PACKS + """
SELECT pack_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM gathered""")
def s6_write_packed(spark, sf_dir):
    """J3 as a job: SFT token rows written once, packed (K6), gathered (K9), written (S6), read back."""
    from stratum.plans.jobs import pack_corpus_job
    from stratum.plans.q_packing import CAP, NB
    from stratum.plans.q_tokens import sft_rows

    path = _scratch(spark, "packed")
    rows = sft_rows(spark, sf_dir).withColumnRenamed("doc_id", "seq_id")
    p = pack_corpus_job(rows, path, capacity=CAP, n_buckets=NB)
    return p.select("pack_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@query("s7_incremental_shards", _FILES_SQL + """,
f AS (SELECT file, file % 2 AS odd, count(*) AS n FROM files GROUP BY file),
o AS (SELECT *, row_number() OVER (PARTITION BY odd ORDER BY file) - 1 AS i, sum(odd) OVER () AS n_odd FROM f)
SELECT printf('shard_%03d', CAST(i // 8 + CASE WHEN odd = 1 THEN 0 ELSE ceil(n_odd / 8.0) END AS BIGINT)) AS output,
       CAST(sum(n) AS BIGINT) AS n_rows, CAST(CASE WHEN odd = 1 THEN 1 ELSE 2 END AS INTEGER) AS run
FROM o GROUP BY ALL""")
def s7_incremental_shards(spark, sf_dir):
    """Run 1 sees every other shard; run 2 sees all, the new ones before and between the old; run 3 finds nothing to do. Every shard
    is processed once."""
    root, _ = _f9(spark, sf_dir)
    out = _scratch(spark, "incremental")
    listing = write_once(sh.list_shards(spark, root, sort=False), "shard-listing")  # every run and group reads it
    number = F.regexp_extract("path", r"shard-([0-9]+)[.]tar$", 1).cast("bigint")

    def process(paths_df):
        s = sh.read_shards(spark, listing.join(paths_df.select("path", "output"), "path"), tag="output")
        return s.select("output", F.col("key").cast("bigint").alias("doc_id"), F.decode(F.col("members")["txt"], "UTF-8")
                        .alias("text"))

    runs = [fs.run_incremental(spark, seen, out, process, group_size=8, groups_at_once=1024).withColumn("run", F.lit(k + 1))
            for k, seen in enumerate([listing.where(number % 2 == 1), listing, listing])]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("s8_verify_checksum", S.with_(S.F1) + """
SELECT doc_id, substr(sha256(pred), 1, 12) AS sha_prefix, starts_with(sha256(pred), substr(sha256(text), 1, 12)) AS ok
FROM f1""")
def s8_verify_checksum(spark, sf_dir):
    f1 = fx.ref_hyp(spark, sf_dir).withColumn("expected", F.substring(F.sha2("text", 256), 1, 12))
    v = fs.verify_checksum(f1, "pred", "expected")
    return v.select("doc_id", F.substring("sha256", 1, 12).alias("sha_prefix"), "ok")


@query("j1_filter_shards", f"""
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, md5(replace(text, 'e', '')) AS pred_md5, round(cer, 4) AS cer, 4 + 2 AS n_keys
FROM (SELECT *, {S.cer('text', "replace(text, 'e', '')")} AS cer FROM documents) WHERE cer < 10.0""")
def j1_filter_shards(spark, sf_dir):
    """J1 from shard to shard: F9 tars -> recogniser stub (U1) -> CER < 10 -> json keeps its keys and gains pred/cer
    -> tars of at least 100 samples; the whole records are read back."""
    from stratum.functions.batch_udf import make_stub_recogniser
    from stratum.plans.jobs import quality_filter_job

    root, _ = _f9(spark, sf_dir)
    out = _scratch(spark, "filtered")
    quality_filter_job(spark, _shard_paths(spark, root), out, make_stub_recogniser, min_rows_per_file=100)
    back = sh.shard_samples(sh.read_shards(spark, _shard_paths(spark, out)),
                            "text string, pred string, cer double, lang string, source string, n_chars long")
    keys = F.json_object_keys(F.decode(F.col("members")["json"], "UTF-8"))
    return back.select(F.col("key").cast("bigint").alias("doc_id"), "json.lang", "json.source", "json.n_chars",
                       F.md5("json.text").alias("text_md5"), F.md5("json.pred").alias("pred_md5"),
                       F.round("json.cer", 4).alias("cer"), F.size(keys).alias("n_keys"))
