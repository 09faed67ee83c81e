"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, SentencePiece ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) with ``docs`` a table with the columns of
``documents`` and gives the next one's ``docs``. All but the last return exactly the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm import language_id, mixing, ngram_join, sentencepiece_codec
from stratum.llm.common import materialise, read_columns, text_or_empty
from stratum.llm.exact_dedup import exact_dedup


def _kept_rows(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose (id, hash of the text) is among ``keys`` (_kid, _khash), nulls equal to nulls; with
    ``once``, one of the rows that agree on both."""
    rows = docs.withColumn("_h", F.xxhash64(text_or_empty("text")))
    match = rows["doc_id"].eqNullSafe(keys["_kid"]) & (rows["_h"] == keys["_khash"])
    rows = rows.join(keys, match, "left_semi")
    if once:
        w = Window.partitionBy("doc_id", "_h").orderBy("doc_id")
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows.select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Rejected: texts without a letter, and texts whose two nearest languages can't be told apart."""
    book = language_id.train(docs)
    rows = language_id.identify(docs, book, keep=docs.columns)
    return rows.where("lang_pred <> 'und' and not ambiguous").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Of equal texts the row with the largest id stays."""
    found = exact_dedup(docs.select("doc_id", "text"), carry={"_khash": F.xxhash64(text_or_empty("text"))})
    keys = materialise(found.where("kept").select(F.col("doc_id").alias("_kid"), "_khash"), "pipeline-exact")
    return _kept_rows(docs, keys, once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 with five words and a similarity of 0.8. One row of each component stays: the one with the smallest id (null
    last), of several such the one with the smallest hash of the text, of equal rows any. Texts without words all stay."""
    found = ngram_join.jaccard_components(docs.select("doc_id", "text"), n=5, num=4, den=5, carry={"_khash": F.xxhash64(text_or_empty("text"))})
    keys = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_kid"), "_khash") \
        .agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).where("not _kept or _rows > 1")
    keys = materialise(keys, "pipeline-near")
    rows = docs.withColumn("_h", F.xxhash64(text_or_empty("text")))
    match = rows["doc_id"].eqNullSafe(keys["_kid"]) & (rows["_h"] == keys["_khash"])
    out = rows.join(keys, match, "left_anti").select(*docs.columns)
    again = keys.where("_kept").select("_kid", "_khash")
    return out if again.isEmpty() else out.unionByName(_kept_rows(docs, again, once=True))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Each row comes as often as its rate says: not at all, once or more often."""
    labelled = mixing.label_domains(read_columns(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    rated = mixing.mix(docs.select("doc_id", "text"), labelled, carry={"_khash": F.xxhash64(text_or_empty("text"))})
    copies = materialise(rated.groupBy(F.col("doc_id").alias("_kid"), "_khash").agg(F.max("copies").alias("_copies")), "pipeline-mix")
    rows = docs.withColumn("_h", F.xxhash64(text_or_empty("text")))
    match = rows["doc_id"].eqNullSafe(copies["_kid"]) & (rows["_h"] == copies["_khash"])
    return rows.join(copies, match, "inner").where("_copies > 0") \
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. doc_id, lang, source, n_tokens and the ids of every remaining row."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"], batch_mb=4)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_targets),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the language model, the mixing classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
