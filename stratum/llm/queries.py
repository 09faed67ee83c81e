"""Registers one query per operator, each over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.llm import embedding_dedup, language_id, mixing, ngram_join, pii, suffix_dedup
from stratum.llm import sentencepiece_codec as codec
from stratum.llm.common import read_columns, text_or_empty
from stratum.llm.embedding_whitening import whiten
from stratum.llm.exact_dedup import exact_dedup
from stratum.llm.fill_in_middle import cut_texts, restored
from stratum.llm.sentencepiece_codec import normalised
from stratum.llm.sharding import shard_documents
from stratum.llm.token_count import count_tokens
from stratum.llm.warc import read_archives, write_archives

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op1_exact_dedup", oracle="""
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op1_exact_dedup(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(text_or_empty("text"), 256)})


@query("op4_token_count")
def op4_token_count(spark, sf_dir):
    return count_tokens(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_ring_sharding")
def op10_ring_sharding(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    rows = shard_documents(docs, 16, carry={"size": size, "text_crc32": F.crc32(F.encode(text_or_empty("text"), "UTF-8"))})
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op3_sentencepiece_codec")
def op3_sentencepiece_codec(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    want = docs.select("doc_id", "text", F.xxhash64(normalised(F.col("text"))).alias("want"))
    back = codec.encode(want, keep=["doc_id", "want"], verify=True, decoded_col="decoded")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"),
                       (F.xxhash64("decoded") == F.col("want")).alias("round_trip"), "same_as_library")


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text", "lang")
    book = language_id.train(docs)
    rows = docs.select("doc_id", "text", language_id.held_out("doc_id").alias("held_out"))
    return language_id.identify(rows, book, keep=["doc_id", "held_out"]) \
        .select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op2_pii")
def op2_pii(spark, sf_dir):
    rows = pii.find_pii(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                       pii.span_text(F.col("spans")).alias("spans"))


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text", "source")
    labelled = mixing.label_domains(read_columns(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    rows = mixing.mix(docs, labelled, carry={"source": F.col("source")})
    domains = sorted(mixing.TARGETS)
    return rows.select("doc_id", "source", "n_tokens", *[F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)], "rate", "copies")


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    return ngram_join.jaccard_components(docs, n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_fill_in_middle", oracle="""
    WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                      sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    k AS (SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS UBIGINT) % (n + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS UBIGINT) % (n + 1) AS c2,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                           OR CAST('0x' || substr(x, 17, 8) AS UBIGINT) % 100 >= 90 THEN 'plain'
                      WHEN CAST('0x' || substr(x, 25, 8) AS UBIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT doc_id, t, n, form, CAST(least(c1, c2) AS BIGINT) AS a, CAST(greatest(c1, c2) AS BIGINT) AS b FROM k),
    p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p""")
def op12_fill_in_middle(spark, sf_dir):
    rows = cut_texts(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    rows = whiten(read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=4)
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))  # null where it leaves the contract's type


@query("op11_warc", oracle="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    g AS (SELECT page_id, n, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS last FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
    FROM g""")
def op11_warc(spark, sf_dir):
    pages = read_columns(spark, sf_dir, "pages", "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    return read_archives(write_archives(pages)).select(
        F.col("row_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
