"""Queries of the token layer (T1-T10): render, vocabulary, ids, labels, positions, shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.functions import text as tx
from stratum.operators import tokens as tk
from stratum.operators.common import spread, write_once
from stratum.plans import sql as S
from stratum.plans.registry import query
from stratum.session import table

TOKRE = tk.TOKEN_PATTERN
MARKRE = tk.MARKUP_PATTERN


def _ids_md5(c):
    return F.md5(F.array_join(F.col(c) if isinstance(c, str) else c, ","))


# ---------------------------------------------------------------- DuckDB pieces
_CHAT = f"""chat AS (
  SELECT doc_id, codes, {S.strip('text')} AS stext,
         {S.render_chat(S.strip('text'), S.render_codes('codes'))} AS chat
  FROM f2)"""

_VOCAB = f"""ctoks AS (SELECT unnest(regexp_extract_all(chat, '{TOKRE}')) AS token FROM chat),
corpus AS (SELECT token, count(*) AS n FROM ctoks WHERE NOT regexp_matches(token, '{MARKRE}') GROUP BY token),
base AS (
  SELECT token, CAST(id AS BIGINT) AS id
  FROM (VALUES ('<|endoftext|>', 0), ('<unk>', 1), ('<|im_start|>', 2), ('<|im_end|>', 3)) t(token, id)
  UNION ALL SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS BIGINT) FROM corpus),
audio AS (
  SELECT 0 AS ordinal, '<|beginofaudio|>' AS token UNION ALL SELECT 1, '<|endofaudio|>'
  UNION ALL SELECT i + 2, '<|AUDIO' || i::VARCHAR || '|>' FROM range(4096) t(i)),
vocab AS (
  SELECT token, id FROM base
  UNION ALL
  SELECT token, CAST((SELECT max(id) FROM base) + row_number() OVER (ORDER BY ordinal) AS BIGINT)
  FROM audio WHERE token NOT IN (SELECT token FROM base))"""

_VOCAB_CTES = S.with_(S.F2, _CHAT, _VOCAB)


def _lookup_sql(src: str, key: str, toks_expr: str, name: str) -> str:
    """CTE ``name``(key, ids) = vocabulary ids of the tokens, in token order, unknown -> 1."""
    return f"""{name}_t AS (
  SELECT {key} AS k, unnest(t) AS token, unnest(range(len(t))) AS pos
  FROM (SELECT {key}, regexp_extract_all({toks_expr}, '{TOKRE}') AS t FROM {src})),
{name} AS (
  SELECT k AS {key}, list(coalesce(v.id, 1) ORDER BY pos) AS ids
  FROM {name}_t LEFT JOIN vocab v USING (token) GROUP BY k)"""


_CODE_IDS = """codeids AS (
  SELECT doc_id, list(v.id ORDER BY pos) AS cids
  FROM (SELECT doc_id, unnest(codes) AS c, unnest(range(len(codes))) AS pos FROM f2) x
  JOIN vocab v ON v.token = '<|AUDIO' || x.c::VARCHAR || '|>' GROUP BY doc_id)"""

_MARKS = """marks AS (
  SELECT (SELECT id FROM vocab WHERE token = '<|beginofaudio|>') AS boa,
         (SELECT id FROM vocab WHERE token = '<|endofaudio|>') AS eoa)"""

_PRETRAIN = _VOCAB_CTES + ",\n" + _lookup_sql("chat", "doc_id", "stext", "textids") + ",\n" + _CODE_IDS + \
    ",\n" + _MARKS + """,
pre AS (
  SELECT t.doc_id, list_concat(t.ids, [m.boa], coalesce(c.cids, []), [m.eoa]) AS ids, m.boa
  FROM textids t LEFT JOIN codeids c USING (doc_id) CROSS JOIN marks m),
pre2 AS (
  SELECT doc_id, ids, list_transform(ids, lambda x: CASE WHEN x <= boa THEN -100 ELSE x END) AS labels FROM pre)
"""

_SFT = _VOCAB_CTES + ",\n" + _lookup_sql("chat", "doc_id", "chat", "chatids") + ",\n" + _MARKS + """,
sft AS (
  SELECT doc_id, ids,
         list_transform(range(len(ids)),
                        lambda i: CASE WHEN ids[i + 1] < boa AND i < len(ids) - 1 THEN -100 ELSE ids[i + 1] END)
           AS labels
  FROM chatids CROSS JOIN marks)
"""


# ---------------------------------------------------------------- Spark pieces
def _chat_frame(spark, sf_dir):
    u = spread(fx.utterances(spark, sf_dir))
    st = tx.strip_text(F.col("text"))
    return u.select("doc_id", "codes", st.alias("stext"),
                    tx.render_chat(st, tx.render_codes(F.col("codes"))).alias("chat"))


def _vocab(spark, sf_dir, chat=None):
    chat = chat if chat is not None else _chat_frame(spark, sf_dir)
    return write_once(tk.expand_vocab(tk.build_vocab(chat, "chat")), "vocab")


def pretrain_rows(spark, sf_dir):
    chat = _chat_frame(spark, sf_dir)
    v = _vocab(spark, sf_dir, chat)
    audio = tk.audio_id_array(v)
    rows = tk.tokens_to_ids(chat.select("doc_id", "codes", tk.tokenize("stext").alias("toks")), "toks", v, out="text_ids")
    ids = F.concat("text_ids", tk.code_ids("codes", audio))
    return rows.select("doc_id", ids.alias("input_ids")).withColumn("labels", tk.pretrain_labels("input_ids", audio[0]))


def sft_rows(spark, sf_dir):
    chat = _chat_frame(spark, sf_dir)
    v = _vocab(spark, sf_dir, chat)
    boa = tk.audio_id_array(v)[0]
    rows = tk.tokens_to_ids(chat.select("doc_id", tk.tokenize("chat").alias("toks")), "toks", v, out="input_ids")
    return rows.withColumn("labels", tk.sft_labels("input_ids", boa))


# ---------------------------------------------------------------- queries
@query("t1_render_codes", S.with_(S.F2) + f"""
SELECT doc_id, CAST(length(s) AS BIGINT) AS code_len, md5(s) AS code_md5
FROM (SELECT doc_id, {S.render_codes('codes')} AS s FROM f2)""")
def t1_render_codes(spark, sf_dir):
    s = tx.render_codes(F.col("codes"))
    return fx.utterances(spark, sf_dir).select(
        "doc_id", F.length(s).cast("bigint").alias("code_len"), F.md5(s).alias("code_md5"))


@query("t2_codes_to_chars", S.with_(S.F2) + """
SELECT doc_id, CAST(length(s) AS BIGINT) AS n_chars, md5(s) AS chars_md5,
       list_transform(string_split(s, ''), lambda ch: unicode(ch) - 19968) = codes AS roundtrip
FROM (SELECT doc_id, codes, array_to_string(list_transform(codes, lambda c: chr(c + 19968)), '') AS s FROM f2)""")
def t2_codes_to_chars(spark, sf_dir):
    u = fx.utterances(spark, sf_dir)
    s = tx.codes_to_chars(F.col("codes"))
    back = tx.chars_to_codes(s)
    return u.select("doc_id", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("chars_md5"),
                    (back == F.col("codes")).alias("roundtrip"))


@query("t3_render_chat", S.with_(S.F2, _CHAT) + """
SELECT doc_id, CAST(length(chat) AS BIGINT) AS chat_len, md5(chat) AS chat_md5 FROM chat""")
def t3_render_chat(spark, sf_dir):
    c = _chat_frame(spark, sf_dir)
    return c.select("doc_id", F.length("chat").cast("bigint").alias("chat_len"), F.md5("chat").alias("chat_md5"))


@query("t3_render_conversation", f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       md5({S.strip("string_agg(" + S.turn('role', 'text') + ", '' ORDER BY turn)")}) AS chat_md5
FROM conversations GROUP BY conv_id""")
def t3_render_conversation(spark, sf_dir):
    """T3 multi-turn twin: turns of a conversation in order, one chat string per conversation."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                 F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    chat = tx.strip_text(F.array_join(F.transform("_t", lambda t: tx.chat_turn(t["role"], t["text"])), ""))
    return g.select("conv_id", F.col("n_turns").cast("bigint"), F.md5(chat).alias("chat_md5"))


@query("t4_expand_vocab", _VOCAB_CTES + "SELECT token, id FROM vocab")
def t4_expand_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query("t5_token_to_id", _VOCAB_CTES + ",\n" + _lookup_sql("benchmark", "item_id", "text", "bids") + """
SELECT item_id, CAST(len(ids) AS BIGINT) AS n_tokens,
       CAST(len(list_filter(ids, lambda x: x = 1)) AS BIGINT) AS n_unk, md5(array_to_string(ids, ',')) AS ids_md5
FROM bids""")
def t5_token_to_id(spark, sf_dir):
    """Look-up of text the vocabulary was not built from (benchmark items): unknown -> <unk>."""
    v = _vocab(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select("item_id", tk.tokenize("text").alias("toks"))
    r = tk.tokens_to_ids(b, "toks", v)
    return r.select("item_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("ids", lambda x: x == tk.UNK_ID)).cast("bigint").alias("n_unk"),
                    _ids_md5("ids").alias("ids_md5"))


@query("t6_text_to_ids", _VOCAB_CTES + ",\n" + _lookup_sql("chat", "doc_id", "stext", "textids") + """
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM textids""")
def t6_text_to_ids(spark, sf_dir):
    chat = _chat_frame(spark, sf_dir)
    v = _vocab(spark, sf_dir, chat)
    r = tk.tokens_to_ids(chat.select("doc_id", tk.tokenize("stext").alias("toks")), "toks", v)
    return r.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _ids_md5("ids").alias("ids_md5"))


_ROW_OUT = """SELECT doc_id, CAST(len(ids) AS BIGINT) AS length,
       CAST(len(list_filter(labels, lambda x: x = -100)) AS BIGINT) AS n_masked,
       md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(labels, ',')) AS labels_md5 FROM """


def _row_out(df):
    return df.select("doc_id", F.size("input_ids").cast("bigint").alias("length"),
                     F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"),
                     _ids_md5("input_ids").alias("ids_md5"), _ids_md5("labels").alias("labels_md5"))


@query("t7_build_pretrain_row", _PRETRAIN + _ROW_OUT + "pre2")
def t7_build_pretrain_row(spark, sf_dir):
    return _row_out(pretrain_rows(spark, sf_dir))


@query("t8_build_sft_row", _SFT + _ROW_OUT + "sft")
def t8_build_sft_row(spark, sf_dir):
    return _row_out(sft_rows(spark, sf_dir))


@query("t9_length_positions", _SFT + """
SELECT doc_id, CAST(len(ids) AS BIGINT) AS length,
       md5(array_to_string(range(len(ids)), ',')) AS pos_md5 FROM sft""")
def t9_length_positions(spark, sf_dir):
    r = sft_rows(spark, sf_dir)
    return r.select("doc_id", F.size("input_ids").cast("bigint").alias("length"),
                    _ids_md5(tk.positions("input_ids")).alias("pos_md5"))


@query("t10_shift_targets", _SFT + """
SELECT doc_id, CAST(greatest(len(ids) - 1, 0) AS BIGINT) AS n_pairs,
       md5(array_to_string(ids[1:len(ids) - 1], ',')) AS inputs_md5,
       md5(array_to_string(labels[2:len(labels)], ',')) AS targets_md5 FROM sft""")
def t10_shift_targets(spark, sf_dir):
    r = sft_rows(spark, sf_dir)
    i, t = tk.shift_targets("input_ids", "labels")
    return r.select("doc_id", F.size(i).cast("bigint").alias("n_pairs"), _ids_md5(i).alias("inputs_md5"),
                    _ids_md5(t).alias("targets_md5"))
