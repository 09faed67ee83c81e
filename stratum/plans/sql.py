"""DuckDB building blocks for the oracle SQL: the fixtures F1-F8 and a few scalar rules,
written independently of the Spark code so the two can disagree when one is wrong."""

from __future__ import annotations

# Python's str.isspace() set in RE2 terms.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NL = "chr(10)"


def squash(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def cer(ref: str, hyp: str) -> str:
    r, h = squash(ref), squash(hyp)
    return f"round(100.0 * levenshtein({r}, {h}) / nullif(length({r}), 0), 2)"


def render_codes(codes: str) -> str:
    return ("('<|beginofaudio|>' || coalesce(array_to_string(list_transform(" + codes +
            ", lambda c: '<|AUDIO' || c::VARCHAR || '|>'), ''), '') || '<|endofaudio|>')")


def turn(role_sql: str, content_sql: str) -> str:
    return f"('<|im_start|>' || {role_sql} || {NL} || {content_sql} || '<|im_end|>' || {NL})"


def render_chat(text: str, code_str: str) -> str:
    body = " || ".join([
        turn("'system'", "'You are a helpful assistant.'"),
        turn("'user'", f"'Convert the following text to audible speech.' || {NL} || {text}"),
        turn("'assistant'", code_str),
    ])
    return strip(f"({body})")


def md5_int(s: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({s}), 1, {digits}))::BIGINT"


def key(id_sql: str, seed: int = 0, epoch: int = 0) -> str:
    return f"md5('{seed + epoch}:' || ({id_sql})::VARCHAR)"


def bucket(key_sql: str, n_buckets: int) -> str:
    return f"CAST(floor(('0x' || substr({key_sql}, 1, 8))::BIGINT * {float(n_buckets)} / 4294967296.0) AS INTEGER)"


F1 = """f1 AS (
  SELECT doc_id, lang, text,
         CASE doc_id % 3 WHEN 1 THEN replace(text, 'e', '')
                         WHEN 2 THEN regexp_replace(text, '[.,]', '', 'g')
                         ELSE text END AS pred
  FROM documents)"""

F2 = """f2 AS (
  SELECT doc_id, lang, text,
         list_transform(range(1, 2 + n_chars % 64),
                        lambda i: ('0x' || substr(md5(doc_id::VARCHAR || ':' || i::VARCHAR), 1, 3))::INTEGER) AS codes
  FROM documents)"""

F3 = r"""f3 AS (
  SELECT doc_id AS seq_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) AS INTEGER) AS length
  FROM documents)"""

F4 = """f4 AS (
  SELECT layer, code, list(x * CASE WHEN layer = 1 THEN 0.25 ELSE 1.0 END ORDER BY pos) AS centroid
  FROM (SELECT layer, code, pos, avg(x) AS x FROM (
          SELECT 0 AS layer, CAST(vec_id % 16 AS INTEGER) AS code, unnest(range(len(embedding))) AS pos,
                 unnest(embedding)::DOUBLE AS x FROM embeddings
          UNION ALL
          SELECT 1, CAST((vec_id // 16) % 16 AS INTEGER), unnest(range(len(embedding))), unnest(embedding)::DOUBLE
          FROM embeddings)
        GROUP BY ALL)
  GROUP BY layer, code)"""

VECS = """vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"""

F5 = """f5 AS (
  SELECT user_id AS series_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, value
  FROM events)"""

F6 = """f6 AS (
  SELECT user_id % 8 AS worker, event_type AS name, value, CAST(1 + event_id % 5 AS DOUBLE) AS weight
  FROM events)"""

F7 = F2 + """,
f7 AS (
  SELECT lang AS grp, code % 64 AS symbol, count(*) AS n
  FROM (SELECT lang, unnest(codes) AS code FROM f2) GROUP BY ALL)"""

F8 = """f8 AS (
  SELECT CASE WHEN ckpt = 9 THEN 'other_' ELSE 'vocos_' END || ckpt::VARCHAR || '_0.' || (ckpt % 4)::VARCHAR
             || '000.ckpt' AS file,
         name, list(x ORDER BY pos) AS vec
  FROM (SELECT label AS ckpt,
               ['backbone.w', 'head.w', 'feature_extractor.w', 'encoder.w', 'backbone.b'][vec_id % 5 + 1] AS name,
               pos, sum(x::DOUBLE) AS x
        FROM (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
        GROUP BY ALL)
  GROUP BY ALL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
