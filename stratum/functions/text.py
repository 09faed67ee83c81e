"""Text and token scalar functions (P3, P4, P5, T1, T2, T3) as native column expressions.

All of these stay inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum import constants as C

# Python's str.isspace() set = Java's (?U)\s plus the four separators U+001C..U+001F.
_UNICODE_WS = r"(?U)[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Unicode-aware strip of both ends (``str.strip()``); Spark's ``trim`` only strips spaces.

    The regex only runs when the first or last character is whitespace (a one-character test),
    so whole documents without edge whitespace are never scanned."""
    col = _col(c)
    edge = F.substring(col, 1, 1).rlike(rf"{_UNICODE_WS}") | F.substring(col, -1, 1).rlike(rf"{_UNICODE_WS}")
    return F.when(edge, F.regexp_replace(col, rf"^{_UNICODE_WS}+|{_UNICODE_WS}+$", "")).otherwise(col)


def squash_ws(c) -> Column:
    """Delete every Unicode whitespace character (``re.sub(r"\\s+", "", s)``)."""
    return F.regexp_replace(_col(c), rf"{_UNICODE_WS}+", "")


def cer_score(ref, hyp, native: bool = False) -> Column:
    """P5: round(CER * 100, 2) of whitespace-squashed strings; CER = distance / len(ref).

    Empty reference gives NULL (no score, never kept). Half-up rounding. The distance runs in
    the bit-parallel pandas UDF unless ``native=True`` (JVM ``levenshtein``).
    """
    from stratum.functions.distance import edit_distance_udf

    r, h = squash_ws(ref), squash_ws(hyp)
    d = F.levenshtein(r, h) if native else edit_distance_udf(r, h)
    return F.round(F.try_divide(F.lit(100.0) * d, F.length(r)), 2)


def cer_score_below(ref, hyp, threshold: float) -> Column:
    """P5 fused with the P6 predicate: the exact score for every row that can score below
    ``threshold``, NULL for rows that certainly cannot.

    A score below the threshold needs a distance of at most threshold * length / 100 (one more is allowed, for the rounding),
    and that bound limits the band of the distance. The distance is at least the length difference, so rows whose difference alone
    reaches the threshold get a NULL bound and no distance (Spark evaluates a Python UDF on every row, even inside CASE WHEN)."""
    from stratum.functions.distance import distance_within_udf

    r, h = squash_ws(ref), squash_ws(hyp)
    n = F.length(r)
    least = F.round(F.try_divide(F.lit(100.0) * F.abs(n - F.length(h)), n), 2)
    need = least < F.lit(threshold)
    bound = F.when(need, F.ceil(F.lit(float(threshold)) * n / 100.0).cast("int") + 1)
    d = distance_within_udf(F.when(need, r).otherwise(F.lit("")), F.when(need, h).otherwise(F.lit("")), bound)
    return F.when(need, F.round(F.try_divide(F.lit(100.0) * d, n), 2))


def render_codes(codes) -> Column:
    """Begin marker + ``<|AUDIO{c}|>`` per code + end marker."""
    body = F.array_join(
        F.transform(_col(codes), lambda c: F.concat(F.lit(C.CODE_TEMPLATE_PREFIX), c.cast("string"),
                                                    F.lit(C.CODE_TEMPLATE_SUFFIX))),
        "",
    )
    return F.concat(F.lit(C.BOA_TOKEN), F.coalesce(body, F.lit("")), F.lit(C.EOA_TOKEN))


def codes_to_chars(codes) -> Column:
    """Each code becomes one CJK character at offset U+4E00 (codes < 4096 stay in the BMP)."""
    hexes = F.transform(_col(codes), lambda c: F.lpad(F.hex(c + F.lit(C.UNICODE_OFFSET)), 4, "0"))
    return F.coalesce(F.decode(F.unhex(F.array_join(hexes, "")), "UTF-16BE"), F.lit(""))


def chars_to_codes(s) -> Column:
    """T2 inverse: one code per character."""
    chars = F.filter(F.split(_col(s), ""), lambda ch: F.length(ch) > 0)
    # UTF-16BE bytes of one BMP character, read as a 16-bit number.
    return F.transform(chars, lambda ch: F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int")
                       - F.lit(C.UNICODE_OFFSET))


def chat_turn(role, content) -> Column:
    """One ChatML-style turn: <|im_start|>{role}\\n{content}<|im_end|>\\n."""
    return F.concat(F.lit(C.TURN_START), _col(role) if not isinstance(role, str) else F.lit(role),
                    F.lit("\n"), _col(content), F.lit(C.TURN_END), F.lit("\n"))


def render_chat(text, code_str) -> Column:
    """System + user(instruction + text) + assistant(code string) as one chat string, stripped.

    The string starts with the turn marker and ends with the end marker plus a newline, so the
    strip removes exactly that newline: the last turn is simply not followed by one."""
    return F.concat(
        chat_turn("system", F.lit(C.SYSTEM_PROMPT)),
        chat_turn("user", F.concat(F.lit(C.TTS_INSTRUCTION_PREFIX), _col(text))),
        F.lit(C.TURN_START), F.lit("assistant\n"), _col(code_str), F.lit(C.TURN_END),
    )
