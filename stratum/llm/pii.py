"""Operator 2: personal data by candidate generation and gradient-boosted selection. Native."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import materialise, text_or_empty
from stratum.session import checkpoint_dir

KINDS = ("email", "ip", "card", "phone")

#: Base patterns: leftmost, non-overlapping. Possessive runs and the start condition (not inside a run, or where the last
#: match ended) keep the matches of the plain patterns in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall generators. Their spans overlap the base ones and each other.
LOOSE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{2,4}(?![0-9])"],
    "phone": [r"(?<![0-9+])\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
              r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"],
}
#: A kind is looked for only in texts that match this, which its base and loose patterns all imply.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9]{2}"}
#: Every feature has a small fixed range, so all candidates of any corpus fall into at most their product of cells.
RANGES = {"kind": 4, "digits": 8, "joint": 6, "check": 2, "before": 5, "after": 5, "context": 3}
N_CELLS = 4 * 8 * 6 * 2 * 5 * 5 * 3
CONTEXT_CHARS = 24
_BLOCK = 512


def _runs(text: Column, pattern: str) -> Column:
    """array of (start, end, value, before, after) of the pattern's matches; places in code points, end exclusive.

    Pieces between matches give the places as running sums, taken in blocks so that many matches in one text
    don't cost their square."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def parts(v):
        return F.transform(v["found"], lambda m, i: F.struct(
            F.char_length(F.get(v["pieces"], i)).alias("gap"), F.char_length(m).alias("len"), m.alias("value"),
            F.right(F.get(v["pieces"], i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(v["pieces"], i + 1), F.lit(1)).alias("after")))

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        return F.struct((start + x["len"]).alias("pos"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), (start + x["len"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"))

    def join(acc, b):
        moved = F.transform(b["out"], lambda x: F.struct((x["start"] + acc["pos"]).alias("start"), (x["end"] + acc["pos"]).alias("end"), x["value"], x["before"], x["after"]))
        return F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["out"], moved).alias("out"))

    def placed(p):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(
            F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), empty.alias("out")), join)["out"]

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return _let(both, lambda v: F.when(F.size(v["found"]) > 0, _let(parts(v), placed)).otherwise(empty))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once; a lambda would otherwise work out what it refers to for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern counts."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", _digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _char_class(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z]"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _plain(kind: str, value: Column) -> Column:
    """The value without what sets a disguised one apart from one that the base patterns find: an address with its signs
    written out, a number without its plus. Features are taken of this form, so that they don't tell the label."""
    if kind == "email":
        value = F.regexp_replace(value, r" ?(?:@|\(at\)|\[at\]) ?", "@")
        return F.regexp_replace(value, r" ?(?:\.|\(dot\)|\[dot\]) ?", ".")
    return F.ltrim(value, F.lit("+")) if kind == "phone" else value


def _plausible(kind: str, value: Column) -> Column:
    """Whether a loose span that the base patterns don't confirm may still be one; the others serve as counterexamples."""
    if kind == "email":
        return _plain(kind, value).rlike(r"\.[A-Za-z]{2,}$")
    return value.rlike(r"[0-9][^0-9]") if kind == "phone" else _valid(kind, value)


def _cell(kind: str, x: Column) -> Column:
    """The candidate's features as one number below N_CELLS: format (number of digits, kind of joints, checksum) and
    context (characters beside it, words before it)."""
    v, n = _plain(kind, x["value"]), F.length(_digits(x["value"]))
    digits = F.when(n < 8, 0).when(n < 10, 1).when(n <= 10, 2).when(n <= 11, 3).when(n < 14, 4).when(n <= 15, 5).when(n <= 16, 6).otherwise(7)
    joint = F.when(v.contains(" ") & v.contains("("), 4).when(v.contains("(") | v.contains("["), 5).when(v.contains(" "), 1).when(v.contains("-"), 2) \
        .when(v.contains("."), 3).otherwise(0)
    check = (F.when(n.between(14, 19), F.call_function("luhn_check", _digits(v))).otherwise(F.lit(False)) if kind == "card"
             else _valid("ip", v) if kind == "ip" else n.between(10, 15) if kind == "phone" else v.rlike(r"\.[A-Za-z]{2,}$"))
    context = F.when(x["before"].rlike(r"(?i)(?:mail|tel|phone|call|fax|mobil|contact|card|visa|credit|ip|server|host)[^a-z]*$"), 1) \
        .when(x["before"].rlike(r"(?i)(?:token|key|secret|id|order|ref|version|hash|sha)[^a-z]*$"), 2).otherwise(0)
    code = F.lit(KINDS.index(kind))
    for name, c in (("digits", digits), ("joint", joint), ("check", F.coalesce(check.cast("int"), F.lit(0))),
                    ("before", _char_class(F.right(x["before"], F.lit(1)))), ("after", _char_class(x["after"])), ("context", context)):
        code = code * RANGES[name] + c
    return code.cast("int")


def candidates(text: Column) -> Column:
    """array of (kind, start, end, base, against, cell): the base spans, and every loose span that isn't a base span; ``against``
    marks loose spans that can't be personal data and don't touch a base span of their kind."""
    return F.concat(*[F.when(text.rlike(HINT[kind]), _of_kind(text, k, kind)).otherwise(F.array().cast(_CANDIDATES))
                      for k, kind in enumerate(KINDS)])


_CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,against:boolean,cell:int>>"


def _key(x: Column) -> Column:
    return F.shiftleft(x["start"].cast("bigint"), 32) + x["end"]


def _of_kind(text: Column, k: int, kind: str) -> Column:
    def out(spans, is_base, base=None):
        against = (lambda x: F.lit(False)) if is_base else (lambda x: ~_plausible(kind, x["value"]) & ~F.exists(
            base, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
        return F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                     F.lit(is_base).alias("base"), against(x).alias("against"), _cell(kind, x).alias("cell")))

    def others(spans, base):
        return _let(F.transform(base, _key), lambda keys: F.filter(spans, lambda x: ~F.array_contains(keys, _key(x))))

    return _let(F.filter(_runs(text, BASE[kind]), lambda x: _valid(kind, x["value"])), lambda base: F.concat(
        out(base, True), *[out(others(_runs(text, p), base), False, base) for p in LOOSE[kind]]))


def choose_cells(rows: DataFrame, precision: float = 0.95, rounds: int = 12) -> list[int]:
    """Cells whose loose spans are taken, the most certain first.

    All candidates of the corpus are counted by cell (N_CELLS rows at most), half of the rows for fitting and half for
    calibration. Confirmed are the base spans, counterexamples the implausible loose ones; loose spans that may be either
    have no label and count for nothing. Boosted trees score the cells; a kind's threshold is the lowest score from which on
    the calibration half confirms at least ``precision`` of the labelled candidates. A format (kind, digits, joint, check) that no
    confirmed span of the fitting half has is never taken, and nothing is where that half lacks either label."""
    c = F.col("c")
    counted = rows.select("_fold", F.explode("_cands").alias("c")).groupBy("_fold", c["cell"].alias("cell")) \
        .agg(F.count_if(c["base"]).alias("yes"), F.count_if(c["against"]).alias("no"))
    counted = materialise(counted, "op2-cells")
    left, feats = F.col("cell"), []
    for name in reversed(RANGES):
        if name == "kind":
            feats.append(left.alias(name))
        else:
            feats.append((left % RANGES[name]).alias(name))
            left = F.floor(left / RANGES[name])
    cells = VectorAssembler(inputCols=list(RANGES), outputCol="features") \
        .transform(counted.select("*", *feats))
    per = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").cast("double").alias("weight")),
                            F.struct(F.lit(0.0).alias("label"), F.col("no").cast("double").alias("weight")))).alias("x")
    sample = cells.where("_fold = 0").select("features", per).select("features", "x.label", "x.weight").where("weight > 0")
    if sample.select("label").distinct().count() < 2:
        return []
    model = GBTClassifier(labelCol="label", weightCol="weight", maxDepth=4, maxIter=rounds, seed=11).fit(sample.coalesce(1))
    scored = model.transform(cells).select("_fold", "cell", "kind", "yes", "no", vector_to_array("probability")[1].alias("score")).collect()
    per_format = RANGES["before"] * RANGES["after"] * RANGES["context"]
    formats = {r["cell"] // per_format for r in scored if r["_fold"] == 0 and r["yes"]}
    taken: list[tuple[float, int]] = []
    for kind in range(len(KINDS)):
        own = [r for r in scored if r["kind"] == kind]
        best, yes, total = None, 0, 0
        held = sorted((r for r in own if r["_fold"] == 1), key=lambda r: -r["score"])
        for i, r in enumerate(held):
            yes, total = yes + r["yes"], total + r["yes"] + r["no"]
            last = i + 1 == len(held) or held[i + 1]["score"] < r["score"]
            if last and total and yes >= precision * total:
                best = r["score"]
        if best is not None:
            taken += {(-r["score"], r["cell"]) for r in own if r["score"] >= best and r["score"] > 0.5 and r["cell"] // per_format in formats}
    return [cell for _, cell in sorted(set(taken))]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_email, n_ip, n_card, n_phone, base and spans (arrays of kind, start, end in code
    points, end exclusive, by start and then kind), then ``carry``.

    ``base`` holds what the base patterns and their checks find. ``spans`` adds loose spans whose cell was chosen
    by the boosted trees (``choose_cells``), unless they touch a base span of their kind or a more certain loose one.
    The texts are scanned once, row by row, in the JVM: no shuffle but the cell counts. The narrow candidate
    table is written once. Null texts count as empty; repeated rows and null ids stay rows of their own; an empty table gives no rows;
    equally certain loose spans that touch: the first, of these the longest, stays."""
    checkpoint_dir(docs.sparkSession)
    carry = carry or {}
    fold = (F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 2).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), fold.alias("_fold"), text_or_empty(text_col).alias("_text"), *[v.alias(k) for k, v in carry.items()]) \
        .select("_id", "_fold", candidates(F.col("_text")).alias("_cands"), *carry)
    rows = materialise(rows, "op2-candidates")
    cells = choose_cells(rows, precision)
    chosen = F.expr(f"array({','.join(map(str, cells))})") if cells else F.array().cast("array<int>")
    base = F.filter("_cands", lambda x: x["base"])
    extra = F.filter("_cands", lambda x: ~x["base"] & F.array_contains(chosen, x["cell"]))

    def better(y, x):
        py, px = F.array_position(chosen, y["cell"]), F.array_position(chosen, x["cell"])
        return (py < px) | ((py == px) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["end"] > x["end"]))))

    def free(spans):
        return _let(base, lambda b: F.filter(spans, lambda x: ~F.exists(b, lambda y: _touch(x, y))))

    def alone(spans):
        return F.filter(spans, lambda x: ~F.exists(spans, lambda y: _touch(x, y) & better(y, x)))

    spans = _let(extra, lambda e: _let(free(e), lambda f: F.concat(base, alone(f))))
    return rows.select(F.col("_id").alias(id_col), *[_count(base, k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                       _ordered(base).alias("base"), _ordered(spans).alias("spans"), *carry)


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("bigint")


def _touch(x: Column, y: Column) -> Column:
    return (x["kind"] == y["kind"]) & (x["start"] < y["end"]) & (y["start"] < x["end"])


def _ordered(spans: Column) -> Column:
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(rows, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; what an earlier span covers is not written twice."""
    text = text_or_empty(text)

    def step(acc, x):
        gap = F.substring(text, acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        inside = x["end"] <= acc["pos"]
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out"))

    end = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step)
    return F.concat(end["out"], F.substring(text, end["pos"] + 1, F.char_length(text)))
