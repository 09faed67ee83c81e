"""Token operators (T4-T10): vocabulary build and expansion, id look-up, pretrain/SFT rows.

The subword tokenizer of the reference is re-aimed as a corpus vocabulary on tables:
tokens are markup tokens ``<|...|>``, runs of non-space characters, or a lone ``<``; ids are
assigned by corpus frequency (then token bytes) after a fixed list of special tokens, and the
audio tokens are appended after every text token (so the label rules hold, see T7/T8).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum import constants as C
from stratum.operators.common import join_counted, small_batches, write_once
from stratum.operators.ordering import global_rank

TOKEN_PATTERN = r"<\|[A-Za-z0-9_]+\|>|[^ \t\n\r\f\x0b<]+|<"
MARKUP_PATTERN = r"^<\|[A-Za-z0-9_]+\|>$"

# fixed values: special tokens placed first, in this order (ids 0..3)
SPECIAL_TOKENS = ("<|endoftext|>", "<unk>", "<|im_start|>", "<|im_end|>")
PAD_ID = 0
UNK_ID = 1

# Up to this many bytes (tokens and ids) of a vocabulary, its commonest tokens first, every worker holds as an Arrow table.
BROADCAST_VOCAB_BYTES = 64 << 20


def tokenize(c) -> Column:
    """Split a string into tokens (array<string>)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), 0)


def audio_token_list() -> list[str]:
    """The audio tokens in order: begin, end, then code 0..4095."""
    return [C.BOA_TOKEN, C.EOA_TOKEN, *[f"{C.CODE_TEMPLATE_PREFIX}{i}{C.CODE_TEMPLATE_SUFFIX}" for i in range(C.CODE_VOCAB_SIZE)]]


def _audio_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the audio tokens that ``vocab`` holds (bounded: 4098)."""
    audio = vocab.sparkSession.createDataFrame([(t,) for t in audio_token_list()], "token string")
    return dict(vocab.select("token", "id").join(F.broadcast(audio), "token", "left_semi").collect())


def build_vocab(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """T6 (vocabulary half): (token, id). Specials get 0..3, corpus tokens follow by count desc,
    token asc. Markup tokens ``<|...|>`` are not corpus tokens (they come from T4 or the specials). Every
    corpus token is in it."""
    toks = texts.select(tokenize(F.col(text_col)).alias("_toks"))
    return build_vocab_from_tokens(toks, "_toks")


def build_vocab_from_tokens(df: DataFrame, tokens_col: str) -> DataFrame:
    """``build_vocab`` over an already tokenized column (array<string>)."""
    spark = df.sparkSession
    toks = df.select(F.explode_outer(tokens_col).alias("token")).where(F.col("token").isNotNull())
    markup = F.startswith("token", F.lit("<|")) & F.col("token").rlike(MARKUP_PATTERN)  # the pattern only where it can match
    counts = (toks.where(~markup)
              .groupBy("token").agg(F.count(F.lit(1)).alias("_n")))
    counts = write_once(counts, "token-counts")  # the corpus is tokenised once; counting and ranking read this
    ranked = global_rank(counts, [F.col("_n").desc(), F.col("token")])
    corpus = ranked.select("token", (F.col("_rank") + len(SPECIAL_TOKENS)).cast("bigint").alias("id"))
    specials = spark.createDataFrame(list(zip(SPECIAL_TOKENS, range(len(SPECIAL_TOKENS)))), "token string, id long")
    return specials.unionByName(corpus)


def expand_vocab(vocab: DataFrame) -> DataFrame:
    """T4: append the audio tokens that are not in ``vocab``, in list order, with ids max(id)+1, max(id)+2, ... The
    audio list is bounded (4098 rows), and so is what the driver learns of the vocabulary."""
    top = vocab.agg(F.max("id")).first()[0]  # one scalar
    held = _audio_ids(vocab)
    missing = [t for t in audio_token_list() if t not in held]
    first = -1 if top is None else top
    added = vocab.sparkSession.createDataFrame([(t, first + 1 + i) for i, t in enumerate(missing)], "token string, id bigint")
    return vocab.unionByName(added)


def audio_id_array(vocab: DataFrame) -> list[int]:
    """Ids of begin, end and code 0..4095 as a Python list (bounded: 4098 values)."""
    held = _audio_ids(vocab)
    if len(held) != C.CODE_VOCAB_SIZE + 2:
        raise ValueError("vocabulary lacks audio tokens; run expand_vocab first")
    return [int(held[t]) for t in audio_token_list()]


_tables: dict = {}


def _table(shared: tuple) -> tuple:
    """(tokens, ids) of a named, broadcast Arrow table, whose bytes they share (the last vocabulary is kept). No Python object is made
    of a token, so a worker holds little more than those bytes."""
    import pyarrow as pa

    name, table = shared
    if name not in _tables:
        t = pa.ipc.open_stream(table.value).read_all()
        _tables.clear()
        _tables[name] = tuple(t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type) for c in ("token", "id"))
    return _tables[name]


def _share(vocab: DataFrame) -> tuple:
    """The vocabulary as a name and a broadcast variable in Arrow's form; its bytes were checked before. The last row comes first, since
    of rows with the same token the last one counts and a look-up takes the first."""
    import numpy as np
    import pyarrow as pa

    table = vocab.select("token", F.col("id").cast("bigint").alias("id")).toArrow()
    table = table.take(pa.array(np.arange(len(table))[::-1])).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return uuid.uuid4().hex, vocab.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def head_of_vocab(vocab: DataFrame, limit: int, steps: int = 4096) -> int | None:
    """None if the vocabulary's bytes are at most ``limit``; else an id below which they are. Ids follow frequency, so those below
    it are the commonest tokens."""
    size = F.octet_length("token") + 16
    total, top = vocab.agg(F.sum(size), F.max("id")).first()
    if (total or 0) <= limit:
        return None
    step = top // steps + 1
    parts = vocab.groupBy(F.floor(F.col("id") / step).cast("bigint").alias("part")).agg(F.sum(size).alias("n")).collect()  # ``steps`` rows
    held, cut = 0, 0
    for r in sorted(parts, key=lambda r: r["part"]):
        held += r["n"]
        if held > limit:
            break
        cut = (r["part"] + 1) * step
    return cut


def _look_up(df: DataFrame, tokens_col: str, shared, out: str, misses: str | None, narrow: bool = False) -> DataFrame:
    """``df`` with the ids of ``tokens_col`` in its place, row by row: the tokens of an Arrow batch are dictionary-encoded, each
    distinct one is looked up once, and the ids go back by the list's own offsets. With ``misses``, also
    the (position, token) pairs that the table lacks; with ``narrow``, ids are ints."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    at = df.columns.index(tokens_col)
    kept = [c for c in df.columns if c != tokens_col]
    fields = [df.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType() if narrow else T.LongType()))]
    small_batches(df.sparkSession)
    if misses:
        fields.append(T.StructField(misses, T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())]))))

    def run(batches):
        tokens, ids = _table(shared)
        for b in batches:
            lists = b.column(at)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            code = lists.flatten().dictionary_encode()
            known = pc.fill_null(ids.take(pc.index_in(code.dictionary.cast(tokens.type), value_set=tokens)), -1).to_numpy()
            flat = known[code.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
            offsets = pa.array(ends, pa.int32())
            cols = [c for i, c in enumerate(b.columns) if i != at]
            cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.where(flat < 0, UNK_ID, flat).astype(np.int32 if narrow else np.int64))))
            if misses:
                lost = np.flatnonzero(flat < 0)
                row = np.searchsorted(ends, lost, side="right") - 1
                pairs = pa.StructArray.from_arrays([pa.array(lost - ends[row], pa.int32()), code.take(pa.array(lost)).dictionary_decode()],
                                                   ["pos", "token"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(lost, ends), pa.int32()), pairs))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def _fill(rows: DataFrame, ids_col: str, found_col: str) -> DataFrame:
    """``rows`` with the (pos, id) pairs of ``found_col`` written over ``ids_col``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    ids_at, found_at = rows.columns.index(ids_col), rows.columns.index(found_col)
    schema = T.StructType([T.StructField(ids_col, T.ArrayType(T.LongType())) if f.name == ids_col else f for f in rows.schema if f.name != found_col])
    small_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            ids, found = b.column(ids_at), b.column(found_at)
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            pairs = found.flatten()
            flat[starts[row] + pairs.field("pos").to_numpy()] = pairs.field("id").to_numpy()
            new = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat))
            cols = [new if i == ids_at else c for i, c in enumerate(b.columns) if i != found_at]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(run, schema)


def tokens_to_ids(df: DataFrame, tokens_col: str, vocab: DataFrame, out: str = "ids", limit: int | None = None) -> DataFrame:
    """T5: ``df`` with ``tokens_col`` replaced by ``out``, the tokens' ids in token order; unknown -> <unk>. All other columns
    stay with their row, so nothing is joined back. Null arrays count as empty, null tokens are left out.

    ``vocab`` (token, id, by falling frequency) is best a written table. Up to ``limit`` bytes (default BROADCAST_VOCAB_BYTES;
    summed first) it becomes an Arrow table that every worker holds, and the look-up is one map stage. Of a larger vocabulary the
    commonest tokens up to the limit are looked up that way, so the tokens that make up most of a corpus never leave their row; the
    rest are counted, resolved once per distinct token and joined to their positions, tokens that are still common (such as a repeated unknown one)
    by broadcast."""
    tokens = df.withColumn(tokens_col, F.array_compact(tokens_col))
    cut = head_of_vocab(vocab, BROADCAST_VOCAB_BYTES if limit is None else limit)
    if cut is None:
        return _look_up(tokens, tokens_col, _share(vocab), out, None)
    narrow = vocab.agg(F.max("id")).first()[0] < 1 << 31  # ids then take half the room in what is written and joined
    looked = _look_up(tokens, tokens_col, _share(vocab.where(F.col("id") < cut)), out, "_miss", narrow)
    rows = write_once(looked.withColumn("_row", F.monotonically_increasing_id()), "token-rows")
    miss = write_once(rows.select("_row", F.explode("_miss").alias("_m")).select("_row", "_m.pos", "_m.token"), "token-misses")
    tail = miss.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).join(vocab.where(F.col("id") >= cut).select("token", "id"), "token")
    ids = join_counted(miss, write_once(tail, "token-tail"), "token", "_n")
    found = ids.groupBy("_row").agg(F.collect_list(F.struct("pos", F.col("id").cast("bigint").alias("id"))).alias("_found"))
    whole = rows.drop("_miss").join(found, "_row", "left").drop("_row")
    return _fill(whole, out, "_found")


def code_ids(codes, audio_ids: list[int]) -> Column:
    """Ids of [begin] ++ codes ++ [end] from the bounded audio id list (no join).

    After T4 the code ids are consecutive, so the id is plain arithmetic; otherwise the 4096
    ids are looked up in an array literal."""
    col = F.col(codes) if isinstance(codes, str) else codes
    base = audio_ids[2]
    if all(v == base + i for i, v in enumerate(audio_ids[2:])):
        body = F.transform(col, lambda c: c.cast("bigint") + F.lit(base))
    else:
        arr = F.array(*[F.lit(i).cast("bigint") for i in audio_ids[2:]])
        body = F.transform(col, lambda c: F.element_at(arr, c + 1))
    return F.concat(F.array(F.lit(audio_ids[0]).cast("bigint")), F.coalesce(body, F.array().cast("array<bigint>")),
                    F.array(F.lit(audio_ids[1]).cast("bigint")))


def pretrain_labels(ids, boa_id: int) -> Column:
    """T7 labels: -100 wherever id <= begin-marker id (the marker itself is masked)."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(col, lambda x: F.when(x <= F.lit(boa_id), F.lit(C.IGNORE_INDEX).cast("bigint")).otherwise(x))


def sft_labels(ids, boa_id: int) -> Column:
    """T8 labels: -100 where id < begin-marker id (marker kept); the last label is always the last id."""
    col = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(col)
    return F.transform(col, lambda x, i: F.when((x < F.lit(boa_id)) & (i < n - 1),
                                                F.lit(C.IGNORE_INDEX).cast("bigint")).otherwise(x))


def positions(ids) -> Column:
    """0..n-1 (empty for n = 0; ``sequence(0, -1)`` would count down)."""
    col = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(col)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shift_targets(ids, labels) -> tuple[Column, Column]:
    """inputs = ids[0..n-2], targets = labels[1..n-1]; rows with n < 2 give empty arrays."""
    i = F.col(ids) if isinstance(ids, str) else ids
    lab = F.col(labels) if isinstance(labels, str) else labels
    m = F.greatest(F.size(i) - 1, F.lit(0))
    return F.slice(i, 1, m), F.slice(lab, 2, m)
