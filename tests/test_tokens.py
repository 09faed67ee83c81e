import random

import pytest
from pyspark.sql import functions as F

from stratum.functions.batch_udf import make_tokenise_fn
from stratum.operators import common
from stratum.operators import tokens as tk

SCHEMA = "doc_id long, toks array<string>, codes array<int>, meta map<string,string>"


def _corpus(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = [(i, [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(0, 40))] + ["zz"] * (i % 3), [i, 1], {"k": str(i)}) for i in range(n)]
    rows += [(5, ["w1", "never seen", "never seen"], None, None), (None, ["w2"], [1], None), (7, None, [2], None), (8, ["w1", None, "w3"], [], {}), (9, [], None, None)]
    vocab = [(f"w{k}", 4 + k) for k in range(60)]
    return rows, spark.createDataFrame(rows, SCHEMA), dict(vocab), spark.createDataFrame(vocab, "token string, id long")


def _want(rows, ids):
    return sorted(((i, c, m, [ids.get(t, tk.UNK_ID) for t in toks or [] if t is not None]) for i, toks, c, m in rows), key=str)


@pytest.mark.parametrize("limit", [None, 200, 0])
def test_ids_of_every_token_with_whole_head_and_no_dictionary(spark, monkeypatch, limit):
    """The same rows whether all, some or none of the vocabulary is looked up in the row; other columns stay with their row."""
    monkeypatch.setattr(common, "HOT_FLOOR", 20)
    rows, df, ids, vocab = _corpus(spark)
    out = tk.tokens_to_ids(df, "toks", vocab, limit=limit)
    assert out.columns == ["doc_id", "codes", "meta", "ids"]
    got = sorted(((r.doc_id, r.codes, r.meta, list(r.ids)) for r in out.collect()), key=str)
    assert got == _want(rows, ids)


def test_look_up_neither_explodes_nor_joins(spark):
    _, df, _, vocab = _corpus(spark)
    plan = tk.tokens_to_ids(df, "toks", vocab)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Generate", "Join", "Aggregate", "Exchange"))


def test_head_holds_the_commonest_tokens_within_the_limit(spark):
    vocab = spark.createDataFrame([("x" * (k % 9), k) for k in range(5000)], "token string, id long")
    assert tk.head_of_vocab(vocab, 10**9) is None
    for limit in (0, 17, 1000, 50_000):
        cut = tk.head_of_vocab(vocab, limit, steps=512)
        held = vocab.where(F.col("id") < cut).agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
        more = vocab.where(F.col("id") < cut + 20).agg(F.sum(F.octet_length("token") + 16)).first()[0]
        assert held <= limit < more


def test_long_and_empty_inputs(spark):
    vocab = spark.createDataFrame([("a", 4), ("b" * 300_000, 5)], "token string, id long")
    df = spark.createDataFrame([(1, ["a"] * 200_000 + ["b" * 300_000])], "doc_id long, toks array<string>")
    for limit in (None, 30):
        got = tk.tokens_to_ids(df, "toks", vocab, limit=limit).first()
        assert got.ids == [4] * 200_000 + [5]
        assert tk.tokens_to_ids(df.limit(0), "toks", vocab, limit=limit).collect() == []
    empty = spark.createDataFrame([], "token string, id long")
    assert tk.tokens_to_ids(df, "toks", empty).first().ids == [tk.UNK_ID] * 200_001
    assert [r.id for r in tk.expand_vocab(empty).where("token like '%audio%'").orderBy("id").collect()] == [0, 1]


def test_audio_tokens_already_in_the_vocabulary_keep_their_ids(spark):
    vocab = spark.createDataFrame([("a", 0), ("<|AUDIO7|>", 1), ("<|endofaudio|>", 2)], "token string, id long")
    got = tk.expand_vocab(vocab)
    ids = dict((r.token, r.id) for r in got.collect())
    assert got.count() == len(ids) == 4098 + 1 and ids["<|AUDIO7|>"] == 1 and ids["<|beginofaudio|>"] == 3 and ids["<|AUDIO0|>"] == 4
    assert sorted(ids.values()) == list(range(4099))
    assert tk.audio_id_array(got)[:3] == [3, 2, 4]


def test_join_counted_meets_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_FLOOR", 50)
    rows = common.write_once(spark.range(600).selectExpr("if(id < 300, 'hot', if(id % 50 = 0, repeat('x', 5000), concat('k', id % 40))) as k", "id"), "test")
    groups = common.write_once(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")), "test")
    want = sorted((r.k, r.id, r.m) for r in rows.join(groups, "k").collect())
    got = sorted((r.k, r.id, r.m) for r in common.join_counted(rows, groups, "k", "n").collect())
    assert got == want and len(got) == 600


def test_format_function_carries_codes(spark):
    base = spark.createDataFrame([("x", 0), ("y", 1)], "token string, id long")
    vocab = tk.expand_vocab(base)
    docs = spark.createDataFrame([(1, " x y ", [0, 2]), (2, "y", None), (3, "x", [1]), (3, "x", [1])], "doc_id long, text string, codes array<int>")
    got = sorted((r.doc_id, r.input_ids, r.labels, r.length) for r in make_tokenise_fn(vocab, use_chat_template=False)(docs).collect())
    want = [(1, [0, 1, 2, 4, 6, 3]), (2, [1, 2, 3]), (3, [0, 2, 5, 3]), (3, [0, 2, 5, 3])]
    assert got == [(k, ids, [-100 if x <= 2 else x for x in ids], len(ids)) for k, ids in want]


def test_a_worker_makes_no_python_objects_of_the_vocabulary(spark):
    """The table of a worker lies in the broadcast bytes: 300,000 tokens add no Python memory to speak of."""
    import tracemalloc

    import pyarrow as pa

    shared = tk._share(spark.range(300_000).selectExpr("concat('token', id) as token", "id"))
    shared[1].value  # noqa: B018 - loaded before
    tracemalloc.start()
    tokens, ids = tk._table(shared)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20 and len(tokens) == len(ids) == 300_000 and isinstance(tokens, pa.Array)


@pytest.mark.parametrize("limit", [None, 60])
def test_of_rows_with_the_same_token_the_last_one_counts(spark, limit):
    vocab = spark.createDataFrame([("a", 4), ("a", 5), ("b", 6), ("c", 2_000_000)], "token string, id long").coalesce(1)
    df = spark.createDataFrame([(1, ["a", "c", "x"])], "doc_id long, toks array<string>")
    assert tk.tokens_to_ids(df, "toks", vocab, limit=limit).first().ids == [5, 2_000_000, tk.UNK_ID]


def test_rows_written_for_the_join_hold_narrow_ids(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "token string, id long")
    df = spark.createDataFrame([(1, ["a", "c", "b"])], "doc_id long, toks array<string>")
    plan = tk.tokens_to_ids(df, "toks", vocab, limit=20)
    assert dict(plan.dtypes)["ids"] == "array<bigint>" and plan.first().ids == [4, 6, 5]
    assert "ids:array<int>" in plan._jdf.queryExecution().analyzed().toString().replace("`", "") or "array<int>" in plan._jdf.queryExecution().executedPlan().toString()
