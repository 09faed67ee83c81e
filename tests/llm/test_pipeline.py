import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from stratum.llm.token_count import PreTokenCounter, model_path
from tests.llm.test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"


def test_registered():
    qs = E.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in qs)] == [] and "pipeline" in qs
    assert 4 <= len(P.STAGES) <= 5


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for k, (name, f) in enumerate(P.STAGES):
        f(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert k + 1 == len(P.STAGES) or out.columns == docs.columns
        kept.append((docs.select("doc_id", "text").collect(), out.collect()))
        docs = out
    before, after = kept[0]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    before, after = kept[1]
    last = {}
    for r in before:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(last.values())
    before, after = kept[2]
    want = brute([(r["doc_id"], r["text"]) for r in before], 5, 4, 5)
    assert sorted(r["doc_id"] for r in after) == [d for d, _, c in want if d == c]
    before, after = kept[3]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == texts[r["doc_id"]] for r in after) and 0.7 * len(before) < len(after) < 1.3 * len(before)
    before, after = kept[4]
    counter = PreTokenCounter(model_path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after) == sorted((r["doc_id"], counter.count(r["text"])) for r in before)


def test_edges(frame, spark, tmp_path):
    rows = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefghij"), 40)), "en", "s") for i in range(30)]
    rows += [(40, None, None, None), (41, "", "en", None), (42, "!!! 123", "de", "s"), (3, rows[3][1], "en", "s"), (50, rows[4][1], "en", "s"), (None, "some words here", "en", "s")]
    full = frame(rows)
    for k, (name, f) in enumerate(P.STAGES[:3]):
        f(spark, full, SMALL).write.parquet(str(tmp_path / name))
        full2 = spark.read.parquet(str(tmp_path / name))
        assert full2.columns == full.columns
        full = full2
    ids = [r["doc_id"] for r in full.collect()]
    assert sorted(ids, key=str) == sorted([*range(4), *range(5, 30), 50, None], key=str)
    empty = frame([])
    for name, f in P.STAGES:
        assert f(spark, empty, SMALL).collect() == []


def test_rates_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = P.mix_to_targets(spark, docs, SMALL)
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    again = P.mix_to_targets(spark, docs, SMALL)
    assert out.groupBy("doc_id").count().exceptAll(again.groupBy("doc_id").count()).count() == 0
    assert out.agg(F.count("*")).first()[0] > 0


def test_near_copies_where_ids_repeat(frame, spark):
    """Rows are dropped by id and text: what only shares an id with a near copy stays, and near copies that share an id don't."""
    def words(k, end=""):
        return " ".join(f"w{k}x{i}" for i in range(60)) + end

    rows = [(1, words(1)), (5, words(1, " z")), (5, words(2)), (7, words(3)), (7, words(3, " z")), (7, words(4)), (8, words(4, " z")),
            (None, words(5)), (None, words(5, " z")), (None, words(1, " y")), (9, words(6)), (9, words(6)), (10, ""), (10, ""), (None, None)]
    out = P.drop_near_copies(spark, frame(rows), SMALL).collect()
    kinds = sorted((str(r["doc_id"]), (r["text"] or "").split("x")[0]) for r in out)
    assert kinds == sorted([("1", "w1"), ("5", "w2"), ("7", "w3"), ("7", "w4"), ("None", "w5"), ("9", "w6"), ("10", ""), ("10", ""), ("None", "")])
