import zlib

import numpy as np

from stratum.llm import language_id as L
from stratum.llm.common import read_columns

WORDS = {"en": "the and of with house water thing", "de": "und der nicht zeit schön wasser straße", "fr": "le avec été garçon où château eau"}


def sample(n):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[v].split(), 12)), v) for i in range(n) for v in [list(WORDS)[i % 3]]]


def test_held_out_accuracy_on_the_small_table(spark):
    docs = read_columns(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")
    book = L.train(docs)
    rows = L.identify(docs, book, keep=["doc_id", "lang"]).where(L.held_out("doc_id")).collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_edges(frame):
    rows = sample(300) + [(900, None, "en"), (901, "", "en"), (902, "123 ... 🙂", "de"), (903, "the", None), (None, "und der", "de"), (5, "the", "en"), (5, "the", "en"),
                          (904, "und der nicht " * 100_000, None)]
    docs = frame(rows)
    got = L.identify(docs, L.train(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[904]["lang_pred"] == "de" and by[903]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"] for r in docs.where(L.held_out("doc_id")).collect() if r["doc_id"] is not None}
    assert held == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(by[i]["lang_pred"] == v for i, _, v in sample(300) if i != 5) > 290


def test_nothing_or_one_language_to_learn(frame):
    assert L.train(frame([])) is None
    assert {r["lang_pred"] for r in L.identify(frame([(1, "abc")]), None).collect()} == {"und"}
    one = frame([(i, "abc", "xx") for i in range(20)])
    assert {(r["lang_pred"], r["score"]) for r in L.identify(one, L.train(one)).collect()} == {("xx", 1.0)}
    assert L.identify(frame([]), None).collect() == []


def test_codewords_differ():
    for n in (2, 3, 4, 7, 12, 40):
        m = L.code_matrix(n)
        assert len(np.unique(m, axis=0)) == n and set(np.unique(m)) == {-1.0, 1.0}


def test_a_wrong_bit_is_corrected():
    m = L.code_matrix(5)
    book = L.Codebook(list("abcde"), m, np.eye(m.shape[1]), np.zeros(m.shape[1]), np.ones(m.shape[1]))
    for k in range(5):
        for bit in range(m.shape[1]):
            x = m[k] * 3.0
            x[bit] = -x[bit]
            assert book.decide(x)[0] == k
