import numpy as np
from pyspark.sql import functions as F

from stratum.llm import mixing as M
from stratum.llm.common import read_columns

SMALL = "/root/testdata/sf0.01"


def test_totals_meet_the_targets(spark):
    docs = read_columns(spark, SMALL, "documents", "doc_id", "text")
    labels = read_columns(spark, SMALL, "labels", "doc_id", "quality", "toxic")
    rows = M.mix(docs, M.label_domains(labels)).collect()
    assert len(rows) == docs.count()
    t = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([r["posterior"] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    assert rate.min() >= 0 and np.allclose(p.sum(1), 1)
    want = np.array([M.TARGETS[d] for d in sorted(M.TARGETS)]) * t.sum()
    assert np.abs((rate * t) @ p - want).sum() < 2e-3 * t.sum()
    assert abs(sum(r["copies"] * r["n_tokens"] for r in rows) / t.sum() - 1) < 0.1
    truth = {r["doc_id"]: r["domain"] for r in M.label_domains(labels).collect()}
    known = [(sorted(M.TARGETS)[int(np.argmax(r["posterior"]))], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert sum(a == b for a, b in known) > 0.9 * len(known)


def test_rates_are_the_least_squares_solution(spark):
    """A target that can't be met with rates of 0 or more: compare with a long plain projected-gradient run."""
    rng = np.random.default_rng(2)
    t, p = rng.integers(1, 50, 60).astype(float), rng.dirichlet([0.4, 0.4, 0.4], 60)
    rows = spark.createDataFrame([(int(n), [float(v) for v in q]) for n, q in zip(t, p)], "n_tokens bigint, posterior array<double>")
    goal = np.array([0.97, 0.02, 0.01]) * t.sum()
    a = t[:, None] * p
    metric = np.linalg.pinv(a.T @ a)
    rates = {tuple(r["posterior"]): r["rate"] for r in M.fit_rates(rows, [0.97, 0.02, 0.01], rounds=60, tolerance=1e-9).collect()}
    got = np.array([rates[tuple(float(v) for v in q)] for q in p])
    r = np.ones(60)
    for _ in range(20000):
        r = np.maximum(0, r - a @ metric @ (a.T @ r - goal))
    value = lambda x: (a.T @ x - goal) @ metric @ (a.T @ x - goal)
    assert got.min() >= 0 and value(got) <= value(r) + 0.01 * value(np.ones(60))


def test_edges(frame, spark):
    labelled = spark.createDataFrame([(1, "high"), (2, "low"), (3, "toxic"), (None, "low"), (9, "other")], "doc_id bigint, domain string")
    rows = [(1, "good text here"), (2, "bad !!! !!!"), (3, "idiot scum"), (4, None), (5, ""), (None, "good"), (1, "good text here"), (6, "word " * 50_000)]
    got = M.mix(frame(rows), labelled).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    assert all(r["rate"] == 1 for r in got if r["n_tokens"] == 0)
    assert M.mix(frame([]), labelled).collect() == []
    none = M.mix(frame(rows), labelled.where("doc_id > 100")).collect()
    assert all(np.allclose(r["posterior"], 1 / 3) for r in none)
    one = M.mix(frame(rows), labelled.where("doc_id = 1")).collect()
    assert all(r["posterior"] == [1.0, 0.0, 0.0] for r in one)
