import hashlib
import random

from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


def check(rows, got):
    want = brute(rows)
    assert len(got) == len(rows)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    kept = {}
    for r in got:
        t = texts[r["sha"]]
        assert (r["keep_id"], r["group_size"]) == want[t]
        kept[t] = kept.get(t, 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == want[t][0]
    assert set(kept.values()) <= {1}


def carried():
    return {"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}


def test_against_brute_force(frame):
    rng = random.Random(1)
    long = "é" * 200_000
    rows = [(i, rng.choice(["a", "b", "", None, "same prefix " * 20 + "x", "same prefix " * 20 + "y", long, long + "!", f"t{i}"]))
            for i in range(300)]
    rows += [rows[5], rows[5], (None, "a"), (None, "only null"), (None, "only null")]
    check(rows, exact_dedup(frame(rows), carry=carried()).collect())


def test_hot_group_goes_through_the_broadcast(frame, monkeypatch):
    monkeypatch.setattr(common, "HOT_FLOOR", 10)
    rows = [(i, "copy" if i % 3 else f"own {i // 2}") for i in range(120)]
    check(rows, exact_dedup(frame(rows), carry=carried()).collect())


def test_empty(frame):
    assert exact_dedup(frame([])).collect() == []
