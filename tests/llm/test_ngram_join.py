import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import ngram_join as N

WS = " \t\n\r\x0b\x0c"


def grams(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WS:
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(x for x in comp[find(i)])) for i, (d, _) in enumerate(rows))


def family(rng, words, size, edits):
    out = [words]
    for _ in range(size - 1):
        w = list(out[rng.randrange(len(out))])
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], [f"e{rng.randrange(99)}"], [w[k], "Z"]])
        out.append(w or ["x"])
    return [" ".join(w) for w in out]


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "one two three", "é É"]
    for _ in range(25):
        texts += family(rng, [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 160))], rng.randrange(1, 7), rng.choice([0, 1, 2, 5]))
    texts += family(rng, [f"w{rng.randrange(400)}" for _ in range(300)], 40, 8)
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("n,num,den,block", [(3, 90, 100, 4000), (5, 4, 5, 7)])
def test_against_brute_force(frame, n, num, den, block):
    rows = corpus(n)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.jaccard_components(frame(rows), n=n, num=num, den=den, group_rows=block).collect())
    assert got == brute(rows, n, num, den)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(1)
    for num, den in ((9, 10), (4, 5)):
        t = N.Threshold(num, den)
        for _ in range(1500):
            size = int(rng.integers(2, 300))
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            drop, new = int(rng.integers(0, size // 5 + 1)), int(rng.integers(0, size // 5 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, new, dtype=np.uint64) * np.uint64(2))))
            both = len(np.intersect1d(a, b))
            if len(b) and t.enough(both, len(a), len(b)) and not np.array_equal(a, b):
                assert set(N.block_keys(a, t)) & set(N.block_keys(b, t))


def test_trees_connect_what_pairs_connect():
    rng = random.Random(9)
    for trial in range(30):
        t, sh = N.Threshold(4, 5), N.Shingler(2)
        texts = list(dict.fromkeys(x for _ in range(4) for x in family(rng, [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))], 6, 4)))
        sets = [sh.ngrams(x) for x in texts]
        links = N._linked(list(range(len(sets))), sets, [0] * len(sets), t)
        up = {i: i for i in range(len(sets))}
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in links:
            assert t.enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
            up[find(a)] = find(b)
        for i in range(len(sets)):
            for j in range(i):
                if t.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                    assert find(i) == find(j)


def test_edges(frame):
    assert N.jaccard_components(frame([])).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (9, None), (5, long), (4, long + " end")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.jaccard_components(frame(rows)).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9), (5, 59996, 4), (4, 59997, 4)], key=str)


@pytest.mark.parametrize("n,num,den,block", [(3, 90, 100, 4000), (5, 4, 5, 7)])
def test_every_link_against_brute_force(frame, n, num, den, block):
    rows = corpus(n) + [(9000, "one two"), (9001, "One  two")]
    sets = {d: grams(t, n) for d, t in rows}

    def linked(a, b):
        both = len(a & b)
        return bool(a and b) and den * both >= num * (len(a) + len(b) - both)

    ids = sorted(sets)
    want = {(x, y) for x in ids for y in ids if x < y and linked(sets[x], sets[y])}
    out = N.jaccard_components(frame(rows), n=n, num=num, den=den, group_rows=block).collect()
    assert {r["doc_id"]: r["n_links"] for r in out} == {d: sum(d in p for p in want) for d in ids}
    assert sum(r["kept"] for r in out) == sum(r["doc_id"] == r["component_id"] for r in out)
    members = {}
    for r in out:
        members.setdefault(r["sig"], []).append(r["doc_id"])
    members.pop(None)
    pairs = N.jaccard_pairs(frame(rows), n=n, num=num, den=den, group_rows=block).collect()
    assert all((r["id_a"], r["rows_a"]) == (min(members[r["sig_a"]]), len(members[r["sig_a"]])) for r in pairs)
    got = [(min(x, y), max(x, y)) for r in pairs for x in members[r["sig_a"]] for y in members[r["sig_b"]]]
    got += [(x, y) for m in members.values() for x in m for y in m if x < y]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("cross", [False, True])
def test_a_group_is_joined_in_little_more_memory_than_its_sets(cross):
    rng = np.random.default_rng(4)
    sets, t = [], N.Threshold(4, 5)
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2))
        sets += [base[rng.random(len(base)) > 0.1 * (k % 3)] for k in range(8)]
    own = [k % 2 if cross else 0 for k in range(len(sets))]
    want = {(i, k) for i in range(len(sets)) for k in range(i // 8 * 8, i)
            if (not cross or own[i] != own[k]) and t.enough(len(np.intersect1d(sets[i], sets[k])), len(sets[i]), len(sets[k]))}
    tracemalloc.start()
    try:
        got = [tuple(sorted(x, reverse=True)) for x in N._linked(list(range(len(sets))), sets, own, t)]
        assert tracemalloc.get_traced_memory()[1] < 2 * sum(g.nbytes for g in sets)
    finally:
        tracemalloc.stop()
    assert len(got) == len(set(got)) and set(got) == want


def test_a_group_is_read_without_copies():
    sets = [np.arange(k, 50, dtype=np.uint64) for k in range(4)]
    rows = [(7, 2, 0), (3, 1, 1), (7, 2, 0), (5, 4, 1)]
    table = pa.table({"cid": [r[0] for r in rows], "rows": [r[1] for r in rows], "_own": [r[2] for r in rows], "grams": pa.array([sets[r[0] % 4].tobytes() for r in rows], pa.binary())})
    for b, side in ((1, [1, 1, 0]), (0, [0, 0, 0])):
        ids, weights, grams, sides = N._group((pa.scalar(1), pa.scalar(0), pa.scalar(b)), table)
        assert (ids.tolist(), weights.tolist(), sides) == ([3, 5, 7], [1, 4, 2], side)
        assert all(np.array_equal(g, sets[i % 4]) and not g.flags.owndata for g, i in zip(grams, ids))


def test_similar_sets_share_a_key_whatever_is_common():
    rng = np.random.default_rng(2)
    t = N.Threshold(4, 5)
    for trial in range(600):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 300)), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, len(a) // 12, dtype=np.uint64) * np.uint64(2))))
        both = len(np.intersect1d(a, b))
        if not t.enough(both, len(a), len(b)) or np.array_equal(a, b):
            continue
        keys, sizes = [N.segment_keys(x, t) for x in (a, b)], np.array([len(a), len(b)])
        every = np.concatenate(keys)
        common = (every >> 7) % 5 * (every % (trial % 3 + 2) == 0) + np.isin(every, np.intersect1d(*keys))  # what both have comes twice at least
        marked = np.split(N.chosen_keys(every, sizes, t, common.astype(np.int8)), [len(keys[0])])
        assert set(keys[0][marked[0]]) & set(keys[1][marked[1]])


def test_common_passages_chain_no_family(frame):
    rng = random.Random(5)
    passages = [[f"p{k}_{i}" for i in range(25)] for k in range(3)]
    rows = [(i, " ".join([f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(50, 90))] + passages[i % 3] + passages[i % 2])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 50, 10)]
    _, _, sets = N._families(frame(rows).select(*N._rows("doc_id", "text")), 5, 4, 5, N.GROUP_ROWS)
    groups = [r["count"] for r in sets.groupBy("grp").count().collect()]
    assert max(groups) < 10 and sum(groups) < 100  # one family of nearly all rows, without counts of the keys
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.jaccard_components(frame(rows)).collect()) == brute(rows, 5, 4, 5)


def test_bitmaps_say_how_common_keys_are(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    times = rng.choice([2, 3, 4, 7, 8, 31, 32, 500], len(keys))
    bitmaps = N._commonness(spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, times)], "key bigint, _n bigint"))
    want = np.searchsorted(N.COMMON, times, "right")
    got = N.how_common(keys, bitmaps)
    assert len(bitmaps) == len(N.COMMON) and (got >= want).all() and (got == want).mean() > 0.99
    assert N.how_common(rng.integers(-(1 << 63), (1 << 63) - 1, 3000), bitmaps).mean() < 0.01
