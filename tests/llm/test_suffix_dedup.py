import random

import numpy as np
import pytest

from stratum.llm import suffix_dedup as S


def brute(rows):
    least = {}
    for i, t in rows:
        data = (t or "").encode()
        i = 1 << 63 if i is None else i
        for k in range(len(data) - 49):
            s = data[k:k + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if least[data[k:k + 50]] < (1 << 63 if i is None else i):
                gone[k:k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "été", "blauer", "x", "\n", "🙂", "aaaa", "lorem", "ipsum", "dolor"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(300)) * (rng.random() < .5) for _ in range(n))
    shared = [text(rng.randrange(8, 40)) for _ in range(6)] + ["a" * 130, "ab" * 90, "z" * 50, "y" * 49]
    rows = []
    for i in range(110):
        parts = [text(rng.randrange(0, 30)) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(4), s[cut:] if rng.random() < .4 else s)
        rows.append((rng.randrange(100_000), rng.choice(["", " "]).join(parts)))
    rows += [(5, rows[3][1]), (200_000, rows[4][1]), (rows[6][0], rows[6][1]), (rows[7][0], rows[8][1]), (None, rows[9][1]), (None, "q" * 70), (None, "q" * 70), (1, None), (2, ""), (3, "short")]
    return rows


def run(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(df).collect()), key=str)


def fix(rows):
    return sorted(((None if i == 1 << 63 else i, *rest) for i, *rest in rows), key=str)


@pytest.mark.parametrize("seed,hot,few", [(1, 10**9, False), (2, 10**9, True), (3, 3, False)])
def test_against_brute_force(frame, monkeypatch, seed, hot, few):
    """The second one has few flags, nearly all of them set, in many buckets; the last one sends every string the hot way."""
    monkeypatch.setattr(S, "HOT_SHARE", 10**9)
    if few:
        monkeypatch.setattr(S, "LEAST_FLAG_BITS", 10)
        monkeypatch.setattr(S, "MOST_FLAG_BITS", 10)
        monkeypatch.setattr(S, "COUNT_BYTES", 500)
    rows = corpus(seed)
    if hot == 3:
        monkeypatch.setattr(S._Plan, "suffixes", _all_hot(S._Plan.suffixes))
    assert run(frame(rows)) == fix(brute(rows))


def _all_hot(plain):
    def suffixes(self, data):
        place, first, last, _ = plain(self, data)
        return place, first, last, place % 2 == place % 2

    return suffixes


def test_pieces_of_long_texts(frame, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    monkeypatch.setattr(S, "PIECE_BYTES", 200)
    a, b = S.chosen_suffixes(text.encode()), (monkeypatch.undo(), S.chosen_suffixes(text.encode()))[1]
    pairs = lambda x: {(p, p - k) for p, f, l in zip(x[0], x[2], x[3]) for k in range(l, f + 1)}  # noqa: E731, E741
    assert {s for _, s in pairs(a)} == {s for _, s in pairs(b)} == set(range(3000 - 49)) and pairs(a) == pairs(b)


def test_sides_of_a_suffix():
    """Equal strings give equal values on the side that they reach, whatever surrounds them."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n)).encode()
    for _ in range(200):
        shared = text(S.LENGTH)
        sides = []
        for data in (text(rng.randrange(80)) + shared + text(rng.randrange(80)), shared, text(3) + shared):
            at = data.index(shared)
            place, h, first, last = S.chosen_suffixes(data)
            k = next(i for i in range(len(place)) if place[i] - first[i] <= at <= place[i] - last[i])
            right, left = S._side_keys(S._values(data, place, h))
            sides.append((int(right[k]) if place[k] - at <= 17 else int(left[k]), int(place[k] - at)))
        assert len(set(sides)) == 1


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 21), dtype=np.uint8)
    order, shared = S.multikey_order(rows)
    got = [bytes(r) for r in rows[order]]
    assert got == sorted(bytes(r) for r in rows)
    assert shared[1:].tolist() == [next((k for k in range(21) if a[k] != b[k]), 21) for a, b in zip(got, got[1:])]


def test_empty(frame):
    assert run(frame([])) == [] and run(frame([(1, "a")])) == [(1, 1, 0, 0, b"a")]
