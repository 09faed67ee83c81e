import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.functions import text as tx
from stratum.functions import distance
from stratum.functions.distance import bit_parallel_distance, bounded_distance


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc 한국　", max_size=20), st.text(alphabet="abc 한국　", max_size=20))
def test_bit_parallel_matches_dp(a, b):
    assert bit_parallel_distance(a, b) == _lev(a, b)


def test_long_strings_match_dp():
    rnd = random.Random(7)
    a = "".join(rnd.choice("abcde ") for _ in range(300))
    b = "".join(rnd.choice("abcde ") for _ in range(280))
    assert bit_parallel_distance(a, b) == _lev(a, b)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab한é", max_size=30), st.text(alphabet="ab한é", max_size=30), st.integers(0, 30), st.sampled_from([1, 2, 5, 256]))
def test_every_band_and_bound_matches_dp(a, b, bound, first):
    was, distance.FIRST_BAND = distance.FIRST_BAND, first
    try:
        d = _lev(a, b)
        assert bounded_distance(a, b) == d and bounded_distance(a, b, bound) == (d if d <= bound else None)
    finally:
        distance.FIRST_BAND = was


def test_long_texts_with_rare_characters_match_dp():
    rnd = random.Random(9)
    a = "".join(chr(0x4E00 + int(rnd.paretovariate(0.4)) % 3000) for _ in range(900))
    b = "".join(c for c in a if rnd.random() > 0.05) + "end"
    d = _lev(a, b)
    assert bit_parallel_distance(a, b) == d and bounded_distance(a, b, d) == d and bounded_distance(a, b, d - 1) is None


def test_cost_follows_the_edits_not_the_square_of_the_length(monkeypatch):
    used = []
    real = distance._few_edits

    def counted(a, b, most, steps):
        d, left = real(a, b, most, steps)
        used.append(steps - left)
        return d, left

    monkeypatch.setattr(distance, "_few_edits", counted)
    monkeypatch.setattr(distance, "_band", None)  # not needed for any of these
    rnd = random.Random(3)
    for n in (20_000, 40_000):
        a = "".join(rnd.choice("etaoin shrdlu") for _ in range(n))
        b = "".join(c for i, c in enumerate(a) if i % 50)  # only deletions: about two steps each
        used.clear()
        assert bounded_distance(a, b, n // 10) is not None and sum(used) <= 2 * (n // 50) + 10
    used.clear()
    assert bounded_distance("a" * 50_000, "b" * 50_000, 100) is None and sum(used) < 50_000


def test_pairs_with_many_edits_go_by_bands(monkeypatch):
    seen = []
    real = distance._band
    monkeypatch.setattr(distance, "_band", lambda a, b, k: seen.append(k) or real(a, b, k))
    rnd = random.Random(5)
    a, b = ("".join(rnd.choice("abcd") for _ in range(700)) for _ in range(2))
    d = _lev(a, b)
    assert bounded_distance(a, b) == d and max(seen) < 4 * d
    seen.clear()
    assert bounded_distance(a, b, d) == d and bounded_distance(a, b, d - 1) is None and max(seen) <= d


def test_scores_below_a_threshold_equal_the_exact_ones(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        a = "".join(rnd.choice("ab c한\n") for _ in range(rnd.randrange(0, 60)))
        rows.append((i, a, "".join(c for c in a if rnd.random() > rnd.random() * 0.2) + "z" * rnd.randrange(0, 3)))
    rows += [(900, None, "a"), (901, "a", None), (902, "", ""), (903, "x" * 200, "x" * 190), (904, "x" * 200, "x" * 180 + "y" * 20)]
    df = spark.createDataFrame(rows, "id long, r string, h string")
    for threshold in (0.0, 5.0, 10.0, 33.33, 150.0):
        out = df.select("id", tx.cer_score("r", "h").alias("all"), tx.cer_score_below("r", "h", threshold).alias("low")).collect()
        assert {r.id: r.low for r in out if r.low is not None and r.low < threshold} == \
            {r.id: r["all"] for r in out if r["all"] is not None and r["all"] < threshold}


def test_strip_and_squash_unicode(spark):
    rows = [("　 a b \x1c\n",), ("",), ("x",)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select(tx.strip_text("s").alias("st"), tx.squash_ws("s").alias("sq")).collect()
    assert [r.st for r in out] == [s.strip() for (s,) in rows]
    assert [r.sq for r in out] == ["".join(s.split()) for (s,) in rows]


def test_cer_unicode_and_empty(spark):
    df = spark.createDataFrame([("한국", "한"), ("", "abc"), ("a b c", "abc"), ("abcdefgh", "abcdefg")],
                               "r string, h string")
    got = [r.c for r in df.select(tx.cer_score("r", "h").alias("c")).collect()]
    assert got == [50.0, None, 0.0, 12.5]
    native = [r.c for r in df.select(tx.cer_score("r", "h", native=True).alias("c")).collect()]
    assert native == got


def test_codes_chars_roundtrip(spark):
    df = spark.createDataFrame([([0, 1, 4095],), ([],)], "codes array<int>")
    out = df.select(tx.codes_to_chars("codes").alias("s")).withColumn("back", tx.chars_to_codes("s")).collect()
    assert out[0].s == "".join(chr(c + 0x4E00) for c in [0, 1, 4095])
    assert list(out[0].back) == [0, 1, 4095]
    assert out[1].s == "" and list(out[1].back) == []


def test_render_codes_and_chat(spark):
    df = spark.createDataFrame([("hi", [3, 7])], "t string, codes array<int>")
    r = df.select(tx.render_codes("codes").alias("c"), tx.render_chat(F.col("t"), tx.render_codes("codes"))
                  .alias("chat")).first()
    assert r.c == "<|beginofaudio|><|AUDIO3|><|AUDIO7|><|endofaudio|>"
    assert r.chat.startswith("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n")
    assert r.chat.endswith("<|im_start|>assistant\n" + r.c + "<|im_end|>")


def test_cer_rounds_half_up(spark):
    # 1 deletion in 800 characters: 0.125 -> 0.13 (half up, like DuckDB), not 0.12
    ref = "a" * 799 + "b"
    df = spark.createDataFrame([(ref, "a" * 799)], "r string, h string")
    assert df.select(tx.cer_score("r", "h").alias("c")).first().c == 0.13
