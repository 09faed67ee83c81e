import random

import sentencepiece

from stratum.llm.token_count import PreTokenCounter, count_tokens, model_path

NASTY = [None, "", " ", "  ", "   a", "a ", "a  ", "a  b ", "▁", "▁x", "x▁ y", "a\nb\t c", "<s> </s> <unk> <0x41>", "\x00 \x7f", "ﬁ 　x",
         "日本語 テスト", "🙂🙂 🙂", "é é", " leading", "x" * 5000, ("ab " * 20000), "a" + " " * 40 + "b"]


def test_like_the_library(frame):
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    alphabet = "ab the  ▁\n.é日🙂<>s/"
    texts = NASTY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)]
    got = {r["doc_id"]: r for r in count_tokens(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096), t


def test_memory_of_other_words_is_bounded():
    c = PreTokenCounter(model_path("piece_bpe_32k.model"), remember=5)
    words = [f"zq{i}zq" for i in range(40)]
    assert [c.count(w) for w in words] == [len(c.sp.encode(w)) for w in words]
    assert len(c.known) <= len(c.whole) + 7
    assert "the" in c.whole and all(len(c.sp.encode(w)) == 1 for w in list(c.whole)[:200])


def test_empty_and_repeated(frame):
    assert count_tokens(frame([])).collect() == []
    assert len(count_tokens(frame([(1, "a"), (1, "a"), (None, "a")])).collect()) == 3


def test_batches_like_single_texts():
    import pyarrow as pa

    c = PreTokenCounter(model_path("piece_bpe_32k.model"))
    texts = [t or "" for t in NASTY] * 2 + ["plain words only", "a" * 3000 + " é日🙂"]
    for part in (texts, texts[:1], [""], ["one two three"], []):
        assert c.count_batch(pa.array(part, pa.string())).tolist() == [len(c.sp.encode(t)) for t in part]
    sliced = pa.array(texts, pa.string()).slice(3, 9)
    assert c.count_batch(sliced).tolist() == [len(c.sp.encode(t)) for t in texts[3:12]]
