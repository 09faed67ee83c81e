import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stratum.llm import sentencepiece_codec as codec
from stratum.llm.token_count import MARK, model_path
from tests.llm.test_token_count import NASTY

PATH = model_path("piece_bpe_32k.model")


def test_ids_and_round_trip(frame):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    texts = NASTY + ["".join(rng.choice("ab the  ▁\n.é日🙂<>s/") for _ in range(rng.randrange(80))) for _ in range(400)]
    coded = codec.encode(frame(list(enumerate(texts))), keep=["doc_id", "text"], verify=True)
    rows = codec.decode(coded).withColumn("want", codec.normalised(F.col("text"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]] or "") and r["same_as_library"]
        assert r["decoded"] == r["want"]


def test_long_sequences_decode_in_parts(monkeypatch):
    monkeypatch.setattr(codec, "DECODE_IDS", 10)
    c = codec.Codec(PATH)
    text = "one two  three é🙂 " * 50
    ids = np.frombuffer(c.encode([text])[0][0], np.int32).tolist()
    assert c.decode(ids) == text


def test_other_models_get_whole_texts(monkeypatch):
    c = codec.Codec(PATH, verify=True)
    c.apart = False
    ids, same = c.encode(["a b  c", ""])
    assert same == [True, True] and np.frombuffer(ids[0], np.int32).tolist() == c.sp.encode("a b  c") and ids[1] == b""


def _field(n, value):
    if isinstance(value, int):
        return bytes([n << 3, value])
    return bytes([n << 3 | 2, len(value)]) + value


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, 2), (MARK, -3.0, 1), (MARK + "a", -1.0, 1), ("b", -2.0, 1), ("ab", -9.0, 1)]
    body = b""
    for p, s, kind in pieces:
        body += _field(1, _field(1, p.encode()) + bytes([2 << 3 | 5]) + np.float32(s).tobytes() + _field(3, kind))
    body += _field(2, _field(3, 1)) + _field(3, _field(3, 1) + _field(4, 0) + _field(5, 1))
    m = codec.Model(body)
    assert m.kind == codec.MODEL_UNIGRAM and m.tokenizer().encode("ab", add_special_tokens=False).tokens == [MARK + "a", "b"]


def test_clashing_names_and_empty(frame):
    with pytest.raises(ValueError):
        codec.encode(frame([]), ids_col="doc_id", keep=["doc_id"])
    assert codec.decode(codec.encode(frame([]), keep=["doc_id"])).collect() == []
    twice = codec.encode(frame([(1, "a"), (1, "a"), (None, None)])).collect()
    assert len(twice) == 3 and sorted(map(len, (r["ids"] for r in twice))) == [0, 1, 1]


def test_runs_decode_as_whole_lists():
    """Any ids at all, markers and bytes in any order, decode as the library decodes the whole list."""
    import pyarrow as pa

    c = codec.Codec(PATH, verify=True)
    rng = random.Random(8)
    odd = [i for i, (p, _, kind) in enumerate(c.model.pieces) if kind != 1 or p.strip(MARK) == ""] + [c.sp.piece_to_id(MARK + "the"), c.sp.piece_to_id("e")]
    lists = [[rng.choice(odd) for _ in range(rng.randrange(12))] for _ in range(800)] + [[], c.sp.encode("é🙂 " * 300)]
    got = c.decode_batch(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    assert got == [c.tok.decode(x, skip_special_tokens=False) for x in lists]
    assert c.decode_batch(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_a_word_that_differs_is_reported(monkeypatch):
    import pyarrow as pa

    c = codec.Codec(PATH, verify=True)
    theirs = c.sp.encode
    monkeypatch.setattr(c, "sp", type("Other", (), {"encode": staticmethod(lambda texts: [x + [7] if "zebra" in t else x for t, x in zip(texts, theirs(texts))])}))
    same = c.encode_batch(pa.array(["a zebra"] + [f"w{i}" for i in range(500)], pa.string()))[1].to_pylist()
    assert not same[0] and same.count(False) <= codec.LINE_WORDS and same[-1]
