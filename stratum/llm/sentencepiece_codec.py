"""Operator 3: SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import give_back, small_batches, text_or_empty
from stratum.llm.token_count import MARK, cut_words, list_ends, model_path, pre_tokens

# Fixed values of the model file format: field numbers and enumerations of its protobuf messages.
MODEL_PIECES, MODEL_TRAINER, MODEL_NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TRAINER_MODEL_TYPE, TRAINER_BYTE_FALLBACK = 3, 35
NORMALIZER_CHARSMAP, NORMALIZER_PREFIX, NORMALIZER_SQUEEZE, NORMALIZER_ESCAPE = 2, 3, 4, 5
TYPE_NORMAL, TYPE_UNKNOWN, TYPE_USER, TYPE_BYTE = 1, 2, 4, 6
MODEL_UNIGRAM, MODEL_BPE = 1, 2

#: Characters and ids handed to the library at once, so its per-token records stay small for any text length.
GROUP_CHARS = 1_000_000
DECODE_IDS = 100_000
#: Distinct pre-tokens encoded as one text.
LINE_WORDS = 100


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """What a SentencePiece model file says: pieces with scores and types, kind of model, normaliser switches."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in _fields(data):
            if number == MODEL_PIECES:
                f = dict(_fields(value))
                self.pieces.append((f[PIECE_TEXT].decode(), struct.unpack("<f", f.get(PIECE_SCORE, bytes(4)))[0], f.get(PIECE_TYPE, TYPE_NORMAL)))
            elif number == MODEL_TRAINER:
                trainer = dict(_fields(value))
            elif number == MODEL_NORMALIZER:
                norm = dict(_fields(value))
        self.kind = trainer.get(TRAINER_MODEL_TYPE, MODEL_UNIGRAM)
        self.byte_fallback = bool(trainer.get(TRAINER_BYTE_FALLBACK, 0))
        self.charsmap = norm.get(NORMALIZER_CHARSMAP, b"")
        self.prefix = bool(norm.get(NORMALIZER_PREFIX, 1))
        self.squeeze = bool(norm.get(NORMALIZER_SQUEEZE, 1))
        self.escape = bool(norm.get(NORMALIZER_ESCAPE, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == TYPE_UNKNOWN)
        if any(p[2] == TYPE_USER for p in self.pieces):
            raise ValueError("user-defined pieces are not supported")

    def words_apart(self) -> bool:
        """No normal piece holds a marker after another character, so merges stay within marker-led pre-tokens."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind == TYPE_NORMAL)

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if not self.escape or not self.prefix:
            raise ValueError("models without marker or leading marker are not supported")
        if self.kind == MODEL_UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == MODEL_BPE:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self._merges(), unk_token=self.pieces[self.unknown][0],
                              fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        else:
            raise ValueError(f"model type {self.kind} is not supported")
        t = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        t.normalizer = normalizers.Sequence([*steps, normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
        if self.words_apart():
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
        return t

    def _merges(self) -> list[tuple[str, str]]:
        """Every way to make a normal piece from two others; the library joins the pair whose piece scores best."""
        rank = {p: s for p, s, kind in self.pieces if kind == TYPE_NORMAL}
        found = [(-s, i, p[:k], p[k:]) for i, (p, s) in enumerate(rank.items()) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        return [(a, b) for _, _, a, b in sorted(found)]


class Codec:
    """Encoder and decoder of one model file inside a task.

    Where no piece crosses pre-tokens, a text's ids are those of its pre-tokens in a row: the library encodes each
    distinct pre-token of a batch once, multithreaded (``encode_batch``; ``encode`` serves single texts and remembers at most
    ``remember`` pre-tokens). Other models get whole texts. With ``verify``, everything the library encodes is
    encoded by the sentencepiece library too; ``odd`` collects the pre-tokens of what differs."""

    def __init__(self, path: str, verify: bool = False, remember: int = 100_000):
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tok = self.model.tokenizer()
        self.apart = self.model.words_apart() and not self.model.squeeze and not self.model.charsmap
        self.leads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.odd: set[str] = set()
        self.remember = remember
        self.last_space = np.array(self._library_ids(["a "])[0][len(self._library_ids(["a"])[0]):], np.int32).tobytes()
        self.sp = None
        if verify:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            if self.sp.encode("a ")[len(self.sp.encode("a")):] != np.frombuffer(self.last_space, np.int32).tolist():
                raise ValueError("a space at the end is encoded otherwise than by the sentencepiece library")

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= GROUP_CHARS or i + 1 == len(texts):
                out += [e.ids for e in self.tok.encode_batch_fast(texts[at:i + 1], add_special_tokens=False)]
                at, size = i + 1, 0
        return out

    def _learn(self, texts: list[str]) -> list[bytes]:
        out = [np.array(x, np.int32).tobytes() for x in self._library_ids(texts)]
        if self.sp is not None:
            self.unlike.update(t for t, mine, theirs in zip(texts, out, self.sp.encode(texts)) if mine != np.array(theirs, np.int32).tobytes())
        return out

    def _learn_words(self, words: list[str]) -> None:
        """Pre-tokens with one marker each are encoded many at a time and told apart by the piece with the marker."""
        plain = [w for w in words if " " not in w]
        rest = [w for w in words if " " in w]
        lines = [plain[i:i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for line, raw in zip(lines, self._learn([" ".join(x) for x in lines])):
            starts = np.flatnonzero(self.leads[np.frombuffer(raw, np.int32)])
            if len(starts) != len(line):
                raise ValueError("the ids of a line do not fall into its pre-tokens")
            at = [*(starts * 4).tolist(), len(raw)]
            self.known.update(zip(line, [raw[a:b] for a, b in zip(at, at[1:])]))
        self.known.update(zip(rest, self._learn(rest)))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """(int32 ids, same as the sentencepiece library as far as compared) of each text."""
        if not self.apart:
            self.unlike.clear()
            return self._learn(texts), [t not in self.unlike for t in texts]
        cut = [pre_tokens(t) for t in texts]
        if len(self.known) > self.remember:
            self.known = {}
        self.unlike = set()
        self._learn_words(list({w for words, _ in cut for w in words if w not in self.known}))
        ids = [b"".join(map(self.known.__getitem__, words)) + (self.last_space if tail else b"") for words, tail in cut]
        self.odd.update(w for line in self.unlike for w in ([line] if " " in line and not line.strip() else line.split(" ")))
        return ids, [not self.odd or self.odd.isdisjoint(words) for words, _ in cut]

    def _word_ids(self, words: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(list of ids of each distinct pre-token, whether the sentencepiece library differs). Those with one marker are
        encoded many at a time and told apart by the piece with the marker; where a line differs, all its words count as odd."""
        plain = np.array([w != "" and " " not in w for w in words], bool)
        at = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        lines = [" ".join([words[i] for i in at[k:min(k + LINE_WORDS, n)]]) for k in range(0, n, LINE_WORDS)]
        self.unlike = set()
        ids = np.frombuffer(b"".join(self._learn(lines)), np.int32)
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != n:
            raise ValueError("the ids of a line do not fall into its pre-tokens")
        odd = np.zeros(len(words), bool)
        for k, line in enumerate(lines):
            if line in self.unlike:
                odd[at[k * LINE_WORDS:min((k + 1) * LINE_WORDS, n)]] = True
        rest = [words[i] for i in at[n:]]
        spaced = [x if w else self.last_space for w, x in zip(rest, self._learn(rest))]
        odd[at[n:]] = [w in self.unlike for w in rest]
        ends = np.cumsum([len(ids), *(len(x) // 4 for x in spaced)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, ends]), pa.int32()),
                                         pa.array(np.concatenate([ids, np.frombuffer(b"".join(spaced), np.int32)])))
        place = np.empty(len(words), np.int64)
        place[at] = np.arange(len(words))
        return lists.take(pa.array(place)), odd

    def encode_batch(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids of each text, same as the sentencepiece library as far as compared). Arrow finds the batch's distinct pre-tokens, each
        is encoded and compared once, and the ids go back by the lists' places; nothing is remembered from batch to batch."""
        if not self.apart:
            raw, same = self.encode(texts.to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
            flat = pa.array(np.frombuffer(b"".join(raw), np.int32))
        else:
            cut = cut_words(texts)
            words = cut.flatten().dictionary_encode()
            lists, odd = self._word_ids(words.dictionary.to_pylist())
            at, docs = words.indices.to_numpy(), list_ends(cut)
            same = np.diff(np.append(0, np.cumsum(odd[at]))[docs]) == 0
            ends = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())[at]))[docs]
            flat = lists.take(words.indices).flatten()
        if ends[-1] >= 1 << 31:
            raise ValueError("a batch has too many ids")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(same, pa.bool_())

    def decode_batch(self, lists: pa.Array) -> pa.Array:
        """Text of each list of ids. The ids are cut before every piece with a leading marker; byte runs never cross such a cut, so each
        distinct run of the batch is decoded once and the runs' texts are joined by the space that decoding strips off a start."""
        ids, docs = lists.flatten().to_numpy(), list_ends(lists)
        if not self.apart or (len(ids) and (ids.min() < 0 or ids.max() >= len(self.leads))):
            return pa.array([self.decode(x) for x in lists.to_pylist()], pa.string())
        cut = self.leads[ids]
        cut[docs[:-1][np.diff(docs) > 0]] = True
        starts = np.append(np.flatnonzero(cut), len(ids))
        ids = np.ascontiguousarray(ids, np.int32)
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64) * 4), pa.py_buffer(ids)])
        runs = runs.dictionary_encode()
        distinct = [np.frombuffer(x, np.int32).tolist() for x in runs.dictionary.to_pylist()]
        texts = pa.array(self.tok.decode_batch(distinct, skip_special_tokens=False), pa.string()).take(runs.indices)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, docs), pa.int32()), texts), " ")

    def decode(self, ids: list[int]) -> str:
        out, at = [], 0
        while len(ids) - at > DECODE_IDS and self.apart:
            cut = next((i for i in range(at + DECODE_IDS, len(ids)) if self.leads[ids[i]] and not self.leads[ids[i - 1]]), 0)
            if not cut:
                break
            out.append(self.tok.decode(ids[at:cut], skip_special_tokens=False))
            at = cut
        return " ".join([*out, self.tok.decode(ids[at:], skip_special_tokens=False)])


def encode(docs: DataFrame, path: str | None = None, model: str = "piece_bpe_32k.model", text_col: str = "text",
           ids_col: str = "ids", keep: list[str] | None = None, verify: bool = False, decoded_col: str | None = None, batch_mb: int = 8) -> DataFrame:
    """The ``keep`` columns (default: all) plus ``ids_col``, the model's ids of each whole text, no begin or end ids.

    ``path`` is a model file that every executor can read; by default the public file ``model``. Batches go to the
    library's own threads; smaller ones (``batch_mb``) take less memory and more time. Null counts as empty; an empty text has no ids. With ``verify``, same_as_library
    says whether the sentencepiece library gives the same ids; with ``decoded_col``, that column holds the ids decoded
    again by the same worker. Rows stay rows, an empty table gives none, a very long text is a batch of its own; a column named as an
    output must not be kept."""
    small_batches(docs.sparkSession, batch_mb)
    keep = docs.columns if keep is None else keep
    if {ids_col, "same_as_library", decoded_col} & set(keep):
        raise ValueError("an output column has the name of a kept one")
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_or_empty(text_col).alias("_t"))
    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["_ids array<int>"] + ["_same boolean"] * verify + ["_back string"] * bool(decoded_col))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        codec = None
        for b in batches:
            codec = codec or Codec(path or model_path(model), verify)
            lists, same = codec.encode_batch(b.column(n))
            cols, names = [*b.columns[:n], lists], [*(f"k{i}" for i in range(n)), "_ids"]
            if verify:
                cols, names = [*cols, same], [*names, "_same"]
            if decoded_col:
                cols, names = [*cols, codec.decode_batch(lists)], [*names, "_back"]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("_ids").alias(ids_col),
                      *[F.col("_same").alias("same_as_library")] * verify, *([F.col("_back").alias(decoded_col)] if decoded_col else []))


def decode(rows: DataFrame, path: str | None = None, model: str = "piece_bpe_32k.model", ids_col: str = "ids",
           out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) plus ``out_col``, the text of the ids in ``ids_col``. Null ids give an empty text."""
    small_batches(rows.sparkSession)
    keep = rows.columns if keep is None else keep
    if out_col in keep:
        raise ValueError("an output column has the name of a kept one")
    n = len(keep)
    src = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(ids_col, F.array().cast("array<int>")).alias("_ids"))
    schema = ", ".join([f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or Codec(path or model_path(model))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], codec.decode_batch(b.column(n))], [f"k{i}" for i in range(n)] + ["_text"])

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(out_col))


def normalised(text: Column) -> Column:
    """What decoding gives back for a model with the identity normaliser: a literal marker reads as a space."""
    return F.translate(text_or_empty(text), MARK, " ")
