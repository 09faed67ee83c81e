"""Operator 4: token counts with a whole-token shortcut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches, text_or_empty

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
#: Distinct pre-tokens encoded as one text.
LINE_WORDS = 1000


def model_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; looked up inside the tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> tuple[list[str], bool]:
    """The pre-tokens of a text without their first space, which the library puts back when it encodes them alone;
    and whether a single space is left over at the end, which it can't encode alone."""
    if not text:
        return [], False
    text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" in words:
        words = [m[1:] for m in _RUNS.findall(" " + text)]
        if words[-1] == "":
            return words[:-1], True
    return words, False


def cut_words(texts: pa.Array) -> pa.Array:
    """The pre-tokens of each text as a list, without their first space; "" is a single space left over at the end. An empty
    text has none. Texts without double, leading or trailing spaces are split by Arrow, the others by ``_RUNS``."""
    texts = pc.replace_substring(texts, MARK, " ")
    odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.match_substring(texts, "  ")), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    cut = pc.split_pattern(texts, " ")
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(at):
        return cut
    runs = [[m[1:] for m in _RUNS.findall(" " + t)] if t else [] for t in texts.take(pa.array(at)).to_pylist()]
    order = np.arange(len(cut))
    order[at] = len(cut) + np.arange(len(at))
    return pa.concat_arrays([cut, pa.array(runs, cut.type)]).take(pa.array(order))


def list_ends(lists: pa.Array) -> np.ndarray:
    """Where each list begins and the last one ends among the flattened values."""
    at = lists.offsets.to_numpy()
    return at - at[0]


class PreTokenCounter:
    """Counts the tokens of a text pre-token by pre-token.

    A pre-token is a maximal run of spaces with the non-spaces after it, spaces written as the marker. No piece of
    the vocabulary holds a marker after another character (checked on load), so no merge ever crosses from one
    pre-token into the next, and a text's count is the sum of theirs.

    ``whole`` is proven when the model is loaded: every piece ``<marker>w`` whose ``w`` the library encodes as
    exactly that piece. Other pre-tokens go through the library's merges; their counts are remembered in a table
    of at most ``remember`` entries, emptied when full, which only saves time."""

    def __init__(self, path: str, remember: int = 300_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))
                 for i in range(len(pieces))]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, ok in zip(pieces, plain) if ok):
            raise ValueError("a piece crosses pre-tokens; the pre-token count does not hold for this model")
        if self.sp.encode("a  b ", out_type=str)[0] != MARK + "a" or self.sp.encode(" ", out_type=str) != [MARK * 2]:
            raise ValueError("the model does not mark the start of a text or does not keep spaces as they are")
        if any(self.sp.normalize(t) != MARK + t for t in ("ﬁ", "Ａ", "é")):
            raise ValueError("the model's normaliser changes texts")
        words = [(i, p[1:]) for i, (p, ok) in enumerate(zip(pieces, plain)) if ok and len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        self.whole = {w: 1 for (i, w), ids in zip(words, self.sp.encode([w for _, w in words])) if ids == [i]}
        self.known = dict(self.whole)
        self.remember = remember
        self.last_space = len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        self.leads = np.array([p.startswith(MARK) for p in pieces])
        self.proven = pa.array(list(self.whole), pa.string())

    def _merged(self, words: list[str]) -> np.ndarray:
        """Counts of pre-tokens with one marker each: many of them are one text to the library, told apart by the pieces with the marker."""
        lines = self.sp.encode([" ".join(words[i:i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)])
        ids = np.concatenate([np.array(x, np.int32) for x in lines]) if lines else np.zeros(0, np.int32)
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(words):
            raise ValueError("the ids of a line do not fall into its pre-tokens")
        return np.diff(np.append(starts, len(ids)))

    def count_batch(self, texts: pa.Array) -> np.ndarray:
        """Token counts of a batch of texts. Its distinct pre-tokens are found by Arrow; the proven ones count 1, the rest is merged
        once each, and a text's count is the difference of two running sums. Nothing is remembered from batch to batch."""
        cut = cut_words(texts)
        words = cut.flatten().dictionary_encode()
        counts = np.ones(len(words.dictionary), np.int64)
        rest = np.flatnonzero(~pc.is_in(words.dictionary, value_set=self.proven).to_numpy(zero_copy_only=False))
        named = words.dictionary.take(pa.array(rest)).to_pylist()
        plain = np.array([w != "" and " " not in w for w in named], bool)
        counts[rest[plain]] = self._merged([w for w, ok in zip(named, plain) if ok])
        other = [w for w, ok in zip(named, plain) if not ok]
        counts[rest[~plain]] = [len(x) if w else self.last_space for w, x in zip(other, self.sp.encode(other))]
        ends = np.append(0, np.cumsum(counts[words.indices.to_numpy()]))[list_ends(cut)]
        return np.diff(ends)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > len(self.whole) + self.remember:
            self.known = dict(self.whole)
        self.known.update(zip(words, map(len, self.sp.encode(words))))

    def count(self, text: str) -> int:
        words, tail = pre_tokens(text)
        counts = list(map(self.known.get, words))
        if None in counts:
            known = {w: n for w, n in zip(words, counts) if n is not None}
            new = list({w for w, n in zip(words, counts) if n is None})
            self._learn(new)
            counts = [known[w] if w in known else self.known[w] for w in words]
        return sum(counts) + tail * self.last_space


def count_tokens(docs: DataFrame, path: str | None = None, model: str = "piece_bpe_32k.model", id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` is a model file that every executor can read; by default the public file ``model``. Null counts as empty, an empty
    text has 0 tokens, an empty table gives no rows. Repeated rows are counted each; one map stage, no shuffle. Text goes in
    byte-bounded batches, so long texts stay single rows of their own batch. A model whose normaliser changes texts is refused."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or PreTokenCounter(path or model_path(model))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counter.count_batch(b.column(2)), pa.int64())], ["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_or_empty(text_col)).cast("bigint").alias("n_bytes"),
                       text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {id_type}, n_bytes bigint, n_tokens bigint") \
        .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
