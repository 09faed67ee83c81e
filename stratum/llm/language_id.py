"""Operator 7: language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches, text_or_empty

#: Hash slots of n-grams of 1 to 3 characters.
SLOTS = 2048
#: About this many labelled rows are fitted, spread evenly over the languages (all rows of the rarer ones).
SAMPLE_ROWS = 4000
#: Characters looked at in one piece; longer texts add up their pieces, n-grams across a cut aside.
PIECE_CHARS = 1_000_000
#: A text is ambiguous when its two nearest codewords' chances are closer than this.
AMBIGUOUS_MARGIN = 0.2

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def ngram_features(text: str) -> tuple[np.ndarray, int]:
    """(unit vector over the hash slots, number of letters) of a whole text: lower case, runs of other characters
    as one space, square roots of the n-gram counts."""
    counts = np.zeros(SLOTS)
    n_letters = 0
    for at in range(0, len(text), PIECE_CHARS):
        cp = np.frombuffer(text[at:at + PIECE_CHARS].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[cp]
        n_letters += int(letter.sum())
        cp = np.where(letter, cp, 32)
        cp = cp[letter | np.concatenate(([True], letter[:-1]))]
        cp = np.concatenate(([32], cp, [32])).astype(np.uint32)
        h = np.zeros(len(cp), np.uint32)
        for n in range(1, 4):
            if len(cp) < n:
                break
            h = (h[:len(cp) - n + 1] ^ cp[n - 1:]) * np.uint32(2654435761)
            counts += np.bincount((h >> np.uint32(15)) & np.uint32(SLOTS - 1), minlength=SLOTS)
            h = h ^ (h >> np.uint32(13))
    counts = np.sqrt(counts)
    return counts / max(float(np.linalg.norm(counts)), 1e-12), n_letters


def code_matrix(n_classes: int) -> np.ndarray:
    """One codeword of -1 and 1 per class. Up to 7 classes: every split of the classes into two; beyond: random splits
    with a fixed seed, 15 per doubling of the classes, codewords all different."""
    if n_classes < 2:
        return np.ones((n_classes, 0))
    if n_classes <= 7:
        cols = [[1] + [1 if b >> i & 1 else -1 for i in range(n_classes - 1)] for b in range(2 ** (n_classes - 1) - 1)]
        return np.array(cols, float).T
    rng = np.random.default_rng(7)
    while True:
        m = rng.choice([-1.0, 1.0], (n_classes, int(15 * np.log2(n_classes))))
        m = m[:, np.abs(m.sum(0)) < n_classes]
        if len(np.unique(m, axis=0)) == n_classes:
            return m


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[int, float, float]:
        """(nearest codeword, its chance, distance in chance to the next) for one feature vector."""
        if self.code.shape[1] == 0:
            return 0, 1.0, 1.0
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * margin) @ self.trust
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return int(order[0]), float(p[order[0]]), float(p[order[0]] - p[order[1]])


def fit(x: np.ndarray, languages: list[str], rounds: int = 150, decay: float = 1e-4) -> Codebook:
    """One logistic classifier per bit by accelerated gradient descent; a bit's trust is how far it beats a coin on the sample."""
    names = sorted(set(languages))
    code = code_matrix(len(names))
    y = code[[names.index(v) for v in languages]]
    share = np.array([1 / languages.count(v) for v in names])[[names.index(v) for v in languages]]
    share = (share / share.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    w2, b2 = w, b
    step = 4.0
    for k in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ w2 + b2), -30, 30))) * share
        new_w, new_b = w2 - step * (x.T @ slope + decay * w2), b2 - step * slope.sum(0)
        w2, b2 = new_w + k / (k + 3) * (new_w - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new_w, new_b
    right = (((x @ w + b) * y > 0) * share).sum(0)
    trust = np.maximum(2 * right - 1, 0.01)
    return Codebook(names, code, w, b, trust / trust.sum() * max(1, len(trust)))


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Codebook | None:
    """Codebook from labelled rows outside the held-out fold; None without any.

    Rows are chosen by a hash of their id, about ``sample_rows`` / languages per language, so the sample is bounded at
    any table size. Only their sparse features reach the driver."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    rates = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, sample_rows / len(counts) / n))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < F.element_at(rates, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, values = [], []
            for t in b.column(1).to_pylist():
                x, n = ngram_features(t)
                at = np.flatnonzero(x) if n else np.zeros(0, int)
                slots.append(at.astype(np.uint16).tobytes())
                values.append(x[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["lang", "slots", "values"])

    rows = sorted((r["lang"], bytes(r["slots"]), bytes(r["values"])) for r in chosen.mapInArrow(run, "lang string, slots binary, values binary").collect())
    rows = [r for r in rows if r[1]]
    if not rows:
        return None
    x = np.zeros((len(rows), SLOTS), np.float32)
    for i, (_, slots, values) in enumerate(rows):
        x[i, np.frombuffer(slots, np.uint16)] = np.frombuffer(values, np.float32)
    return fit(x, [r[0] for r in rows])


def identify(docs: DataFrame, book: Codebook | None, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None, margin: float = AMBIGUOUS_MARGIN) -> DataFrame:
    """The ``keep`` columns (default: the id) plus lang_pred, score (0 to 1), ambiguous, n_letters.

    Each bit's classifier votes with its logistic loss, weighted by its trust; the codeword with the least loss wins.
    ``und`` with score 0 where the text is null, has no letter or nothing could be learned. ``ambiguous``: the
    chances of the two best codewords differ by less than ``margin``. One map stage over whole texts, no shuffle."""
    small_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    n = len(keep)
    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
                       + ["lang_pred string, score double, ambiguous boolean, n_letters bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(n).to_pylist():
                x, letters = ngram_features(t)
                if not letters or book is None:
                    out.append(("und", 0.0, False, letters))
                else:
                    k, p, gap = book.decide(x)
                    out.append((book.languages[k], p, gap < margin, letters))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_(), pa.int64())))],
                [f"k{i}" for i in range(n)] + ["lang_pred", "score", "ambiguous", "n_letters"])

    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_or_empty(text_col).alias("_t"))
    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                                              "lang_pred", "score", "ambiguous", "n_letters")
