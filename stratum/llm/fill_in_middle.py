"""Operator 12: fill-in-middle transformation over a Roaring-style set of unit boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches, text_or_empty

#: Offsets per container, as in Roaring bitmaps.
SPAN = 1 << 16
#: Prefix, suffix and middle marker.
MARKERS = ("<P>", "<S>", "<M>")


class _Array:
    """Few offsets: sorted, 16 bits each."""

    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.at[k].astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, at)


class _Runs:
    """Long runs of neighbouring offsets: first offset of each run and the number of offsets before it."""

    def __init__(self, first: np.ndarray, size: np.ndarray):
        self.first = first.astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(size)])

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, side="right") - 1
        return self.first[run] + k - self.before[run]

    def rank(self, at: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.first, at, side="right") - 1
        inside = np.clip(at - self.first[run], 0, self.before[run + 1] - self.before[run])
        return np.where(run < 0, 0, self.before[run] + inside)


class _Bitmap:
    """Everything else: 64-bit words and the number of offsets before each."""

    def __init__(self, mask: np.ndarray):
        packed = np.packbits(mask, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        nth = (k - self.before[word])[:, None]
        return word * 64 + np.argmax(np.cumsum(bits, axis=1) == nth + 1, axis=1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = np.minimum(at >> 6, len(self.words) - 1)
        low = np.where(at >> 6 > word, 64, at & 63).astype(np.uint64)
        below = np.where(low == 64, ~np.uint64(0), (np.uint64(1) << (low % np.uint64(64))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def _container(mask: np.ndarray):
    """The smallest of the three forms for one span of flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    first, size = edges[::2], edges[1::2] - edges[::2]
    cost = {_Array: 2 * int(size.sum()), _Runs: 4 * len(first), _Bitmap: SPAN // 8}  # the first of equal costs
    kind = min(cost, key=cost.get)
    if kind is _Runs:
        return _Runs(first, size)
    return _Array(np.flatnonzero(mask)) if kind is _Array else _Bitmap(mask)


class BoundarySet:
    """Offsets below ``length`` in containers of ``SPAN``, with the cardinality before each container.

    ``select(k)`` is the k-th smallest offset (``length`` when there are only k) and ``rank(at)`` the number of offsets
    below ``at``; a binary search over the cumulative cardinalities finds the container, which does the rest. Both
    take ascending arrays. ``flags(lo, hi)`` gives the flags of one span, so they never exist all at once."""

    def __init__(self, flags: Callable[[int, int], np.ndarray], length: int):
        self.length = length
        self.containers, size = [], [0]
        for lo in range(0, length, SPAN):
            mask = flags(lo, min(lo + SPAN, length))
            self.containers.append(_container(mask))
            size.append(int(np.count_nonzero(mask)))
        self.before = np.cumsum(size)

    def _by_container(self, which: np.ndarray, ask) -> np.ndarray:
        out = np.empty(len(which), np.int64)
        cuts = np.flatnonzero(np.diff(which)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(which)]):
            if hi > lo:
                out[lo:hi] = ask(int(which[lo]), lo, hi)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        which = np.searchsorted(self.before, k, side="right") - 1
        return self._by_container(which, lambda c, lo, hi: c * SPAN + self.containers[c].select(k[lo:hi] - self.before[c])
                                  if c < len(self.containers) else self.length)

    def rank(self, at: np.ndarray) -> np.ndarray:
        which = at >> 16
        return self._by_container(which, lambda c, lo, hi: self.before[c] + self.containers[c].rank(at[lo:hi] - c * SPAN)
                                  if c < len(self.containers) else self.before[-1])


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch, and where each starts (with the end of the last), without copying."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def boundaries(raw: np.ndarray, starts: np.ndarray, unit: str) -> BoundarySet:
    """Where the units of all texts begin. Units cover a text from its first byte: "char" (code points), "word" (a run
    of non-spaces with the spaces after it) or "line" (with its line feed)."""
    first = np.unique(starts[:-1][starts[:-1] < starts[1:]])

    def flags(lo: int, hi: int) -> np.ndarray:
        here = raw[lo:hi]
        if unit == "char":
            return (here & 0xC0) != 0x80
        seen = raw[max(lo - 1, 0):hi]
        blank = (seen == 32) | ((seen >= 9) & (seen <= 13)) if unit == "word" else seen == 10
        out = np.zeros(hi - lo, bool)
        out[1 if lo == 0 else 0:] = blank[:-1] & ~blank[1:] if unit == "word" else blank[:-1]
        out[first[np.searchsorted(first, lo):np.searchsorted(first, hi)] - lo] = True
        return out

    if unit not in ("char", "word", "line"):
        raise ValueError(f"no such unit: {unit}")
    return BoundarySet(flags, len(raw))


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be three texts of which none can begin inside another, so that splitting at them finds exactly those put in."""
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    for a in markers:
        for b in markers:
            if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a))) or a != b and a.startswith(b):
                raise ValueError(f"{b!r} can begin inside {a!r}")


def cut_texts(docs: DataFrame, unit: str = "char", seed: int = 1, plain_from: int = 90, spm_below: int = 20,
              markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n, form, prefix_chars, middle_chars, output.

    A text of n units is cut twice at unit boundaries that depend on the id alone: h1 to h4 are the first four 8-digit groups of
    the hex SHA-256 of ``<seed>:<id>`` (a null id is written as nothing); the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. An empty text (null counts as empty), one that
    holds a marker, or one with h3 % 100 >= ``plain_from`` stays plain, output the text itself, prefix_chars and
    middle_chars null. Others are written suffix first (``spm``) where h4 % 100 < ``spm_below``, else prefix first
    (``psm``). prefix_chars and middle_chars count code points, n units.

    Equal ids and texts give equal rows, repeated rows come out each, an empty table gives an empty one. All texts of an Arrow batch
    (bounded by bytes; a longer text is a batch of its own) share one ``BoundarySet``: ranks of the text's ends give n,
    selects both cut offsets. One map stage, no shuffle."""
    check_markers(markers)
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = _text_bytes(b.column(1))
            units = boundaries(raw, at, unit)
            chars = units if unit == "char" else boundaries(raw, at, "char")
            ends = units.rank(at)
            n = np.diff(ends)
            h1, h2 = (b.column(i).to_numpy() % (n + 1) for i in (2, 3))
            one, two = (units.select(ends[:-1] + k) for k in (np.minimum(h1, h2), np.maximum(h1, h2)))
            whole = chars.rank(at)[:-1]
            prefix = chars.rank(one) - whole
            middle = chars.rank(two) - whole - prefix
            data, out = memoryview(raw), []
            for form, lo, x, y, hi in zip(b.column(4).to_pylist(), at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist()):
                if form == "plain":
                    out.append(bytes(data[lo:hi]))
                elif form == "psm":
                    out.append(b"".join((p, data[lo:x], s, data[y:hi], m, data[x:y])))
                else:
                    out.append(b"".join((s, data[y:hi], p, data[lo:x], m, data[x:y])))
            plain = np.array([f == "plain" for f in b.column(4).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), b.column(4), pa.array(prefix, pa.int64(), mask=plain),
                 pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), digest.alias("_digest"))
    h = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    plain = (F.col("_text") == "") | (h[2] % 100 >= plain_from)
    for x in markers:
        plain = plain | F.contains("_text", F.lit(x))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("_id", "_text", h[0].alias("_h1"), h[1].alias("_h2"), form.alias("form"))
    return rows.mapInArrow(run, f"_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string") \
        .withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``cut_texts`` was given, from its output and form alone."""
    check_markers(markers)
    parts = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", x) for x in markers), -1)  # nothing, then the three in order
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))) \
        .otherwise(F.concat(part(2), part(3), part(1)))
