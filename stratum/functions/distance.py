"""Code-point edit distance as an Arrow-batched pandas UDF.

Spark's native ``levenshtein`` is a plain O(n*m) dynamic programme (and its threshold form is slower still on this build). Here
a pair costs what its distance d, or the bound that a filter's threshold sets for the row's length, makes necessary:

* Pairs with few edits go by diagonals (Ukkonen 1985): for each number of edits, how far each diagonal gets, where runs of equal
  characters are crossed by slice compares. Only diagonals that can still reach the end within s edits count, and s grows from the
  length difference, so a pair takes about d * (d - length difference) short steps. A transcript that only lacks characters takes d.
* Others go through the bit-parallel recurrence (Myers 1999, in Hyyrö's banded form of 2003), which advances the cells of a column
  within ``k`` of the diagonal with a handful of machine-word operations on Python integers: O(n * k / 64), ``k`` growing up to the bound.

Both give up a pair beyond its bound as soon as that is certain.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First guess of the band; bands up to here cost about the same.
FIRST_BAND = 256


def _common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # binary search with C-speed slice compares
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _common_suffix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid:] == b[len(b) - mid:]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _few_edits(a: str, b: str, most: int, steps: int) -> tuple[int | None, int]:
    """(distance of ``a`` and ``b``, ``a`` not the shorter, if it is at most ``most``, else None; steps left).

    ``far`` holds, per diagonal (row - column), the furthest row reached with the edits so far. Less than 0 steps left means that it gave up."""
    m, n = len(a), len(b)
    end = m - n
    spare = (most - end) // 2
    lo, hi = -spare, end + spare
    never = -(m + n + 2)
    far = [never] * (hi - lo + 3)
    for e in range(most + 1):
        first, last = max(lo, -e, end - (most - e)), min(hi, e, end + most - e)
        steps -= last - first + 1
        if steps < 0:
            return None, steps
        new = []
        for q in range(first, last + 1):
            x = q - lo + 1
            limit = m if m <= n + q else n + q
            i = max(far[x] + 1, far[x - 1] + 1, far[x + 1]) if e else 0
            if i > limit:
                i = limit
            j = i - q
            if i >= 0:
                while i < limit and a[i:i + 32] == b[j:j + 32]:
                    i += 32
                    j += 32
                while i < limit and a[i:i + 6] == b[j:j + 6]:
                    i += 6
                    j += 6
                while i < limit and a[i] == b[j]:
                    i += 1
                    j += 1
                if i > limit:
                    i = limit
                if q == end and i == m:
                    return e, steps
            new.append(i)
        far[first - lo + 1:last - lo + 2] = new
        if first - lo >= 0:
            far[first - lo] = never
        far[last - lo + 2] = never
    return None, steps


def _band(a: str, b: str, k: int) -> int | None:
    """Distance of ``a`` and ``b`` (``a`` not the shorter) if it is at most ``k``, else None.

    Bit t of the vectors in column j stands for row j - k + t. The score follows the diagonal that ends in the last cell; it never
    falls there, so one above ``k`` settles the pair."""
    m, n = len(a), len(b)
    k = min(k, m)
    if m - n > k:
        return None
    width = 2 * k + 1
    full = (1 << width) - 1
    at: dict[str, list] = {}
    for i, ch in enumerate(a):
        at.setdefault(ch, []).append(i)
    # rows that hold a common character, shifted by k so that column j's window starts at bit j; as bytes, so that a window is cut
    # out without touching the rest. Rare characters stay lists, so all of it takes a few bytes per row whatever the alphabet
    size = (width + 14) // 8
    length = (m + k + n) // 8 + size + 1
    rows = {}
    for ch in set(b):
        if 64 * len(at.get(ch, ())) > m:
            bits = bytearray(length)
            for i in at[ch]:
                bits[(i + k) >> 3] |= 1 << ((i + k) & 7)
            rows[ch] = bytes(bits)
    whole = int.from_bytes

    def rare(ch: str, j: int) -> int:
        held = at.get(ch, ())
        return sum(1 << (i + k - j) for i in held[bisect_left(held, j - k):bisect_left(held, j + k + 1)])

    pv, mv, score, last = full ^ ((1 << k) - 1), 0, m - n, m - n + k
    for j, ch in enumerate(b):
        if ch in rows:
            x = (whole(rows[ch][j >> 3:(j >> 3) + size], "little") >> (j & 7)) & full
        else:
            x = rare(ch, j)
        d0 = (((x & pv) + pv) ^ pv) | x | mv
        ph = (mv | ~(d0 | pv)) & full
        mh = d0 & pv & full
        if not (d0 >> last) & 1:
            score += 1
            if score > k:
                return None
        d0 = (d0 & full) >> 1
        pv = (mh | ~(d0 | ph)) & full
        mv = d0 & ph
    return score


def bounded_distance(a: str, b: str, bound: int | None = None) -> int | None:
    """Levenshtein distance between code-point strings ``a`` and ``b``; None if it is above ``bound``.

    A common prefix and suffix never change the distance, so they are cut first (identical
    strings cost one comparison). The rest goes by diagonals while that takes at most a step per character, then by bands."""
    if a == b:
        return 0 if bound is None or bound >= 0 else None
    p = _common_prefix(a, b)
    a, b = a[p:], b[p:]
    q = _common_suffix(a, b)
    if q:
        a, b = a[:len(a) - q], b[:len(b) - q]
    if len(a) < len(b):
        a, b = b, a
    most = len(a) if bound is None else min(bound, len(a))
    if len(a) - len(b) > most:
        return None
    if not b:
        return len(a)
    steps, spare, end = len(b), 0, len(a) - len(b)
    while steps >= 0:
        s = min(most, end + 2 * spare + 1)
        d, steps = _few_edits(a, b, s, steps)
        if d is not None or steps >= 0 and s == most:
            return d
        spare = max(1, 2 * spare)
    k = min(most, max(FIRST_BAND, 2 * end))
    while (d := _band(a, b, k)) is None:
        if k >= most:
            return None
        k = min(most, 4 * k)
    return d


def bit_parallel_distance(a: str, b: str) -> int:
    """``bounded_distance`` without a bound."""
    return bounded_distance(a, b)


@F.pandas_udf(T.IntegerType())
def _edit_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    out = [None if (r is None or h is None) else bounded_distance(r, h) for r, h in zip(ref, hyp)]
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.IntegerType())
def _distance_within(ref: pd.Series, hyp: pd.Series, bound: pd.Series) -> pd.Series:
    out = [None if (r is None or h is None or k is None or k != k) else bounded_distance(r, h, int(k)) for r, h, k in zip(ref, hyp, bound)]
    return pd.Series(out, dtype="Int32")


# Marked non-deterministic only so Catalyst never copies the (costly) call into a pushed-down
# filter: it then runs exactly once per row, after any repartition placed in front of it.
edit_distance_udf = _edit_distance.asNondeterministic()
#: (ref, hyp, bound) -> the distance, NULL above the bound.
distance_within_udf = _distance_within.asNondeterministic()
