"""Operator 6: removal of repeated 50-byte strings by sorting sampled suffixes in range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import discard, flag_filter, flag_slot, flag_slots, materialise, small_batches, text_or_empty, with_flag

#: Bytes of a repeated string, and of the piece of it by which suffixes are chosen.
LENGTH = 50
LEAD = 16
_LEFT = LENGTH - LEAD
_CONTEXT = _LEFT + LENGTH
#: A string of LENGTH bytes reaches RIGHT bytes from its suffix's place on, or LEFT bytes before it.
RIGHT, LEFT = LENGTH - 17, 18
#: Suffixes are counted by 46 bits of the lead and 8 bits each of what lies to its right and left, in buckets of about
#: COUNT_BYTES of text. Flags say which may repeat: one for every 4 bytes of text, 64 MB at most.
_LEAD_BITS, _SIDE_BITS = 46, 8
_VALUE_BITS = _LEAD_BITS + 2 * _SIDE_BITS
COUNT_BYTES = 32 << 20
LEAST_FLAG_BITS, MOST_FLAG_BITS = 23, 29
#: Longer texts are looked at in pieces that overlap by a string.
PIECE_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20
SAMPLE_DOCS = 2000
#: A lead that comes in over 1 of HOT_SHARE suffixes (and HOT_FLOOR times) is hot: at most HOT_SHARE leads are broadcast.
HOT_SHARE = 100_000
HOT_FLOOR = 50_000
_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[2]
    x = (x ^ (x >> np.uint64(27))) * _C[3]
    return x ^ (x >> np.uint64(31))


def _words(data: bytes, n: int, at: int = 0) -> np.ndarray:
    """The 8 bytes from each of n places on as numbers."""
    return np.ndarray((n,), "<u8", data, at, (1,))


def chosen_suffixes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, lead hash, first, last) of the chosen suffixes of a text.

    Each string of LENGTH bytes chooses the suffix that starts at the least hashed LEAD bytes within it (the leftmost of
    equals), so equal strings choose at the same offset. ``first`` and ``last``: how far before the place
    the strings start that chose it."""
    found = []
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE_BYTES):
        piece = data[at:at + PIECE_BYTES + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        if n <= 0:
            continue
        m = n + _LEFT
        h = _mix((_words(piece, m) * _C[0]) ^ (_mix(_words(piece, m, 8)) * _C[1]))
        key = ((h >> np.uint64(22)) << np.uint64(22)) | np.arange(m, dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= _LEFT + 1:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        rest = _LEFT + 1 - width
        low = np.minimum(low[:n], low[rest:rest + n])
        place = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        spot = place[cut]
        found.append((spot + at, h[spot], spot - cut, spot - (np.append(cut[1:], n) - 1)))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def contexts(data: bytes, place: np.ndarray) -> np.ndarray:
    """The bytes around each place, from _LEFT before to LENGTH after, zeros beyond the text."""
    padded = np.frombuffer(bytes(_LEFT) + data + bytes(LENGTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, _CONTEXT)[place]


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared) of byte rows: their sorted order, and how many leading bytes each shares with the one before.

    Multikey quicksort with 8 bytes as a key: all rows are sorted by their first key, and only rows that tie with others
    go on to the next one, all tied groups at once."""
    n, width = rows.shape
    keys = np.zeros((n, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    keys = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.zeros(n, np.int64)
    for k in range(keys.shape[1]):
        new = np.concatenate(([True], (keys[order[1:], k] != keys[order[:-1], k]) | (group[1:] != group[:-1]))) if n else np.zeros(0, bool)
        group = np.cumsum(new)
        if k + 1 == keys.shape[1]:
            break
        tied = np.flatnonzero(~new | np.append(~new[1:], False)) if n else np.zeros(0, int)
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((keys[order[tied], k + 1], group[tied]))]
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(1), width, same.argmin(1)) if n > 1 else np.zeros(0, np.int64)
    return order, np.concatenate((np.zeros(min(n, 1), np.int64), shared))


def repeated(ctx: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covered, least) by row and offset (0 to _LEFT bytes before the place): whether a smaller id has the same string, and
    whether no row here has it with a smaller id, earlier equal rows of the same id included.

    The suffixes are sorted to the right of the place and, reversed, to its left; a string's class is the run of
    rows that share enough bytes in both orders."""
    n = len(ctx)
    covered, least = np.zeros((n, _LEFT + 1), bool), np.zeros((n, _LEFT + 1), bool)
    if not n:
        return covered, least
    right_order, right = multikey_order(ctx[:, _LEFT:])
    left_order, left = multikey_order(ctx[:, :_LEFT][:, ::-1])
    right_run, left_run = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for back in range(_LEFT + 1):
        rows = np.flatnonzero((last <= back) & (back <= first))
        if not len(rows):
            continue
        right_run[right_order] = np.cumsum(right < LENGTH - back)
        left_run[left_order] = np.cumsum(left < back)
        key = right_run[rows] * (n + 1) + left_run[rows]
        order = np.lexsort((ids[rows], key))
        head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        low = ids[rows[order[head]]][np.cumsum(head) - 1]
        covered[rows[order], back] = low < ids[rows[order]]
        least[rows[order], back] = low == ids[rows[order]]
    return covered, least


def spans_of(covered: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under covered strings, one span for each run of neighbouring offsets."""
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return row, place[row] - high, place[row] - low + LENGTH


def _values(data: bytes, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number by which each chosen suffix is counted: its lead, then what follows the lead, then what precedes it."""
    padded = bytes(24) + data + bytes(RIGHT)
    w = _words(padded, len(padded) - 7)
    at = place + 24
    right = _mix(_mix(w[at + LEAD] * _C[0]) + w[at + RIGHT - 8] * _C[1] + w[at + LEAD + 1] * _C[4])
    left = _mix(_mix(w[at - 8] * _C[3]) + w[at - 16] * _C[0] + w[at - LEFT] * _C[1])
    side = np.uint64(64 - _SIDE_BITS)
    lead = _mix(h * _C[4])  # chosen leads are the least of their neighbours, so their hashes crowd at the low end
    return (((lead >> np.uint64(64 - _LEAD_BITS)) << np.uint64(_SIDE_BITS) | right >> side) << np.uint64(_SIDE_BITS)) | left >> side


def _side_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead and right side, lead and left side) of counted values."""
    low = np.uint64((1 << _SIDE_BITS) - 1)
    return values >> np.uint64(_SIDE_BITS), (values >> np.uint64(2 * _SIDE_BITS)) << np.uint64(_SIDE_BITS) | (values & low)


def _side_slots(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The flags, of 2^bits in a bucket, of both sides of counted values."""
    right, left = _side_keys(values)
    return _mix(right * _C[0]) >> np.uint64(64 - bits), _mix(left * _C[3] ^ _C[4]) >> np.uint64(64 - bits)


def _rows_of(b: pa.RecordBatch, ids: int, digs: int, texts: int) -> Iterator[tuple[int, int, bytes]]:
    """Distinct (id, digest, text) rows of a batch that are long enough to repeat anything."""
    seen = set()
    for i, d, t in zip(b.column(ids).to_pylist(), b.column(digs).to_pylist(), b.column(texts).to_pylist()):
        data = t.encode("utf-8", "replace")
        if len(data) >= LENGTH and (i, d) not in seen:
            seen.add((i, d))
            yield i, d, data


def _suffix_counts(rows: DataFrame, bucket_bits: int) -> DataFrame:
    """(bucket, low, n): for each batch and bucket the sorted distinct values (7 bytes each) and how often they came."""
    shift = np.uint64(_VALUE_BITS - bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_values(data, *chosen_suffixes(data)[:2]) for _, _, data in _rows_of(b, 0, 1, 2)]
            values, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            n = np.minimum(n, 65535).astype(np.uint16)
            bucket = (values >> shift).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            part = [(int(bucket[i]), values[i:j], n[i:j]) for i, j in zip(cut, [*cut[1:], len(bucket)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in part], pa.int32()),
                 pa.array([v.view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for _, v, _ in part], pa.binary()),
                 pa.array([c.tobytes() for _, _, c in part], pa.binary())], ["bucket", "low", "n"])

    return rows.mapInArrow(run, "bucket int, low binary, n binary")


def _run_totals(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of some sorted keys the sum of ``n`` over its equals."""
    head = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.add.reduceat(n, np.flatnonzero(head))[np.cumsum(head) - 1]


def _repeating(bucket_bits: int, flag_bits: int):
    """For ``applyInArrow``: one bucket's flags of sides that came more than once, and the hottest leads with their counts."""
    shift = np.uint64(_VALUE_BITS - bucket_bits)

    def run(key, table):
        bucket = key[0].as_py()
        low = [np.frombuffer(x, np.uint8).reshape(-1, 7) for x in table.column("low").to_pylist()]
        values = np.zeros((sum(map(len, low)), 8), np.uint8)
        values[:, :7] = np.concatenate(low)
        values = (values.view(np.uint64).ravel() & ((np.uint64(1) << shift) - np.uint64(1))) | (np.uint64(bucket) << shift)
        n = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, n = values[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        values, n = values[head], np.add.reduceat(n, head)
        right, left = _side_keys(values)
        again_right = _run_totals(right, n) > 1
        order = np.argsort(left, kind="stable")
        again_left = np.zeros(len(values), bool)
        again_left[order] = _run_totals(left[order], n[order]) > 1
        flags = np.zeros(1 << flag_bits, np.uint8)
        for slots, again in zip(_side_slots(values, flag_bits), (again_right, again_left)):
            flags[slots[again]] = 1
        lead = values >> np.uint64(2 * _SIDE_BITS)
        total = _run_totals(lead, n)
        hot = (total >= max(HOT_FLOOR, int(n.sum()) // HOT_SHARE)) & np.concatenate(([True], lead[1:] != lead[:-1]))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary()),
                         "hot": pa.array([lead[hot].tobytes()], pa.binary()), "hot_n": pa.array([total[hot].tobytes()], pa.binary()),
                         "often": pa.array([int(n[again_right | again_left].sum())], pa.int64()), "all": pa.array([int(n.sum())], pa.int64())})

    return run


class _Plan:
    """What the tasks know: flags of repeating suffixes, the few hot leads, and the splitters of the buckets."""

    def __init__(self, flags: np.ndarray, hot: np.ndarray, bucket_bits: int, flag_bits: int):
        self.flags, self.hot, self.bucket_bits, self.flag_bits = flags, hot, bucket_bits, flag_bits
        self.splitters = np.zeros(0, f"S{LEAD}")

    def suffixes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, first, last, is hot) of the chosen suffixes that may repeat on either side."""
        place, h, first, last = chosen_suffixes(data)
        values = _values(data, place, h)
        bucket = (values >> np.uint64(_VALUE_BITS - self.bucket_bits)) << np.uint64(self.flag_bits)
        keep = np.zeros(len(values), bool)
        for slot in _side_slots(values, self.flag_bits):
            slot |= bucket
            keep |= (self.flags[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return place[keep], first[keep], last[keep], np.isin((values >> np.uint64(2 * _SIDE_BITS))[keep], self.hot)


def _leads(ctx: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ctx[:, _LEFT:_LEFT + LEAD]).view(f"S{LEAD}").ravel()


def _strings(ctx: np.ndarray, back: int) -> np.ndarray:
    """Two 64-bit hashes of the string that starts ``back`` bytes before the place."""
    s = np.zeros((len(ctx), 56), np.uint8)
    s[:, :LENGTH] = ctx[:, _LEFT - back:_LEFT - back + LENGTH]
    w = s.view("<u8")
    a, b = np.full(len(ctx), _C[0]), np.full(len(ctx), _C[1])
    for k in range(w.shape[1]):
        a, b = _mix((a ^ w[:, k]) * _C[4] + _C[k % 3]), _mix((b + w[:, k]) * _C[1] ^ _C[3])
    return np.stack((a, b), 1)


_SENT = "bucket int, kind int, ids binary, digs binary, place binary, first binary, last binary, data binary"


def _send(rows: DataFrame, plan, n_buckets: int) -> DataFrame:
    """What each batch can't settle alone, packed and compressed by bucket: kind 0 settled spans, kind 1 contexts by range of their
    lead, kind 2 strings around hot leads by hash.

    Strings that a smaller id of the batch has are covered at once. A suffix goes on only where it has the batch's
    least id for some string, so a passage in any share of the documents is sent once per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = plan.value
        for b in batches:
            parts = []
            for i, d, data in _rows_of(b, 0, 1, 2):
                place, first, last, hot = know.suffixes(data)
                if len(place):
                    parts.append((np.full(len(place), i), np.full(len(place), d), place, first, last, hot, contexts(data, place)))
            if not parts:
                continue
            ids, digs, place, first, last, hot, ctx = (np.concatenate(x) for x in zip(*parts))
            covered, least = repeated(ctx, ids, first, last)
            out: list[tuple] = []
            pack = zstandard.ZstdCompressor(level=3).compress

            def put(bucket, kind, rows, *cols):
                if (np.diff(bucket) < 0).any():
                    order = np.argsort(bucket, kind="stable")
                    bucket, rows, cols = bucket[order], rows[order], [c[order] for c in cols]
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
                for x, y in zip(cut, [*cut[1:], len(bucket)]):
                    out.append((int(bucket[x]), kind, *[pack(np.ascontiguousarray(c).tobytes()) for c in (
                        ids[rows[x:y]].astype(np.int64), digs[rows[x:y]].astype(np.int32), *[c[x:y] for c in cols])]))

            row, start, end = spans_of(covered, place)
            put((digs[row] % n_buckets).astype(np.int64), 0, row, start.astype(np.int32), end.astype(np.int32), np.zeros((len(row), 0), np.uint8), np.zeros((len(row), 0), np.uint8))
            cold = np.flatnonzero(~hot & least.any(1))
            leads = _leads(ctx[cold])
            order = np.argsort(leads, kind="stable")
            leads, cold = leads[order], cold[order]
            at = np.arange(_CONTEXT)  # bytes that none of a suffix's strings reaches are blanked
            used = (at >= _LEFT - first[cold, None]) & (at < _LEFT + LENGTH - last[cold, None])
            put(np.searchsorted(know.splitters, leads, "right"), 1, cold, place[cold].astype(np.int32),
                first[cold].astype(np.uint8), last[cold].astype(np.uint8), ctx[cold] * used)
            if hot.any():
                by = [np.flatnonzero(hot & least[:, back]) for back in range(_LEFT + 1)]
                rows = np.concatenate(by)
                h = np.concatenate([_strings(ctx[x], back) for back, x in enumerate(by)])
                begin = place[rows] - np.repeat(np.arange(_LEFT + 1), [len(x) for x in by])
                put((h[:, 0] % np.uint64(n_buckets)).astype(np.int64), 2, rows, begin.astype(np.int32),
                    np.zeros((len(rows), 0), np.uint8), np.zeros((len(rows), 0), np.uint8), h)
            cols = list(zip(*out)) if out else [()] * 8
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in _SENT.split(", ")])

    return rows.mapInArrow(run, _SENT)


def _settle(key, table):
    """(id, dig, start, end) of one bucket: its suffixes sorted and compared, its hot strings compared by hash."""
    kinds = np.array(table.column("kind").to_pylist(), np.int64)
    cols = {n: table.column(n).to_pylist() for n in ("ids", "digs", "place", "first", "last", "data")}

    unpack = zstandard.ZstdDecompressor().decompress

    def of(kind: int, name: str, dtype, width: int = 1) -> np.ndarray:
        x = np.frombuffer(b"".join(unpack(cols[name][k]) for k in np.flatnonzero(kinds == kind)), dtype)
        return x.reshape(-1, width) if width > 1 else x

    ids = [of(k, "ids", np.int64) for k in range(3)]
    digs = [of(k, "digs", np.int32) for k in range(3)]
    place = of(1, "place", np.int32).astype(np.int64)
    covered, _ = repeated(of(1, "data", np.uint8, _CONTEXT), ids[1], of(1, "first", np.uint8), of(1, "last", np.uint8))
    row, start, end = spans_of(covered, place)
    h, begin = of(2, "data", np.uint64, 2), of(2, "place", np.int32).astype(np.int64)
    order = np.lexsort((ids[2], h[:, 1], h[:, 0]))
    head = np.concatenate(([True], (h[order[1:]] != h[order[:-1]]).any(1))) if len(order) else np.zeros(0, bool)
    low = ids[2][order[head]][np.cumsum(head) - 1] if len(order) else np.zeros(0, np.int64)
    hit = order[low < ids[2][order]]
    return pa.table({"id": np.concatenate((ids[0], ids[1][row], ids[2][hit])), "dig": np.concatenate((digs[0], digs[1][row], digs[2][hit])),
                     "start": np.concatenate((of(0, "place", np.int32), start, begin[hit])).astype(np.int32),
                     "end": np.concatenate((of(0, "first", np.int32), end, begin[hit] + LENGTH)).astype(np.int32)})


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(id, dig, start, end), perhaps overlapping, of the (id, dig, text) rows: what strings of smaller ids cover."""
    spark = rows.sparkSession
    small_batches(spark, 4)
    n_docs, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    bucket_bits = max(6, (size // COUNT_BYTES).bit_length())
    flag_bits = max(3, min(MOST_FLAG_BITS, max(LEAST_FLAG_BITS, (size // 4).bit_length())) - bucket_bits)
    counted = _suffix_counts(rows, bucket_bits).groupBy("bucket").applyInArrow(
        _repeating(bucket_bits, flag_bits), "bucket int, flags binary, hot binary, hot_n binary, often bigint, all bigint").collect()
    flags = np.zeros((1 << bucket_bits, (1 << flag_bits) // 8), np.uint8)
    for r in counted:
        flags[r["bucket"]] = np.frombuffer(bytes(r["flags"]), np.uint8)
    often, total = sum(r["often"] for r in counted), sum(r["all"] for r in counted)
    hot = [np.frombuffer(bytes(r["hot"]), np.uint64)[np.frombuffer(bytes(r["hot_n"]), np.int64) >= max(HOT_FLOOR, total // HOT_SHARE)] for r in counted]
    plan = _Plan(flags.ravel(), np.concatenate([*hot, np.zeros(0, np.uint64)]), bucket_bits, flag_bits)
    n_buckets = max(16, -(-often * (_CONTEXT + 24) // BUCKET_BYTES))
    rough = spark.sparkContext.broadcast(plan)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leads = [_leads(contexts(data, rough.value.suffixes(data)[0][::8])).tobytes() for _, _, data in _rows_of(b, 0, 1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.binary())], ["leads"])

    part = rows.where(F.pmod(F.xxhash64(F.lit("splitters"), "dig"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(n_docs, 1)) * (1 << 30)) + 1)
    leads = np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in part.mapInArrow(sample, "leads binary").collect()), f"S{LEAD}"))
    plan.splitters = np.unique(leads[np.arange(1, n_buckets) * len(leads) // n_buckets]) if len(leads) else leads
    return _send(rows, spark.sparkContext.broadcast(plan), n_buckets).groupBy("bucket").applyInArrow(_settle, "id bigint, dig int, start int, end int")


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _digest(text: Column) -> Column:
    """31 bits of a hash that tell apart rows of one id."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``copy``: true only where a row with a smaller id has the same text of LENGTH bytes or more.

    The least id of every such text is found on a narrow table. One bitmap holds the texts that come more than once, another
    (text, least id) of every text that the first one flags; a row in the first and not in the second is a copy. False hits
    leave a copy unmarked, which only costs work."""
    h = F.xxhash64("text")
    firsts = materialise(rows.where(F.octet_length("text") >= LENGTH).groupBy(F.unhex(F.sha2("text", 256)).alias("key"))
                         .agg(F.first(h).alias("h"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "op6-texts")
    slots = flag_slots(2 * firsts.where("n > 1").count())
    again = materialise(flag_filter(firsts.where("n > 1"), flag_slot(F.col("h"), slots=slots)), "op6-again")
    least = materialise(flag_filter(with_flag(firsts, again, flag_slot(F.col("h"), slots=slots), "_dup").where("_dup"),
                                    flag_slot(F.col("h"), F.col("least"), slots=slots)), "op6-least")
    discard(firsts)
    marked = with_flag(with_flag(rows, again, flag_slot(h, slots=slots), "_dup"), least, flag_slot(h, F.col("id"), slots=slots), "_first")
    return marked.withColumn("copy", F.col("_dup") & ~F.col("_first") & (F.octet_length("text") >= LENGTH)).drop("_dup", "_first")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` (a whole number), n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes when a string of 50 bytes over it also starts in a document with a smaller id; all strings are judged on the
    input and none crosses documents.
    0. Whole copies of a text with a smaller id lose every byte and repeat nothing that the least id doesn't: they are
       marked by two bitmaps (``_with_copies``) and take no further part.
    1. Every string chooses one suffix by its content (``chosen_suffixes``), about one per 18 bytes. Two that belong to equal
       strings agree in the 33 bytes from the lead on or in the lead and 18 bytes before it. Both are counted; suffixes
       of which neither comes again can't repeat.
    2. The other suffixes carry the bytes that their strings can reach. Each batch settles what it can by
       itself; the rest is range-partitioned by leading bytes at sampled splitters. A lead never
       straddles a boundary, so nothing must be compared across buckets but the leads beyond ``HOT_SHARE``, whose strings are
       dealt by hash instead, once per batch.
    3. Each bucket is sorted by multikey quicksort; strings in a common run cover those of larger ids.
    4. Texts with spans (found by a bounded bitmap first) meet them again and are cut.

    A text of one short period chooses a suffix per period, so it can carry up to 84 bytes for each of its own.
    Null texts count as empty. A null id counts as larger than all others; rows of one id don't cover each other; equal rows get equal
    results. An empty table gives an empty result."""
    order = F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))
    marked = _with_copies(docs.select(F.col(id_col).alias("_id"), order.alias("id"), text_or_empty(text_col).alias("text")))
    rows = marked.where("not copy").select("id", _digest(F.col("text")).alias("dig"), "text")
    spans = materialise(repeated_spans(rows).groupBy("id", "dig").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "op6-spans")
    full = with_flag(marked.select("_id", F.col("id").alias("_order"), F.col("text").alias("_text"), "copy"),
                     flag_filter(spans, flag_slot(F.col("id"))), flag_slot(F.col("_order")), "_flag")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, n_spans, kept = [], [], []
            for t, s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = t.encode("utf-8", "replace")
                runs = _merged(s or [], e or [])
                ends = [0, *(y for _, y in runs)]
                kept.append(b"".join(data[x:y] for x, y in zip(ends, [*(x for x, _ in runs), len(data)])))
                removed.append(len(data) - len(kept[-1]))
                n_spans.append(len(runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r + len(k) for r, k in zip(removed, kept)], pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    met = full.where("_flag and not copy").withColumn("_dig", _digest(F.col("_text"))) \
        .join(spans, (F.col("_order") == F.col("id")) & (F.col("_dig") == F.col("dig")), "left").select("_id", "_text", "starts", "ends")
    changed = met.mapInArrow(cut, f"_id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    none, n_bytes = F.lit(0).cast("bigint"), F.octet_length("_text").cast("bigint")
    whole = full.where("copy or not _flag").select(
        "_id", n_bytes.alias("n_bytes"), F.when(F.col("copy"), n_bytes).otherwise(none).alias("n_removed"),
        F.col("copy").cast("bigint").alias("n_spans"), F.encode(F.when(F.col("copy"), "").otherwise(F.col("_text")), "UTF-8").alias("kept"))
    return whole.unionByName(changed).withColumnRenamed("_id", id_col)
