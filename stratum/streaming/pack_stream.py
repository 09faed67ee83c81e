"""Streaming sequence packer with a per-lane buffer.

Per lane (K8): rows longer than ``max_length`` are skipped; each row joins the buffer; whenever
the buffer holds ``buf_size`` rows it is shuffled (seeded by lane seed and pack number) and
walked from the end, taking every row that still fits; the chosen rows form one pack and
leave the buffer (exactly those rows: the reference's slot overwrite can lose and reuse rows).
Remaining rows are flushed into packs at the end (batch twin ``flush=True``) or on a timer in
the stream. State holds only (seq_id, length) of buffered rows, never tokens; K9/K10 gather and
pad the tokens afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from stratum import constants as C

PACK_SCHEMA = "lane int, pack_no long, seq_ids array<long>, lengths array<int>, n_tokens long"
BATCH_PACK_SCHEMA = "lane int, bucket int, pack_no long, seq_ids array<long>, lengths array<int>, n_tokens long"
STATE_SCHEMA = "seq_ids array<long>, lengths array<int>, n_packs long"


def take_pack(seq: list, lens: list, max_length: int, lane_seed: int, pack_no: int):
    """One pack from the buffer: shuffle, walk from the end, keep rows that fit.
    Returns (chosen seq ids, chosen lengths, remaining seq ids, remaining lengths)."""
    shuffled = np.random.default_rng([lane_seed, pack_no]).permutation(len(seq))
    room, taken = max_length, []
    for i in shuffled[::-1].tolist():
        if room and lens[i] <= room:
            taken.append(i)
            room -= lens[i]
    out = set(taken)
    left = [i for i in shuffled.tolist() if i not in out]
    return [seq[i] for i in taken], [lens[i] for i in taken], [seq[i] for i in left], [lens[i] for i in left]


def run_lane(lane: int, seq: list, lens: list, n_packs: int, rows: pd.DataFrame, max_length: int, buf_size: int,
             flush: bool):
    """Feed ``rows`` (in order) through a lane buffer; returns (packs, seq, lens, n_packs)."""
    packs = []
    for s, n in zip(rows["seq_id"].tolist(), rows["length"].tolist()):
        if n > max_length:
            continue
        seq.append(int(s))
        lens.append(int(n))
        while len(seq) >= buf_size:
            cs, cl, seq, lens = take_pack(seq, lens, max_length, lane, n_packs)
            packs.append((lane, n_packs, cs, cl, int(sum(cl))))
            n_packs += 1
    while flush and seq:
        cs, cl, seq, lens = take_pack(seq, lens, max_length, lane, n_packs)
        packs.append((lane, n_packs, cs, cl, int(sum(cl))))
        n_packs += 1
    return packs, seq, lens, n_packs


def _packs_frame(packs) -> pd.DataFrame:
    return pd.DataFrame(packs, columns=["lane", "pack_no", "seq_ids", "lengths", "n_tokens"])


def pack_lanes_batch(df: DataFrame, max_length: int = C.STREAM_CAPACITY, buf_size: int = C.STREAM_BUFFER,
                     order_col: str = "_key", flush: bool = True, n_buckets: int = C.PACK_BUCKETS) -> DataFrame:
    """Batch twin of K12: rows ``(lane, seq_id, length, <order_col>)``. A lane is cut into
    ``n_buckets`` contiguous stretches of the hash order (an argument, never derived) and each
    (lane, bucket) is one ``applyInPandas`` group holding the narrow columns only; the buffer
    is flushed at the end of each stretch."""
    from stratum.operators.ordering import key_bucket

    keyed = df.select("lane", "seq_id", "length", order_col).withColumn("bucket", key_bucket(F.col(order_col), n_buckets))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order_col, "seq_id"], kind="mergesort")
        packs, *_ = run_lane(int(pdf["lane"].iloc[0]), [], [], 0, pdf, max_length, buf_size, flush)
        out = _packs_frame(packs)
        out.insert(1, "bucket", int(pdf["bucket"].iloc[0]))
        return out

    return keyed.groupBy("lane", "bucket").applyInPandas(fn, BATCH_PACK_SCHEMA)


def pack_stream(stream: DataFrame, max_length: int = C.STREAM_CAPACITY, buf_size: int = C.STREAM_BUFFER,
                order_col: str = "_key", flush_after_ms: int | None = 30_000) -> DataFrame:
    """K12 on a streaming DataFrame ``(lane, seq_id, length, <order_col>)``: keyed state per lane
    (``applyInPandasWithState``, append mode). Each micro-batch is fed in ``order_col`` order; a
    lane idle for ``flush_after_ms`` flushes its buffer (processing-time timeout)."""

    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        lane = int(key[0])
        if state.exists:
            seq, lens, n_packs = state.get
            seq, lens = list(seq), list(lens)
        else:
            seq, lens, n_packs = [], [], 0
        if state.hasTimedOut:
            packs, seq, lens, n_packs = run_lane(lane, seq, lens, n_packs, pd.DataFrame(
                {"seq_id": [], "length": []}), max_length, buf_size, True)
            state.update((seq, lens, n_packs))  # the buffer is empty now; pack numbers go on
        else:
            frames = [p for p in pdfs if len(p)]
            rows = (pd.concat(frames).sort_values([order_col, "seq_id"], kind="mergesort") if frames
                    else pd.DataFrame({"seq_id": [], "length": []}))
            packs, seq, lens, n_packs = run_lane(lane, seq, lens, n_packs, rows, max_length, buf_size, False)
            state.update((seq, lens, n_packs))
            if flush_after_ms:
                state.setTimeoutDuration(int(flush_after_ms))
        if packs:
            yield _packs_frame(packs)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_after_ms else GroupStateTimeout.NoTimeout
    return (stream.select("lane", "seq_id", "length", order_col).groupBy("lane")
            .applyInPandasWithState(fn, PACK_SCHEMA, STATE_SCHEMA, "append", timeout))


def explode_packs(packs: DataFrame) -> DataFrame:
    """(lane, pack_no, seq_id, pos) rows of the packs, for K9."""
    return packs.select("lane", "pack_no", F.posexplode("seq_ids").alias("pos", "seq_id"))
