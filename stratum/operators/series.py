"""Ordered-signal operators (G1-G8) on the long table ``(series_id, pos, value)``.

One series may hold a large share of all rows, so nothing here partitions by the series alone:
window work is keyed by (series, window) or (series, chunk of positions), per-series scalars
(peak, length) are plain group-by aggregates (partial aggregation on the map side) joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum import constants as C


def segment_stride(length: int, overlap: float) -> int:
    return max(1, int((1 - overlap) * length))


def segment(df: DataFrame, length: int | None, overlap: float = 0.0, series_col: str = "series_id",
            pos_col: str = "pos") -> DataFrame:
    """G1: sliding windows by position (window w covers [w*stride, w*stride + length)), the last
    ones short; with no segment length each series is one window. A row goes to every window
    that covers it (``explode(sequence(first, last))``): a narrow map, no shuffle."""
    if length is None:
        return df.withColumn("win", F.lit(0)).withColumn("i", F.col(pos_col))
    stride = segment_stride(length, overlap)
    p = F.col(pos_col)
    first = F.greatest(F.lit(0), F.ceil((p - F.lit(length - 1)) / F.lit(stride))).cast("int")
    last = F.floor(p / F.lit(stride)).cast("int")
    return (df.withColumn("win", F.explode(F.sequence(first, last)))
            .withColumn("i", (p - F.col("win") * F.lit(stride)).cast("int")))


def frames(df: DataFrame, frame_len: int, hop: int | None = None, series_col: str = "series_id",
           pos_col: str = "pos") -> DataFrame:
    """G1 variant: frames of ``frame_len`` every ``hop`` positions (default half a frame); an
    incomplete last frame is dropped (``unfold`` semantics). Series lengths are a group-by
    aggregate joined back."""
    hop = hop or max(1, frame_len // 2)
    lengths = df.groupBy(series_col).agg((F.max(pos_col) + 1).alias("_n"))
    p = F.col(pos_col)
    first = F.greatest(F.lit(0), F.ceil((p - F.lit(frame_len - 1)) / F.lit(hop))).cast("int")
    last = F.least(F.floor(p / F.lit(hop)), F.floor((F.col("_n") - F.lit(frame_len)) / F.lit(hop))).cast("int")
    j = df.join(lengths, series_col).where(last >= first)
    return (j.withColumn("win", F.explode(F.sequence(first, last)))
            .withColumn("i", (p - F.col("win") * F.lit(hop)).cast("int")).drop("_n"))


def hann(i: Column, length: int) -> Column:
    """Periodic Hann window value at index i of a frame of ``length``."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * 3.141592653589793 / length) * i)


def overlap_add_envelope(seg: DataFrame, frame_len: int, hop: int, series_col: str = "series_id",
                         value_col: str = "value", min_envelope: float = 1e-11) -> DataFrame:
    """G3 variant: window-weighted overlap-add divided by the squared-window envelope,
    value(pos) = sum(w * v) / sum(w^2) with a periodic Hann window; positions whose envelope is
    not above ``min_envelope`` (the frame edges) are NULL, to be trimmed by ``unpad_series``."""
    w = hann(F.col("i"), frame_len)
    pos = (F.col("win") * F.lit(hop) + F.col("i")).cast("int")
    agg = (seg.select(series_col, pos.alias("pos"), (w * F.col(value_col)).alias("_wv"), (w * w).alias("_ww"))
           .groupBy(series_col, "pos").agg(F.sum("_wv").alias("_wv"), F.sum("_ww").alias("_ww")))
    return agg.select(series_col, "pos", F.when(F.col("_ww") > F.lit(min_envelope), F.col("_wv") / F.col("_ww"))
                      .alias(value_col))


def rms_normalise(seg: DataFrame, series_col: str = "series_id", value_col: str = "value",
                  eps: float = C.RMS_EPSILON) -> DataFrame:
    """scale = eps + sqrt(mean(v^2)) per (series, window); value divided by it; scale kept."""
    w = Window.partitionBy(series_col, "win")
    scale = F.lit(eps) + F.sqrt(F.avg(F.col(value_col) * F.col(value_col)).over(w))
    return seg.withColumn("scale", scale).withColumn(value_col, F.col(value_col) / F.col("scale"))


def rms_restore(seg: DataFrame, value_col: str = "value") -> DataFrame:
    """G2 inverse: multiply the kept scale back."""
    return seg.withColumn(value_col, F.col(value_col) * F.col("scale"))


def overlap_add(seg: DataFrame, length: int, stride: int, series_col: str = "series_id",
                value_col: str = "value") -> DataFrame:
    """Recombine windows; weight(i) = 0.5 - |t - 0.5| with t = (i + 1) / (length + 1);
    value(pos) = sum(w * v) / sum(w) over the windows covering pos."""
    t = (F.col("i") + 1) / F.lit(float(length + 1))
    w = F.lit(0.5) - F.abs(t - F.lit(0.5))
    pos = (F.col("win") * F.lit(stride) + F.col("i")).cast("int")
    return (seg.select(series_col, pos.alias("pos"), w.alias("_w"), (w * F.col(value_col)).alias("_wv"))
            .groupBy(series_col, "pos").agg((F.sum("_wv") / F.sum("_w")).alias(value_col)))


def safe_log(c, clip: float = C.SAFE_LOG_CLIP) -> Column:
    """ln(max(x, clip))."""
    return F.ln(F.greatest(_c(c), F.lit(clip)))


def symlog(c) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(_c(c)) * F.log1p(F.abs(_c(c)))


def symexp(c) -> Column:
    """sign(x) * (e^|x| - 1)."""
    return F.signum(_c(c)) * F.expm1(F.abs(_c(c)))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def limit_peak(df: DataFrame, rescale: bool = True, limit: float = C.PEAK_LIMIT, series_col: str = "series_id",
               value_col: str = "value", out_col: str | None = None) -> DataFrame:
    """Rescale each series by min(limit / max|v|, 1) (an all-zero series is left as is), or
    clamp to [-limit, limit]. The peak is a group-by aggregate joined back, not a window.
    The result goes to ``out_col`` (default: replaces ``value_col``)."""
    v = F.col(value_col)
    out = out_col or value_col
    if not rescale:
        return df.withColumn(out, F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))
    peaks = df.groupBy(series_col).agg(F.max(F.abs(v)).alias("_mx"))
    factor = F.when(F.col("_mx") > 0, F.least(F.lit(limit) / F.col("_mx"), F.lit(1.0))).otherwise(F.lit(1.0))
    return df.join(peaks, series_col).withColumn(out, v * factor).drop("_mx")


def convert_channels(df: DataFrame, target_channels: int, series_col: str = "series_id", channel_col: str = "channel",
                     pos_col: str = "pos", value_col: str = "value", channels: int | None = None) -> DataFrame:
    """Target 1 -> mean over channels per position; target 2 -> mono duplicated (stereo kept);
    other targets only from mono (copied). Decided per series by its own number of channels, which must be 1 or
    2; ``channels`` states it for all of them and saves the count. A series that can't be converted fails the plan."""
    if channels is not None and channels not in (1, 2):
        raise ValueError(f"{channels} channels given; only 1 or 2 can be converted")
    if channels is None:
        per = df.groupBy(series_col).agg(F.countDistinct(channel_col).alias("_n_in"))
        rows = df.join(per, series_col)
    else:
        rows = df.withColumn("_n_in", F.lit(channels).cast("bigint"))
    fail = F.raise_error(F.concat(F.lit("no conversion from "), F.col("_n_in").cast("string"),
                                  F.lit(f" to {target_channels} channels in series "), F.col(series_col).cast("string")))
    if target_channels == 1:
        value = F.when(F.col("_n_in") <= 2, F.col(value_col)).otherwise(fail.cast("double"))
        return (rows.withColumn(value_col, value).groupBy(series_col, pos_col).agg(F.avg(value_col).alias(value_col))
                .withColumn(channel_col, F.lit(0)))
    copies = F.sequence(F.lit(0), F.lit(target_channels - 1))
    kept = F.array(F.col(channel_col).cast("int")) if target_channels == 2 else fail.cast("array<int>")
    to = F.when(F.col("_n_in") == 1, copies).when(F.col("_n_in") == 2, kept).otherwise(fail.cast("array<int>"))
    return rows.withColumn(channel_col, F.explode(to)).drop("_n_in")


def missing_to_full_window(length: Column, kernel: int, stride: int, padded: int = 0) -> Column:
    """How many positions a series of ``length`` plus ``padded`` lacks for its last window of
    ``kernel`` to end at a whole number of strides."""
    return F.pmod(F.lit(kernel - padded) - length, F.lit(stride)).cast("int")


def pad_series(df: DataFrame, left: int, right: int, mode: str = "zero", value: float = 0.0,
               series_col: str = "series_id", pos_col: str = "pos", value_col: str = "value",
               extra_for: tuple[int, int] | None = None, extra_mode: str = "zero") -> DataFrame:
    """Pad every series on the left/right (zero/constant or reflect). Reflect on a series not
    longer than the pad first zero-extends it (then trims).
    ``extra_for=(kernel, stride)`` adds positions at the end so the last convolution window is full: zeros, or with
    ``extra_mode="reflect"`` more of the reflected series.

    Only the new positions are generated (left + right + extra per series); original rows are
    shifted in place, and reflected values are fetched with an equi join on (series, pos)."""
    lengths = df.groupBy(series_col).agg((F.max(pos_col) + 1).alias("_n"))
    n = F.col("_n")
    if extra_for is not None:
        lengths = lengths.withColumn("_extra", missing_to_full_window(n, *extra_for))
    else:
        lengths = lengths.withColumn("_extra", F.lit(0))
    r_total = F.lit(right) + F.col("_extra")
    # p runs over the padded positions relative to the original start
    new = lengths.select(series_col, "_n", "_extra", F.explode(F.concat(
        F.sequence(F.lit(-left), F.lit(-1)) if left > 0 else F.array().cast("array<int>"),
        F.when(r_total > 0, F.sequence(n, n + r_total - 1)).otherwise(F.array().cast("array<int>")),
    )).alias("_p"))
    if mode == "reflect":
        max_pad = F.greatest(F.lit(left), r_total) if extra_mode == "reflect" else F.lit(max(left, right))
        n2 = F.when(n <= max_pad, max_pad + 1).otherwise(n)  # zero-extended length
        p = F.col("_p")
        src = F.when(p < 0, -p).when(p >= n2, F.lit(2) * (n2 - 1) - p).otherwise(p)
        if extra_mode != "reflect":
            src = F.when(p >= n + F.lit(right), F.lit(None)).otherwise(src)
        new = new.withColumn("_src", src.cast("int"))
        orig = df.select(series_col, F.col(pos_col).alias("_src"), F.col(value_col).alias("_v"))
        new = new.join(orig, [series_col, "_src"], "left").withColumn(
            value_col, F.coalesce(F.col("_v"), F.lit(0.0)))
    else:
        new = new.withColumn(value_col, F.when(F.col("_p") >= n + F.lit(right), F.lit(0.0)).otherwise(F.lit(value)))
    padded_new = new.select(series_col, (F.col("_p") + F.lit(left)).cast("int").alias(pos_col), value_col)
    shifted = df.select(series_col, (F.col(pos_col) + F.lit(left)).cast("int").alias(pos_col), value_col)
    return shifted.unionByName(padded_new)


def unpad_series(df: DataFrame, left: int, right: int, series_col: str = "series_id",
                 pos_col: str = "pos") -> DataFrame:
    """G7 inverse: drop ``left`` and ``right`` positions and shift back."""
    lengths = df.groupBy(series_col).agg((F.max(pos_col) + 1).alias("_n"))
    j = df.join(lengths, series_col)
    if left + right > 0:
        j = j.where((F.col(pos_col) >= left) & (F.col(pos_col) < F.col("_n") - F.lit(right)))
    return j.withColumn(pos_col, (F.col(pos_col) - F.lit(left)).cast("int")).drop("_n")


def micros(df: DataFrame, ts_col: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column; TIMESTAMP_NTZ values are read as
    wall-clock UTC, independent of the session time zone."""
    if dict(df.dtypes)[ts_col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts_col}`)")
    return F.unix_micros(F.col(ts_col))


def resample_series(events: DataFrame, step_seconds: int, series_col: str = "series_id", ts_col: str = "ts",
                    tie_col: str = "event_id", value_col: str = "value", chunk_seconds: int = 86_400) -> DataFrame:
    """G8 (re-aimed): irregular events -> regular grid (every ``step_seconds`` from the first
    grid point at or after the first event to the last event) by linear interpolation between
    the neighbouring events.

    Two-phase, chunked by time (``chunk_seconds``, a day by default; shorten it for denser
    series): events are ordered inside (series, chunk), after the last one stands the first event of the series' next
    chunk that has any, from a small per-(series, chunk) table. Each event makes the grid points from itself to before the event after
    it; they are neither shuffled nor sorted. A long gap is cut at the chunks first, and its pieces are dealt to the tasks, so
    no array is longer than a chunk and a dominant series' points are made by many tasks.
    """
    step, chunk = step_seconds * 1_000_000, chunk_seconds * 1_000_000
    chunk_of = lambda c: F.floor(c / F.lit(chunk)).cast("bigint")
    first_grid = lambda c: c + F.pmod(-c, F.lit(step))  # noqa: E731  at or after c
    ev = (events.select(series_col, micros(events, ts_col).alias("_t"), F.col(tie_col).alias("_tie"), F.col(value_col).alias("_v"))
          .where("_t is not null").withColumn("_day", chunk_of(F.col("_t"))))
    days = ev.groupBy(series_col, "_day").agg(F.min(F.struct("_t", "_tie", "_v")).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(series_col).orderBy("_day"))
    ends = days.select(series_col, "_day", after.alias("_e")).where("_e is not null").select(series_col, "_day", "_e.*")

    # events at the same instant: the last of them is the one before a later point, the first the one after an earlier point
    w = Window.partitionBy(series_col, "_day").orderBy("_t", F.col("_tie").asc_nulls_first(), "_v")
    untied = F.last(F.when(F.col("_tie").isNull(), F.struct("_t", "_v")), ignorenulls=True)
    rows = ev.withColumn("_end", F.lit(False)).unionByName(ends.withColumn("_end", F.lit(True)))
    pairs = (rows.select(series_col, "_day", "_t", "_v", "_end", F.lead("_t").over(w).alias("_t1"), F.lead("_v").over(w).alias("_v1"),
                         untied.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_u"))
             .where("not _end"))
    # of events at one instant those without a tie value come last for points of their own chunk, first for later ones
    near = F.when(F.col("_u._t") == F.col("_t"), F.col("_u._v")).otherwise(F.col("_v"))
    gaps = pairs.select(series_col, "_day", "_t", "_v", near.alias("_v0"), "_t1", "_v1", first_grid(F.col("_t")).alias("_from"),
                        F.coalesce(F.col("_t1") - 1, F.col("_t")).alias("_to")).where("_from <= _to")
    pieces = (gaps.withColumn("_at", F.explode(F.sequence(chunk_of(F.col("_from")), chunk_of(F.col("_to")))))
              .repartition(series_col, "_at"))
    start = F.greatest("_from", first_grid(F.col("_at") * F.lit(chunk)))
    end = F.least("_to", (F.col("_at") + 1) * F.lit(chunk) - 1)
    points = F.when(start <= end, F.sequence(start, end, F.lit(step).cast("bigint")))
    grd = pieces.select("*", F.explode(points).alias("_g"))
    v0 = F.when(F.col("_at") == F.col("_day"), F.col("_v0")).otherwise(F.col("_v"))
    frac = (F.col("_g") - F.col("_t")).cast("double") / (F.col("_t1") - F.col("_t")).cast("double")
    val = F.when(F.col("_g") == F.col("_t"), v0).otherwise(v0 + (F.col("_v1") - v0) * frac)
    # rows without a series have no neighbours in other chunks
    inside = (F.col("_at") == F.col("_day")) & ((F.col("_g") == F.col("_t")) | (chunk_of(F.col("_t1")) == F.col("_at")))
    return grd.select(series_col, F.col("_g").alias("t_us"), F.when(F.col(series_col).isNotNull() | inside, val).alias(value_col))


def chunked(df: DataFrame, pos_col: str, chunk_rows: int, halo: int) -> DataFrame:
    """Assign rows to position chunks of ``chunk_rows``; rows within ``halo`` positions before a
    chunk are copied into it (``_halo`` = true) so a trailing window of ``halo`` + 1 rows can be
    computed per (series, chunk) exactly. Callers drop the halo rows afterwards."""
    own = df.withColumn("_chunk", F.floor(F.col(pos_col) / F.lit(chunk_rows)).cast("bigint")).withColumn(
        "_halo", F.lit(False))
    if halo <= 0:
        return own
    # a row is also needed by every later chunk that starts within ``halo`` positions after it
    last = F.floor((F.col(pos_col) + F.lit(halo)) / F.lit(chunk_rows)).cast("bigint")
    copies = (own.where(last > F.col("_chunk"))
              .withColumn("_chunk", F.explode(F.sequence(F.col("_chunk") + 1, last)))
              .withColumn("_halo", F.lit(True)))
    return own.unionByName(copies)


def rolling_throughput(df: DataFrame, window: int = C.THROUGHPUT_WINDOW, series_col: str = "series_id",
                       pos_col: str = "pos", time_col: str = "time_s", samples_col: str = "samples",
                       items_col: str = "items", items_are_increments: bool = False,
                       chunk_rows: int = 4096) -> DataFrame:
    """A5: rolling rates over the last ``window`` records (including the current one):
    samples/s and items/s = (x_now - x_first) / (t_now - t_first) for cumulative counters (for
    per-record increments: the increments after the first record of the window); NULL with one
    record or no elapsed time. Windows run per (series, chunk) with a halo, so no series is one
    task."""
    c = chunked(df, pos_col, chunk_rows, window - 1)
    w = Window.partitionBy(series_col, "_chunk").orderBy(pos_col).rowsBetween(-(window - 1), 0)
    dt = F.col(time_col) - F.first(time_col).over(w)

    def rate(x, increments=False):
        gained = (F.sum(x).over(w) if increments else F.col(x)) - F.first(x).over(w)
        return F.when(dt > 0, gained / dt)

    out = c.select(series_col, pos_col, "_halo", rate(samples_col).alias("samples_per_sec"),
                   rate(items_col, items_are_increments).alias("items_per_sec"))
    return out.where(~F.col("_halo")).drop("_halo")

