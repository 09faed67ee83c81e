"""Queries of ordering and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.operators import ordering as od
from stratum.operators import packing as pk
from stratum.plans import sql as S
from stratum.plans.q_tokens import _SFT, sft_rows
from stratum.plans.registry import query
from stratum.session import checkpoint_dir

CAP = 4096
NB = 64  # packing buckets for the queries (a parameter of the operators)
NB_RANKS, RANKS = 8, 4  # K5: a batch needs the rows of several ranks



def _ordered_sql(src: str, seed: int, n_buckets: int, where: str = "TRUE") -> str:
    k = S.key("seq_id", seed)
    return f"""o AS (
  SELECT seq_id, length, {S.bucket(k, n_buckets)} AS bucket, {k} AS k FROM {src} WHERE {where}),
orn AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k, seq_id) AS rn FROM o)"""


def _next_fit_sql(cap: int) -> str:
    return f"""nf(bucket, rn, seq_id, length, pack_no, cur) AS (
  SELECT bucket, rn, seq_id, length, 0, length FROM orn WHERE rn = 1
  UNION ALL
  SELECT o.bucket, o.rn, o.seq_id, o.length,
         CASE WHEN nf.cur + o.length <= {cap} THEN nf.pack_no ELSE nf.pack_no + 1 END,
         CASE WHEN nf.cur + o.length <= {cap} THEN nf.cur + o.length ELSE o.length END
  FROM nf JOIN orn o ON o.bucket = nf.bucket AND o.rn = nf.rn + 1),
packs AS (
  SELECT seq_id, length, CAST(bucket AS BIGINT) * 4294967296 + pack_no AS pack_id,
         CAST(row_number() OVER (PARTITION BY bucket, pack_no ORDER BY length DESC, seq_id) - 1 AS INTEGER) AS pos
  FROM nf)"""


def _ffd_sql(cap: int) -> str:
    return f"""fo AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY length DESC, seq_id) AS frn FROM o),
ffd(bucket, frn, seq_id, length, bins, bin) AS (
  SELECT bucket, frn, seq_id, length, [{cap} - length], 1 FROM fo WHERE frn = 1
  UNION ALL
  SELECT bucket, frn, seq_id, length,
         CASE WHEN idx IS NULL THEN list_append(bins, {cap} - length)
              ELSE list_transform(range(1, len(bins) + 1),
                                  lambda i: CASE WHEN i = idx THEN bins[i] - length ELSE bins[i] END) END,
         coalesce(idx, len(bins) + 1)
  FROM (SELECT o.bucket, o.frn, o.seq_id, o.length, f.bins,
               nullif(list_position(list_transform(f.bins, lambda b: b >= o.length), true), 0) AS idx
        FROM ffd f JOIN fo o ON o.bucket = f.bucket AND o.frn = f.frn + 1)),
ffd_packs AS (
  SELECT bucket, seq_id, length, bin - 1 AS pack_no,
         CAST(bucket AS BIGINT) * 4294967296 + bin - 1 AS pack_id,
         CAST(row_number() OVER (PARTITION BY bucket, bin ORDER BY frn) - 1 AS INTEGER) AS pos
  FROM ffd)"""


def _f3(spark, sf_dir):
    return fx.sequences(spark, sf_dir)


# ------------------------------------------------------------------ K1, K2, K7, K13
@query("k1_epoch_permutation", S.with_(S.F3) + f"""
SELECT seq_id, CAST(row_number() OVER (ORDER BY {S.key('seq_id', 7, 1)}, seq_id) - 1 AS BIGINT) AS perm_pos FROM f3""")
def k1_epoch_permutation(spark, sf_dir):
    return od.epoch_permutation(_f3(spark, sf_dir), "seq_id", seed=7, epoch=1, n_buckets=16).select(
        "seq_id", "perm_pos")


@query("k2_running_total", S.with_(S.F3) + f"""
SELECT seq_id, CAST(sum(length) OVER (ORDER BY {S.key('seq_id', 7, 1)}, seq_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum FROM f3""")
def k2_running_total(spark, sf_dir):
    return od.running_total(_f3(spark, sf_dir), "seq_id", "length", seed=7, epoch=1, n_buckets=16).select(
        "seq_id", "cum")


@query("k7_budget_boundary", S.with_(S.F3, _ordered_sql("f3", 0, NB)) + f""",
c AS (SELECT *, sum(length) OVER (PARTITION BY bucket ORDER BY k, seq_id) AS cum FROM orn)
SELECT a.bucket, a.seq_id,
       CAST((SELECT count(*) FROM c b WHERE b.bucket = a.bucket AND b.rn >= a.rn
                                       AND b.cum <= a.cum - a.length + {2 * CAP}) AS BIGINT) AS boundary
FROM c a""")
def k7_budget_boundary(spark, sf_dir):
    return od.budget_boundary(_f3(spark, sf_dir), "seq_id", "length", budget=2 * CAP, seed=0, n_buckets=NB)


@query("k13_sample_rows", S.with_(S.F3) + f""",
perm AS (SELECT seq_id, row_number() OVER (ORDER BY {S.key('seq_id', 3)}, seq_id) - 1 AS perm_pos FROM f3),
draws AS (SELECT i AS draw, {S.md5_int("'3:draw:' || i::VARCHAR")} % (SELECT count(*) FROM f3) AS perm_pos
          FROM range(2000) t(i))
SELECT draw, seq_id FROM draws JOIN perm USING (perm_pos)""")
def k13_sample_rows(spark, sf_dir):
    return od.sample_rows(_f3(spark, sf_dir), "seq_id", 2000, seed=3, n_buckets=16).select("draw", "seq_id")


# ------------------------------------------------------------------ K3-K6, K8, K11
@query("k6_pack_next_fit", S.with_(S.F3, _ordered_sql("f3", 0, NB, f"length <= {CAP}")).replace("WITH ", "WITH RECURSIVE ", 1)
       + ",\n" + _next_fit_sql(CAP) + "\nSELECT seq_id, pack_id, pos FROM packs")
def k6_pack_next_fit(spark, sf_dir):
    return pk.pack_next_fit(_f3(spark, sf_dir), capacity=CAP, n_buckets=NB).select("seq_id", "pack_id", "pos")


@query("k4_pack_ffd", S.with_(S.F3, _ordered_sql("f3", 0, NB, f"length <= {CAP}")).replace("WITH ", "WITH RECURSIVE ", 1)
       + ",\n" + _ffd_sql(CAP) + "\nSELECT seq_id, pack_id, pos FROM ffd_packs")
def k4_pack_ffd(spark, sf_dir):
    return pk.pack_ffd(_f3(spark, sf_dir), capacity=CAP, n_buckets=NB).select("seq_id", "pack_id", "pos")


@query("k3_ffd_fits", S.with_(S.F3, _ordered_sql("f3", 0, NB)).replace("WITH ", "WITH RECURSIVE ", 1)
       + ",\n" + _ffd_sql(CAP) + """
SELECT bucket, CAST(count(*) AS BIGINT) AS n_rows, max(pack_no) + 1 <= 16 AS fits FROM ffd_packs GROUP BY bucket""")
def k3_ffd_fits(spark, sf_dir):
    return pk.ffd_fits(_f3(spark, sf_dir), n_bins=16, capacity=CAP, n_buckets=NB)


@query("k5_pack_multifit", S.with_(S.F3, _ordered_sql("f3", 0, NB_RANKS, f"length <= {CAP}")) + """
SELECT bucket, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length) AS BIGINT) AS n_tokens,
       true AS loads_ok, true AS ranks_ok
FROM o GROUP BY bucket""")
def k5_pack_multifit(spark, sf_dir):
    """Invariant check: every row reported once, no bin over capacity, every batch uses all ranks."""
    a = pk.pack_multifit(_f3(spark, sf_dir), n_ranks=RANKS, capacity=CAP, n_buckets=NB_RANKS)
    loads = (a.where(F.col("batch_no").isNotNull()).groupBy("bucket", "batch_no", "rank")
             .agg(F.sum("length").alias("load")))
    per_batch = loads.groupBy("bucket", "batch_no").agg(F.count(F.lit(1)).alias("n_bins"),
                                                        F.max("load").alias("max_load"))
    ok = per_batch.groupBy("bucket").agg(F.bool_and(F.col("max_load") <= CAP).alias("loads_ok"),
                                         F.bool_and(F.col("n_bins") == RANKS).alias("ranks_ok"))
    rows = a.groupBy("bucket").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                   F.sum("length").cast("bigint").alias("n_tokens"))
    return (rows.join(ok, "bucket", "left")
            .select("bucket", "n_rows", "n_tokens", F.coalesce("loads_ok", F.lit(False)).alias("loads_ok"),
                    F.coalesce("ranks_ok", F.lit(False)).alias("ranks_ok")))


@query("k5_gathered_ranks", _SFT + f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len(ids)) AS BIGINT) AS n_tokens,
       true AS once, true AS fits, true AS ranks FROM sft WHERE len(ids) <= {CAP}""")
def k5_gathered_ranks(spark, sf_dir):
    """K5 to K9 to K8: token rows gathered by (batch, rank), one output per rank, the tail reported. Every row is either in
    one pack or in the tail, each pack is within the capacity, each batch has a pack for every rank."""
    rows = fx.written(sft_rows(spark, sf_dir).withColumnRenamed("doc_id", "seq_id"))
    lengths = rows.select("seq_id", F.size("input_ids").alias("length"))
    packed, tail = pk.split_tail(fx.written(pk.pack_multifit(lengths, RANKS, capacity=CAP, n_buckets=NB_RANKS)))
    packs = pk.materialise_packs(packed, rows, ["batch_id", "rank"])
    got = packs.agg(F.sum("n_rows").alias("_n"), F.sum(F.size("input_ids")).alias("_t"), F.max(F.size("input_ids")).alias("_m"),
                    F.count(F.lit(1)).alias("_p"), F.countDistinct("batch_id").alias("_b"))
    left = tail.agg(F.count(F.lit(1)).alias("_tn"), F.coalesce(F.sum("length"), F.lit(0)).alias("_tt"))
    ids = packed.select("seq_id").unionByName(tail.select("seq_id")).agg((F.count(F.lit(1)) == F.countDistinct("seq_id")).alias("once"))
    one = F.lit(1).alias("_one")
    return got.select("*", one).join(left.select("*", one), "_one").join(ids.select("*", one), "_one").select(
        (F.col("_n") + F.col("_tn")).cast("bigint").alias("n_rows"), (F.col("_t") + F.col("_tt")).cast("bigint").alias("n_tokens"), "once",
        (F.col("_m") <= CAP).alias("fits"), (F.col("_p") == F.col("_b") * RANKS).alias("ranks"))


@query("k8_assign_rank", S.with_(S.F3) + f"""
SELECT seq_id, CAST(lane AS INTEGER) AS lane, CAST(lane // 4 AS INTEGER) AS rank, CAST(lane % 4 AS INTEGER) AS worker,
       CAST((lane // 4) * 4 + lane % 4 AS INTEGER) AS worker_seed
FROM (SELECT seq_id, {S.md5_int("'0:lane:' || seq_id::VARCHAR")} % 16 AS lane FROM f3)""")
def k8_assign_rank(spark, sf_dir):
    return pk.assign_lanes(_f3(spark, sf_dir), "seq_id", n_ranks=4, n_workers=4).select(
        "seq_id", "lane", "rank", "worker", "worker_seed")


@query("k8_rank_packs", S.with_(S.F3, _ordered_sql("f3", 0, NB, f"length <= {CAP}")).replace("WITH ", "WITH RECURSIVE ", 1)
       + ",\n" + _next_fit_sql(CAP) + f""",
dealt AS (SELECT pack_id, CAST(pack_id // 4294967296 * 4294967296 + pack_id % 4294967296 // {RANKS} AS BIGINT) AS batch_id,
                 CAST(pack_id % 4294967296 % {RANKS} AS INTEGER) AS rank, seq_id, length, pos FROM packs)
SELECT pack_id, batch_id, rank, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length) AS BIGINT) AS n_tokens,
       md5(string_agg(seq_id::VARCHAR, ',' ORDER BY pos)) AS ids_md5
FROM dealt WHERE rank = 1 GROUP BY ALL""")
def k8_rank_packs(spark, sf_dir):
    """K6 packs dealt to ranks and written by rank; one rank's packs read back from its own folder."""
    from stratum.plans.q_sources import _scratch

    a = pk.pack_next_fit(_f3(spark, sf_dir), capacity=CAP, n_buckets=NB)
    packs = a.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("pos", "seq_id", "length"))).alias("members"))
    path = _scratch(spark, "ranks")
    pk.write_ranks(pk.deal_packs(packs, RANKS), path)
    return pk.read_rank(spark, path, 1).select(
        "pack_id", "batch_id", "rank", F.size("members").cast("bigint").alias("n_rows"),
        F.aggregate("members", F.lit(0).cast("bigint"), lambda t, m: t + m["length"]).alias("n_tokens"),
        F.md5(F.array_join(F.transform("members", lambda m: m["seq_id"].cast("string")), ",")).alias("ids_md5"))


@query("k11_packing_stats", S.with_(S.F3, _ordered_sql("f3", 0, NB, f"length <= {CAP}")).replace("WITH ", "WITH RECURSIVE ", 1)
       + ",\n" + _next_fit_sql(CAP) + f"""
SELECT CAST(count(DISTINCT pack_id) AS BIGINT) AS n_batches, CAST(sum(length) AS BIGINT) AS used_tokens,
       round(sum(length)::DOUBLE / (count(DISTINCT pack_id) * {CAP}), 6) AS efficiency FROM packs""")
def k11_packing_stats(spark, sf_dir):
    return pk.packing_stats(pk.pack_next_fit(_f3(spark, sf_dir), capacity=CAP, n_buckets=NB), CAP)


# ------------------------------------------------------------------ K9, K10, K14 on token rows
_SFT_PACKS = (_SFT.replace("WITH ", "WITH RECURSIVE ", 1) + ",\nsl AS (SELECT doc_id AS seq_id, len(ids) AS length FROM sft),\n"
              + _ordered_sql("sl", 0, NB, f"length <= {CAP}") + ",\n" + _next_fit_sql(CAP) + """,
gathered AS (
  SELECT p.pack_id, CAST(count(*) AS BIGINT) AS n_rows,
         flatten(list(s.ids ORDER BY p.pos)) AS ids, flatten(list(s.labels ORDER BY p.pos)) AS labels,
         flatten(list(range(len(s.ids)) ORDER BY p.pos)) AS positions
  FROM packs p JOIN sft s ON s.doc_id = p.seq_id GROUP BY p.pack_id)
""")


def _packed(spark, sf_dir):
    # J3 writes the token rows once: lengths are read for packing, tokens again for the gather
    checkpoint_dir(spark)
    rows = sft_rows(spark, sf_dir).checkpoint(eager=True)
    lengths = rows.select(F.col("doc_id").alias("seq_id"), F.size("input_ids").alias("length"))
    assign = pk.pack_next_fit(lengths, capacity=CAP, n_buckets=NB)
    return pk.materialise_packs(assign, rows.withColumnRenamed("doc_id", "seq_id"))


def _md5_arr(c):
    return F.md5(F.array_join(F.col(c), ","))


@query("k9_materialise_packs", _SFT_PACKS + """
SELECT pack_id, n_rows, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5,
       md5(array_to_string(labels, ',')) AS labels_md5, md5(array_to_string(positions, ',')) AS pos_md5
FROM gathered""")
def k9_materialise_packs(spark, sf_dir):
    p = _packed(spark, sf_dir)
    return p.select("pack_id", F.col("n_rows").cast("bigint"), F.size("input_ids").cast("bigint").alias("n_tokens"),
                    _md5_arr("input_ids").alias("ids_md5"), _md5_arr("labels").alias("labels_md5"),
                    _md5_arr("position_ids").alias("pos_md5"))


@query("k10_pad_rows", _SFT_PACKS + f"""
SELECT pack_id, CAST(len(ids) AS BIGINT) AS n_tokens,
       md5(array_to_string(list_concat(ids, list_transform(range({CAP} - len(ids)), lambda i: 0)), ',')) AS ids_md5,
       md5(array_to_string(list_concat(labels, list_transform(range({CAP} - len(ids)), lambda i: -100)), ','))
         AS labels_md5,
       md5(array_to_string(list_concat(positions, range({CAP} - len(ids))), ',')) AS pos_md5
FROM gathered""")
def k10_pad_rows(spark, sf_dir):
    packed = _packed(spark, sf_dir).withColumn("n_tokens", F.size("input_ids").cast("bigint"))
    p = pk.pad_rows(packed, CAP, pad_id=0)
    return p.select("pack_id", "n_tokens", _md5_arr("input_ids").alias("ids_md5"),
                    _md5_arr("labels").alias("labels_md5"), _md5_arr("position_ids").alias("pos_md5"))


@query("k14_longest_row", _SFT + "SELECT CAST(max(len(ids)) AS BIGINT) AS longest FROM sft")
def k14_longest_row(spark, sf_dir):
    return sft_rows(spark, sf_dir).agg(pk.longest_row("input_ids").cast("bigint").alias("longest"))
