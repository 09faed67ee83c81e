import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import packing as pk
from stratum.plans.jobs import pack_corpus_job


def _scan_all_bins(lengths, seq, capacity, max_bins=None):
    """First fit by looking at every bin, in order."""
    room, bins = [], np.empty(len(lengths), int)
    for i in np.lexsort((seq, -lengths)):
        for b, r in enumerate(room):
            if r >= lengths[i]:
                break
        else:
            if max_bins is not None and len(room) >= max_bins:
                return None
            b = len(room)
            room.append(capacity)
        room[b] -= lengths[i]
        bins[i] = b
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_tree_finds_the_bin_that_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 120))
    lengths, seq = rng.integers(0, [20, 60, 130][seed % 3], n), rng.permutation(n)  # empty rows and rows over the capacity too
    for most in (None, 0, 3, 20, 200):
        want, got = _scan_all_bins(lengths, seq, 100, most), pk.ffd_assign(lengths, seq, 100, most)
        assert (want is None and got is None) or got[0].tolist() == want.tolist()


def test_a_million_rows_in_a_bucket():
    lengths = np.random.default_rng(1).integers(900, 1100, 200_000)  # three or four to a bin: tens of thousands of open bins
    bins, _ = pk.ffd_assign(lengths, np.arange(len(lengths)), 4096)
    load = np.bincount(bins, weights=lengths)
    assert load.max() <= 4096 and len(load) <= 1.1 * lengths.sum() / 4096


def test_ranks_are_folders_in_batch_order(spark, tmp_path):
    packs = spark.range(1000).select(((F.col("id") % 4) * pk.PACK_ID_SHIFT + F.floor(F.col("id") / 4)).cast("bigint").alias("pack_id"), F.col("id").alias("v"))
    dealt = pk.deal_packs(packs, 3)
    path = str(tmp_path / "r")
    pk.write_ranks(dealt, path, batches_per_file=10)
    want = sorted((r.batch_id, r.pack_id, r.v) for r in dealt.collect() if r["rank"] == 2)
    one = pk.read_rank(spark, path, 2)
    assert sorted((r.batch_id, r.pack_id, r.v) for r in one.collect()) == want
    assert sorted({r.batch_id % pk.PACK_ID_SHIFT for r in one.collect()}) == list(range(83))
    fresh = pk.read_rank(spark, path, 2).select("v")._jdf.queryExecution()
    plan = fresh.executedPlan()
    fresh.toRdd().count()
    files = plan.collectLeaves().apply(0).metrics().get("numFiles").get().value()
    assert files == 4 * 9  # of 3 x 36
    names = one.select("batch_id", F.input_file_name().alias("f"), "chunk").collect()
    per = {}
    for r in names:
        per.setdefault(r.f, []).append(r.batch_id)
    assert all(b == sorted(b) and len(b) <= 10 for b in per.values())
    few = pk.read_rank(spark, path, 2, chunks=(0, 1)).collect()
    assert sorted({r.batch_id for r in few}) == list(range(20))
    groups = dealt.groupBy("batch_id").agg(F.collect_set("rank").alias("r")).where(F.size("r") == 3).count()
    assert groups == 4 * 83  # the last pack of a bucket begins a batch of its own


def test_packing_asks_for_its_buckets(spark, tmp_path):
    df = spark.createDataFrame([(i, 5) for i in range(9)], "seq_id long, length int")
    for fn in (pk.pack_next_fit, pk.pack_ffd):
        with pytest.raises(ValueError, match="n_buckets"):
            fn(df, capacity=10, n_buckets=None)
    rows = spark.createDataFrame([(i, [i] * 5, [i] * 5) for i in range(9)], "seq_id long, input_ids array<bigint>, labels array<bigint>")
    with pytest.raises(ValueError, match="n_buckets"):
        pack_corpus_job(rows, str(tmp_path / "p"), capacity=10, n_buckets=None)
    assert pack_corpus_job(rows, str(tmp_path / "q"), capacity=10).count() >= 5
