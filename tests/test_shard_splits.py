import io
import os
import random
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from stratum.sources import files as fs
from stratum.sources import shards as sh
from stratum.streaming import jobs


def _tar(path, samples, mode="w", fmt=tarfile.GNU_FORMAT):
    with tarfile.open(path, mode, format=fmt) as tf:
        for key, members in samples:
            for ext, data in members.items():
                info = tarfile.TarInfo(f"{key}.{ext}")
                info.size = len(data)
                tf.addfile(info, io.BytesIO(data))


def _samples(n, seed=1, prefix="s"):
    rng = random.Random(seed)
    long = "d" * 120 + "/" + "n" * 130  # longer than a header's name field
    return [(f"{prefix}{i}" if i % 9 else f"{long}{i}", {"json": b"{}" * rng.randrange(0, 30), "txt": rng.randbytes(rng.randrange(0, 5000))} if i % 5
             else {"bin": rng.randbytes(3000)}) for i in range(n)]


def _rows(df):
    return sorted((r.shard, r.key, {k: bytes(v) for k, v in r.members.items()}) for r in df.collect())


@pytest.mark.parametrize("fmt", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_large_tar_is_cut_between_samples(spark, tmp_path, fmt):
    samples = _samples(900)
    if fmt == tarfile.USTAR_FORMAT:
        samples = [(k[-60:], m) for k, m in samples]
    path = str(tmp_path / "big.tar")
    _tar(path, samples, fmt=fmt)
    assert os.path.getsize(path) > 2 << 20
    ranges = sh.split_tar(path, 200_000)
    assert len(ranges) > 5 and ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    df = sh.read_shards(spark, [path], target_bytes=200_000)
    assert df.rdd.getNumPartitions() == len(ranges)
    want = sorted(("big.tar", k, m) for k, m in samples)
    assert _rows(df) == want and _rows(sh.read_shards(spark, [path], target_bytes=1 << 30)) == want


def test_compressed_and_empty_tars_stay_whole(spark, tmp_path):
    samples = _samples(300)
    gz, empty = str(tmp_path / "a.tar"), str(tmp_path / "b.tar")
    _tar(gz, samples, mode="w:gz")
    _tar(empty, [])
    assert sh.split_tar(gz, 1000) == [(0, None)] and sh.split_tar(empty, 1000) == [(0, 0)]
    df = sh.read_shards(spark, [gz, empty], target_bytes=1000)
    assert _rows(df) == sorted(("a.tar", k, m) for k, m in samples)


def test_headers_for_the_whole_archive_prevent_a_cut(tmp_path):
    path = str(tmp_path / "g.tar")
    with tarfile.open(path, "w", format=tarfile.PAX_FORMAT, pax_headers={"comment": "global"}) as tf:
        for i in range(50):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 5000
            tf.addfile(info, io.BytesIO(b"x" * 5000))
    assert sh.split_tar(path, 20_000) == [(0, None)]


def test_member_index_points_at_the_payloads(spark, tmp_path):
    samples = _samples(60)
    path = str(tmp_path / "i.tar")
    _tar(path, samples)
    data = open(path, "rb").read()
    index = sh.index_members(spark, [path]).collect()
    want = {(k, e): d for k, m in samples for e, d in m.items()}
    assert {(r.key, r.ext): data[r.offset:r.offset + r.size] for r in index} == want and {r.shard for r in index} == {"i.tar"}


def test_filters_on_shard_and_key_reach_the_source(spark, tmp_path):
    for i in range(4):
        _tar(str(tmp_path / f"{i}.tar"), _samples(20, seed=i, prefix=f"k{i}-"))
    (tmp_path / "bad.tar").write_bytes(b"no tar at all" * 100)
    paths = [str(tmp_path / f) for f in ("0.tar", "1.tar", "2.tar", "3.tar", "bad.tar")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = sh.read_shards(spark, paths).where("shard in ('1.tar', '3.tar') and key like 'k%'")
        assert {r.shard for r in got.collect()} == {"1.tar", "3.tar"}  # the damaged shard isn't opened
        one = sh.read_shards(spark, paths[:4]).where("key = 'k2-4'").collect()
        assert [(r.shard, r.key) for r in one] == [("2.tar", "k2-4")]
        both = sh.read_shards(spark, paths).where("shard = '0.tar'").where("shard = '1.tar'")
        assert both.count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception):
        sh.read_shards(spark, paths).collect()


def test_few_tasks_write_many_small_files(spark, tmp_path):
    df = spark.range(400).select("id", F.format_string("%05d", "id").alias("key"), F.create_map(F.lit("txt"), F.encode(F.col("id").cast("string"), "UTF-8")).alias("members"))
    assert sh.write_shards(df, str(tmp_path), 4, order_col="id") == 100
    back = sh.read_shards(spark, sh.list_shards(spark, str(tmp_path), sort=False))
    per = back.groupBy("shard").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("shard").collect()
    assert [(r.n, r.lo, r.hi) for r in per] == [(4, f"{4 * i:05d}", f"{4 * i + 3:05d}") for i in range(100)]


def test_rows_to_write_are_computed_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            runs.add(len(pdf))
            yield pdf

    df = spark.range(50).selectExpr("id", "cast(id as string) as key").mapInPandas(count, "id long, key string") \
        .withColumn("members", F.create_map(F.lit("txt"), F.encode("key", "UTF-8")))
    sh.write_shards(df, str(tmp_path), 10, order_col="id")
    assert runs.value == 50


def test_empty_manifest_folder_of_a_failed_run(spark, tmp_path):
    for i in range(3):
        _tar(str(tmp_path / f"{i}.tar"), _samples(5, seed=i))
    out = tmp_path / "out"
    (out / "_manifest").mkdir(parents=True)
    listing = sh.list_shards(spark, str(tmp_path))
    process = lambda paths: sh.read_shards(spark, [r["path"] for r in paths.collect()], members=[]).select("key")
    got = fs.run_incremental(spark, listing, str(out), process, group_size=2).collect()
    assert [(r.output, r.n_rows) for r in got] == [("shard_000", 10), ("shard_001", 5)]
    assert fs.run_incremental(spark, listing, str(out), process, group_size=2).count() == 0


def _written(spark, out):
    return sorted(r.key for r in spark.read.schema("key string").json(f"{out}/shard_*").collect())


def test_stream_of_shards_restarts_in_mid_run_exactly_once(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    want = []
    for i in range(7):
        _tar(str(src / f"{9 - i}.tar"), _samples(6, seed=i, prefix=f"b{i}-"))  # names against the order of time
        want += [k for k, _ in _samples(6, seed=i, prefix=f"b{i}-")]
        time.sleep(0.02)
    flag = tmp_path / "fail"
    flag.touch()

    def process(samples):
        rows = samples.select("key")
        if "shard_001" in os.listdir(out) if os.path.isdir(out) else False:
            if flag.exists():
                raise RuntimeError("lost")
        elif os.path.isdir(out) and flag.exists():
            os.makedirs(os.path.join(out, "shard_001"), exist_ok=True)
            (tmp_path / "out" / "shard_001" / "part-half.json").write_text('{"key":"half"}\\n')  # a half-written batch
            raise RuntimeError("lost")
        return rows

    with pytest.raises(Exception, match="lost"):
        jobs.run_shard_stream(spark, str(src), out, ck, process, group_size=2, settle_seconds=0.1)
    assert sorted(os.listdir(out)) == ["shard_000", "shard_001"]
    flag.unlink()
    got = jobs.run_shard_stream(spark, str(src), out, ck, process, group_size=2, settle_seconds=0.1).collect()
    assert [r.output for r in got] == ["shard_001", "shard_002", "shard_003"] and sum(r.n_rows for r in got) == 30
    assert _written(spark, out) == sorted(want)
    assert jobs.run_shard_stream(spark, str(src), out, ck, process, group_size=2, settle_seconds=0.1).count() == 0
    _tar(str(src / "0.tar"), _samples(4, seed=99, prefix="late-"))
    more = jobs.run_shard_stream(spark, str(src), out, ck, process, group_size=2, settle_seconds=0.1).collect()
    assert [(r.output, r.n_rows) for r in more] == [("shard_004", 4)]
    assert len(_written(spark, out)) == 46


def test_stream_reader_offsets(tmp_path):
    for i in range(5):
        _tar(str(tmp_path / f"{i}.tar"), _samples(2, seed=i))
        os.utime(tmp_path / f"{i}.tar", ns=(0, 1000 * (i // 2)))  # ties in time
    make = lambda: sh._ShardStreamReader(str(tmp_path), ".tar", 1 << 20, None, 0, 2, str(tmp_path / "p" / "at.json"))
    r = make()
    seen, at = [], r.initialOffset()
    for _ in range(4):
        end = r.latestOffset()
        seen.append([os.path.basename(s[0]) for p in r.partitions(at, end) for s in p.splits])
        at = end
    assert seen == [["0.tar", "1.tar"], ["2.tar", "3.tar"], ["4.tar"], []]
    assert make().latestOffset() == at  # a restarted reader never goes back


def test_stream_of_many_groups_a_batch(spark, tmp_path):
    """Folders of at most ``group_size`` shards, several written by one micro-batch and numbered on by the next; a batch that fails is redone."""
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for i in range(9):
        _tar(str(src / f"{9 - i}.tar"), _samples(6, seed=i, prefix=f"b{i}-"))
        time.sleep(0.02)
    calls, broken = [], [True]

    def process(samples):
        calls.append(1)
        if len(calls) == 2 and broken:
            raise RuntimeError("lost")
        return samples.select("key", "output")

    run = lambda: jobs.run_shard_stream(spark, str(src), out, ck, process, group_size=2, settle_seconds=0.1, groups_at_once=3).collect()
    with pytest.raises(Exception, match="lost"):
        run()
    assert sorted(os.listdir(out)) == ["shard_000", "shard_001", "shard_002"]
    broken.clear()
    assert [(r.output, r.n_rows) for r in run()] == [("shard_003", 12), ("shard_004", 6)] and len(calls) == 3
    _tar(str(src / "0.tar"), _samples(4, seed=99, prefix="late-"))
    assert [(r.output, r.n_rows) for r in run()] == [("shard_005", 4)] and run() == []
    for g, i in (("shard_000", [0, 1]), ("shard_004", [8])):
        want = sorted(k for j in i for k, _ in _samples(6, seed=j, prefix=f"b{j}-"))
        assert sorted(r.key for r in spark.read.schema("key string").json(f"{out}/{g}").collect()) == want
        assert os.path.exists(f"{out}/{g}/_SUCCESS")
    assert len(_written(spark, out)) == 58


def test_stream_reader_lists_once_for_many_batches(tmp_path, monkeypatch):
    for i in range(30):
        _tar(str(tmp_path / f"{i:02d}.tar"), _samples(1, seed=i))
    r = sh._ShardStreamReader(str(tmp_path), ".tar", 1 << 20, None, 0, 5, str(tmp_path / "p" / "at.json"), 2, "output")
    listed, old = [], r._listed
    monkeypatch.setattr(r, "_listed", lambda: listed.append(1) or old())
    at, tags = r.initialOffset(), []
    for _ in range(6):
        end = r.latestOffset()
        tags += [[s[3] for p in r.partitions(at, end) for s in p.splits]]
        at = end
    assert len(listed) == 1 and tags[1] == ["shard_003", "shard_003", "shard_004", "shard_004", "shard_005"] and at["groups"] == 18


def test_incremental_groups_written_together(spark, tmp_path):
    """Many groups by few jobs: same folders, rows and manifest as group by group; a group without rows has its folder too."""
    for i in range(11):
        _tar(str(tmp_path / f"{i:02d}.tar"), _samples(5, seed=i, prefix=f"b{i}-"))
    listing = sh.list_shards(spark, str(tmp_path), sort=False)
    runs = []

    def one(paths):
        return sh.read_shards(spark, listing.join(paths.select("path"), "path")).where("shard not in ('04.tar', '05.tar')").select("key")

    def many(paths):
        runs.append(1)
        rows = sh.read_shards(spark, listing.join(paths.select("path", "output"), "path"), tag="output")
        return rows.where("shard not in ('04.tar', '05.tar')").select("key", "output")

    first = listing.where("path not like '%07.tar'")
    got = {}
    for name, fn, at_once in (("one", one, 1), ("many", many, 4)):
        out = str(tmp_path / name)
        got[name] = [[tuple(r) for r in fs.run_incremental(spark, seen, out, fn, group_size=2, groups_at_once=at_once).collect()] for seen in (first, listing, listing)]
        got[name] += [sorted((r.path, r.group_id) for r in spark.read.parquet(f"{out}/_manifest").collect())]
        got[name] += [{g: sorted(r.key for r in spark.read.schema("key string").json(f"{out}/{g}").collect()) for g in sorted(os.listdir(out)) if g[0] == "s"}]
    assert got["one"] == got["many"] and len(runs) == 3
    assert got["many"][0] == [("shard_000", 10), ("shard_001", 10), ("shard_002", 0), ("shard_003", 10), ("shard_004", 10)] and got["many"][1] == [("shard_005", 5)]


def test_what_a_task_gets_of_a_scan_does_not_grow_with_the_shards(spark, tmp_path):
    import pickle

    paths = [str(tmp_path / f"{i:03d}.tar") for i in range(150)]
    for i, p in enumerate(paths):
        _tar(p, _samples(2, seed=i, prefix=f"b{i}-"))
    df = sh.read_shards(spark, paths)
    assert df.count() == 300
    name, at = sh._splits_option(spark, [[p, 0, None, 1] for p in paths])
    reader = sh._ShardReader(at, 1, None)
    assert name == "splitsFile" and len(pickle.dumps(reader)) < 2000 and len(reader.partitions()) == 150
    assert len(pickle.dumps(reader)) < 2000


def test_a_task_reads_and_writes_a_few_megabytes_at_a_time(tmp_path):
    import pyarrow as pa

    p = str(tmp_path / "big.tar")
    _tar(p, [(f"{i:05d}", {"bin": bytes(100_000)}) for i in range(200)])
    batches = list(sh._record_batches([(p, 0, None, None)], None))
    assert sum(len(b) for b in batches) == 200 and max(b.nbytes for b in batches) < 2 * sh._BATCH_BYTES
    w = sh._ShardWriter(str(tmp_path / "out"), False)
    assert isinstance(w, sh.DataSourceArrowWriter)
    w.commit([w.write(iter([pa.RecordBatch.from_arrays([b.column(1), b.column(2)], ["key", "members"]) for b in batches]))])
    back = list(sh._read_tar(str(tmp_path / "out" / "shard-000000-000.tar")))
    assert [(k, len(m["bin"])) for _, k, m in back] == [(f"{i:05d}", 100_000) for i in range(200)]
