import io
import os
import tarfile
import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from stratum.sources import files as fs
from stratum.sources import shards as sh


def test_split_member_rule():
    assert sh.split_member("a/b/123.json") == ("a/b/123", "json")
    assert sh.split_member("x.seg.tar.gz") == ("x", "seg.tar.gz")


def _make_tar(path, members):
    with tarfile.open(path, "w") as tf:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))


def test_read_groups_members_by_stem(spark):
    d = tempfile.mkdtemp(prefix="stratum-test-")
    p = os.path.join(d, "s.tar")
    _make_tar(p, [("1.json", b'{"text":"a"}'), ("1.mp3", b"\x00\x01"), ("2.json", b'{"text":"b"}'),
                  ("2.tar.gz", b"zz")])
    rows = sh.shard_samples(sh.read_shards(spark, [p]), "text string", audio_ext="mp3").orderBy("key").collect()
    assert [r.key for r in rows] == ["1", "2"]
    assert rows[0].json.text == "a" and bytes(rows[0].audio) == b"\x00\x01"
    assert set(rows[1].members) == {"json", "tar.gz"} and rows[1].audio is None


def test_write_read_roundtrip_min_rows(spark):
    d = tempfile.mkdtemp(prefix="stratum-test-")
    df = spark.range(95).select(F.col("id").cast("string").alias("key"),
                                F.create_map(F.lit("txt"), F.encode(F.col("id").cast("string"), "UTF-8"))
                                .alias("members"))
    n = sh.write_shards(df, d, 20)
    listing = sh.list_shards(spark, d).collect()
    assert n == 4 and len(listing) == 4
    back = sh.read_shards(spark, [r.path for r in listing])
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert min(counts) >= 20 and sum(counts) == 95
    assert sorted(int(r.key) for r in back.select("key").collect()) == list(range(95))
    assert not [f for f in os.listdir(d) if f.startswith("._tmp")]


def test_checksum_rows(spark):
    df = spark.createDataFrame([("abc", "ba7816bf"), ("abc", "00")], "c string, e string")
    out = fs.verify_checksum(df, "c", "e").collect()
    assert [r.ok for r in out] == [True, False]


def test_tokenise_series_job_writes_jsonl(spark):
    import numpy as np

    from stratum.plans.jobs import tokenise_series_job

    rng = np.random.default_rng(0)
    rows = [(sid, i, float(v)) for sid in range(3) for i, v in enumerate(rng.normal(size=40 + 10 * sid))]
    rows += [(9, i, 1.0) for i in range(5)]  # too short: dropped before framing
    series = spark.createDataFrame(rows, "series_id long, pos int, value double")
    out = tempfile.mkdtemp(prefix="stratum-j2-")
    n = tokenise_series_job(series, out, frame_len=8, hop=4, min_samples=32, n_codes=4, kmeans_iters=2)
    back = spark.read.json(out).orderBy("series_id").collect()
    assert n == 1 and [r.series_id for r in back] == [0, 1, 2]
    assert [len(r.codes) for r in back] == [9, 11, 14] and all(0 <= c < 4 for r in back for c in r.codes)


def test_quality_filter_job_writes_enriched_shards(spark):
    import json as js

    from stratum.functions.batch_udf import make_stub_recogniser
    from stratum.plans.jobs import quality_filter_job

    d = tempfile.mkdtemp(prefix="stratum-j1-")
    texts = {"1": "abcdefghij" * 20, "2": "eeee eeee eeee", "3": "no change here"}
    _make_tar(os.path.join(d, "a.tar"), [(f"{k}.json", js.dumps({"text": t}).encode()) for k, t in texts.items()]
              + [("1.mp3", b"\x01")])
    out = os.path.join(d, "out")
    n = quality_filter_job(spark, [os.path.join(d, "a.tar")], out, make_stub_recogniser, min_rows_per_file=1)
    # "1": 20 e's of 200 chars -> 10.0, not kept (strict); "2": all e's -> 100.0; "3": 3 of 12 -> 25.0
    assert n == 0 and not os.path.exists(out)
    texts2 = {"4": "abcdefghijklmnopqrstuvwxyz" * 4}  # 4 e's in 104 chars -> 3.85, kept
    _make_tar(os.path.join(d, "b.tar"), [("4.json", js.dumps({"text": texts2["4"]}).encode()), ("4.mp3", b"\x02")])
    out2 = os.path.join(d, "out2")
    quality_filter_job(spark, [os.path.join(d, "b.tar")], out2, make_stub_recogniser, min_rows_per_file=1)
    back2 = sh.shard_samples(sh.read_shards(spark, [r.path for r in sh.list_shards(spark, out2).collect()]),
                             "text string, pred string, cer double", audio_ext="mp3").collect()
    assert len(back2) == 1 and back2[0].json.cer == 3.85 and back2[0].json.pred == texts2["4"].replace("e", "")
    assert bytes(back2[0].audio) == b"\x02"


def test_pack_corpus_job(spark):
    from stratum.plans.jobs import pack_corpus_job

    rows = spark.createDataFrame([(i, list(range(i + 1)), list(range(i + 1))) for i in range(30)],
                                 "seq_id long, input_ids array<bigint>, labels array<bigint>")
    out = tempfile.mkdtemp(prefix="stratum-j3-")
    packs = pack_corpus_job(rows, os.path.join(out, "p"), capacity=64, n_buckets=2).collect()
    assert sum(r.n_rows for r in packs) == 30
    assert sum(len(r.input_ids) for r in packs) == sum(i + 1 for i in range(30))
    assert max(len(r.input_ids) for r in packs) <= 64


def test_recogniser_runs_once_per_sample_and_records_stay_whole(spark, tmp_path):
    import json

    from stratum.plans.jobs import quality_filter_job
    from stratum.sources import shards as sh

    calls = str(tmp_path / "calls")
    os.makedirs(calls)

    def make():
        def predict(batch):
            for x in batch:
                open(f"{calls}/{uuid.uuid4().hex}", "w").close()
            return np.array([bytes(x).decode() for x in batch], dtype=object)

        return predict

    meta = [{"text": f"text {i}", "lang": "é", "n": i, "deep": {"a": [1, None, "x"]}, "pred": "old"} for i in range(40)]
    rows = spark.createDataFrame([(str(i), {"json": json.dumps(m).encode(), "mp3": (m["text"] if i % 2 else "quite another").encode()})
                                  for i, m in enumerate(meta)], "key string, members map<string,binary>")
    sh.write_shards(rows, str(tmp_path / "in"), 10)
    n = quality_filter_job(spark, sh.list_shards(spark, str(tmp_path / "in")), str(tmp_path / "out"), make, input_member="mp3", min_rows_per_file=7)
    back = {r["key"]: r["members"] for r in sh.read_shards(spark, sh.list_shards(spark, str(tmp_path / "out"))).collect()}
    assert len(os.listdir(calls)) == 40 and n == 2 and sorted(map(int, back)) == list(range(1, 40, 2))
    for k, members in back.items():
        want = meta[int(k)] | {"pred": f"text {k}", "cer": 0.0}
        assert json.loads(bytes(members["json"])) == want and bytes(members["mp3"]).decode() == f"text {k}"


def test_overwrite_minimum_rows_and_equal_bytes(spark, tmp_path):
    from stratum.sources import files as fs
    from stratum.sources import shards as sh

    rows = spark.createDataFrame([(f"{i:03d}", {"txt": b"x" * i}) for i in range(101)], "key string, members map<string,binary>")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path in (a, b, a):
        sh.write_shards(rows, path, 10, order_col="key", overwrite=True)
    names = sorted(os.listdir(a))
    assert names == sorted(os.listdir(b)) and "_SUCCESS" in names and len(names) == 11
    for x in names:
        with open(f"{a}/{x}", "rb") as f, open(f"{b}/{x}", "rb") as g:
            assert f.read() == g.read()
    sh.write_shards(rows.limit(2), a, 10, overwrite=True)
    assert sh.read_shards(spark, sh.list_shards(spark, a)).count() == 2
    fs.write_jsonl(rows.select("key"), str(tmp_path / "j"), 10)
    sizes = [sum(1 for _ in open(f"{tmp_path}/j/{x}")) for x in os.listdir(tmp_path / "j") if x.endswith(".json")]
    assert len(sizes) == 10 and min(sizes) >= 10 and sum(sizes) == 101


def test_one_more_row_changes_its_own_bucket_only(spark):
    from stratum.operators import packing as pk

    df = spark.range(500).selectExpr("id AS seq_id", "CAST(id * 37 % 900 + 1 AS INT) AS length")
    more = df.unionByName(spark.createDataFrame([(10_000, 77)], "seq_id long, length int"))
    a, b = ({(r["seq_id"], r["pack_id"]): r["bucket"] for r in pk.pack_next_fit(x, n_buckets=16).collect()} for x in (df, more))
    assert len({bucket for k, bucket in b.items() if k not in a}) == 1


def test_ranks_gather_apart_and_the_tail_is_reported(spark):
    from stratum.operators import packing as pk

    rows = spark.range(400).selectExpr("id AS seq_id", "sequence(1, CAST(id * 31 % 90 + 1 AS INT)) AS input_ids").selectExpr("*", "input_ids AS labels")
    packed, tail = pk.split_tail(pk.pack_multifit(rows.selectExpr("seq_id", "size(input_ids) AS length"), 4, capacity=100, n_buckets=3))
    packs = pk.materialise_packs(packed, rows, ["batch_id", "rank"]).collect()
    assert max(len(r["input_ids"]) for r in packs) <= 100 and sum(r["n_rows"] for r in packs) + tail.count() == 400
    batches = {}
    for r in packs:
        batches.setdefault(r["batch_id"], set()).add(r["rank"])
    assert batches and all(v == {0, 1, 2, 3} for v in batches.values())


def test_a_task_writes_many_json_files_of_even_size(spark, tmp_path):
    """n rows in n // 3 files of n // files rows or one more, by far fewer tasks than files; every row is in one file."""
    for n in (0, 1, 5, 12, 2000):
        out = str(tmp_path / str(n))
        files = fs.write_jsonl(spark.range(n).withColumn("é", F.lit("ü")), out, 3)
        names = [f for f in os.listdir(out) if f.endswith(".json")]
        counts = [sum(1 for _ in open(os.path.join(out, f))) for f in names]
        assert files == max(1, n // 3) and os.path.exists(f"{out}/_SUCCESS")
        if n:
            assert len(names) == files and set(counts) <= {n // files, n // files + 1} and sum(counts) == n
            assert len({f.split("-")[1] for f in names}) <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r.id for r in spark.read.schema("id long").json(out).collect()) == list(range(n))
