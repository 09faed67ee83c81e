import os
import random
import time

from pyspark.sql import functions as F

from stratum.llm import common as C


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_FLOOR", 5)
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, 501 + i) for i in range(60)] + [(7, 7)]
    up = {x: x for p in pairs for x in p if p[0] != p[1]}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = C.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in up)
    assert C.connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_components_end_once_the_edges_are_stars(spark, monkeypatch):
    """Stars need no round: their minima are written, nothing is joined and no job only counts."""
    labels, sizes = [], []
    write, join = C.materialise, C.join_groups
    monkeypatch.setattr(C, "materialise", lambda df, label: (labels.append(label), write(df, label))[1])
    monkeypatch.setattr(C, "join_groups", lambda *a: (sizes.append(a[5]), join(*a))[1])
    for pairs, rounds in (([(1, 2), (3, 1), (1, 4), (9, 8), (8, 9), (None, 5), (5, 5)], 0), ([(i, i + 1) for i in range(4)], 1)):
        labels.clear()
        sizes.clear()
        got = C.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()
        want = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)] if rounds else [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
        assert sorted(map(tuple, got)) == want
        assert len(sizes) >= 2 * rounds and all(total >= most > 0 for total, most in sizes)
        assert rounds or labels == ["cc", "cc-min"]


def test_small_graphs_take_few_tasks(spark, monkeypatch):
    """However many partitions a shuffle has, a round's tables come from no more tasks than their rows need."""
    write, tasks = C.materialise, []

    def counted(df, label):
        tasks.append((label, df.rdd.getNumPartitions()))
        return write(df, label)

    monkeypatch.setattr(C, "materialise", counted)
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = C.connected_components(spark.createDataFrame([(i, i + 1) for i in range(4)], "a bigint, b bigint"), "a", "b").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(5)]
    assert len(tasks) > 3 and all(n <= spark.sparkContext.defaultParallelism for _, n in tasks[1:]), tasks


def test_join_groups_with_and_without_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(600)] + [(9000, None)], "id bigint, k string")
    groups = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = sorted(rows.join(groups, "k", "left").select("id", "k", "n", "top").collect(), key=str)
    for floor in (10, 10_000):
        monkeypatch.setattr(C, "HOT_FLOOR", floor)
        got = C.join_groups(rows, groups, ["k"], "n", F.col("id")).select("id", "k", "n", "top").collect()
        assert sorted(got, key=str) == want


def test_hot_rows_are_dealt_by_the_salt(spark, monkeypatch):
    """The small side's salt must not fold into a constant: the rows' exchange has to hash it too."""
    monkeypatch.setattr(C, "HOT_FLOOR", 10)
    rows = C.materialise(spark.range(400).selectExpr("if(id < 200, 0, id) as k", "id"), "test-rows")
    groups = C.materialise(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "test-groups")
    out = C.join_groups(rows, groups, ["k"], "n", F.col("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and all("_salt" in line for line in dealt), plan
    assert sorted((r["id"], r["n"]) for r in out.collect()) == [(i, 200 if i < 200 else 1) for i in range(400)]


def test_freed_memory_is_given_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    C.give_back()
    before = held()
    blocks = [bytes(4000) for _ in range(20_000)]
    assert held() - before > 60_000_000
    del blocks[:-1]  # the last one keeps the heap from shrinking at its end
    C.give_back()
    assert held() - before < 20_000_000


def test_a_written_table_leaves_no_shuffle_files(spark):
    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in list(where) for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(C.SHUFFLE_CLEANUP, None)
    out = C.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # files are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7 and spark.conf.get(C.SHUFFLE_CLEANUP, None) == setting
