import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm import common, warc
from stratum.llm.queries import QUERIES
from stratum.llm.warc import coalesce_ranges, read_archives, read_record, write_archives, write_record

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("digest", T.StringType()), T.StructField("row_id", T.IntegerType()), T.StructField("_slot", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def brute(rows, least=1000):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    texts = [(h or "").encode() for _, _, h in rows]
    groups = {}
    for k, ((i, u, _), t) in enumerate(zip(rows, texts)):
        if len(t) >= least:
            groups.setdefault(t, []).append(((i is not None, i or 0, u or ""), k))
    winner = {t: max(g) for t, g in groups.items()}
    out = []
    for k, ((i, u, _), t) in enumerate(zip(rows, texts)):
        revisit = len(t) >= least and winner[t][1] != k
        out.append((i, len(t), hashlib.sha1(t).hexdigest(), "revisit" if revisit else "response",
                    rows[winner[t][1]][0] if revisit else None))
    return out


def result(out):
    return sorted((tuple(r) for r in out.select(F.col("row_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type",
                                                F.col("refers_to").cast("bigint")).collect()), key=str)


def rows_of_all_kinds():
    rng = random.Random(2)
    long = "<p>é漢 " * 300
    rows = [(i, f"http://h/{i}?a=b c", rng.choice(["", None, "short", long, long + "!", long * rng.randrange(2, 9), f"<p>{i}" * 400])) for i in range(300)]
    rows += [(1000 + i, f"http://copy/{i % 7}", "hot page " * 200) for i in range(200)]
    rows += [rows[3], rows[3], (1199, "http://copy/3", "hot page " * 200), (1199, "http://other", "hot page " * 200)]
    rows += [(None, None, "only nulls " * 200), (None, None, "only nulls " * 200), (None, "http://x", "hot page " * 200), (None, None, None)]
    rows += [(5000, "http://new\r\nline: x", "x" * 999), (5001, "", "x" * 999), (5002, None, "x" * 1000), (5003, "http://y", "x" * 1000)]
    rows += [(6000, "http://long", "very long é\n" * 200_000), (5999, "http://long2", "very long é\n" * 200_000)]
    return rows


def test_against_brute_force(spark):
    rows = rows_of_all_kinds()
    index = write_archives(frame(spark, rows), archive_bytes=20_000)
    out = read_archives(index)
    assert result(out) == sorted(brute(rows), key=str)
    by_text = Counter((r["row_id"], r["payload"]) for r in out.where("record_type = 'response'").collect())
    texts = {hashlib.sha1((h or "").encode()).hexdigest(): h or "" for _, _, h in rows}
    assert by_text == Counter((None if i is None else str(i), texts[d]) for i, _, d, kind, _ in brute(rows) if kind == "response")


def test_hot_payload_is_scattered_and_false_hits_are_settled(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_FLOOR", 10)
    monkeypatch.setattr(warc, "flag_slots", lambda n: 32768)
    monkeypatch.setattr(warc, "flag_slot", lambda *c, slots: common.flag_slot(*c, slots=2))  # nearly every row is a false hit
    rows = rows_of_all_kinds()
    assert result(read_archives(write_archives(frame(spark, rows)))) == sorted(brute(rows), key=str)


def test_archives_are_gzip_members_that_stand_alone(spark, tmp_path):
    rows = rows_of_all_kinds()[:40]
    index = write_archives(frame(spark, rows), folder=str(tmp_path / "a")).collect()
    assert {r["file"] for r in index} == {str(p) for p in (tmp_path / "a").iterdir()}
    ends = {}
    for r in sorted(index, key=lambda r: (r["file"], r["offset"])):
        assert r["offset"] == ends.get(r["file"], 0)
        ends[r["file"]] = r["offset"] + r["length"]
        data = open(r["file"], "rb").read()[r["offset"]:ends[r["file"]]]
        whole = gzip.decompress(data)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and whole.endswith(b"\r\n\r\n")
        assert read_record(data)["payload_digest"] == r["digest"] and read_record(data)["url"] == r["url"]
    ids = [line for r in index for line in gzip.decompress(open(r["file"], "rb").read()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(index)


def test_only_selected_records_are_read(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(500)]
    index = write_archives(frame(spark, rows), gzip=False)
    got = read_archives(index.where("url like '%7'")).collect()
    assert {r["payload"] for r in got} == {t for i, _, t in rows if i % 10 == 7}
    assert read_archives(index.where("url = 'none'")).collect() == []


def test_ranges_share_a_read_up_to_gap_and_size():
    entries = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 100, 5), ("a", 105, 50), ("b", 0, 500), ("b", 500, 1)]
    got = [(f, s, e, len(h)) for f, s, e, h in coalesce_ranges(iter(entries), gap=5, most=40)]
    assert got == [("a", 0, 25, 3), ("a", 100, 105, 1), ("a", 105, 155, 1), ("b", 0, 500, 1), ("b", 500, 501, 1)]
    assert list(coalesce_ranges(iter([]), 1, 1)) == []


def test_damage_is_found():
    row = {"record_type": "response", "row_id": "1", "url": "u", "digest": hashlib.sha1(b"other").hexdigest(), "copy": 0, "size": 4, "payload": "text",
           "to_id": None, "to_url": None}
    with pytest.raises(ValueError, match="damaged"):
        read_record(write_record(row, "2000-01-01T00:00:00Z", False))
    with pytest.raises(ValueError, match="no WARC record"):
        read_record(b"text")


def test_empty_table(spark):
    assert read_archives(write_archives(frame(spark, []))).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rows = rows_of_all_kinds()
    frame(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    out = QUERIES["op11_warc"](spark, str(tmp_path))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute(rows)))
