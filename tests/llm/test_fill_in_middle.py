import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import fill_in_middle as fim
from stratum.llm.fill_in_middle import BoundarySet, check_markers, cut_texts, restored
from stratum.llm.queries import QUERIES

UNITS = {"char": r"(?s:.)", "word": r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}


def units_of(text, unit):
    """Units of a text by regular expression; leading spaces are a unit of their own."""
    if unit == "word":
        lead = re.match(r"[ \t-\r]*", text).group()
        return ([lead] if lead else []) + re.findall(r"[^ \t-\r]+[ \t-\r]*", text[len(lead):])
    return re.findall(UNITS[unit], text)


def brute(doc_id, text, unit="char"):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = units_of(text, unit)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("density", [0.0, 0.0005, 0.3, 0.9, 1.0])
def test_select_and_rank_of_every_container_kind(density):
    rng = np.random.default_rng(3)
    flags = rng.random(200_000) < density
    flags[65_536:131_072] = np.arange(65_536) // 5000 % 2 == 0  # runs in the middle container
    s = BoundarySet(lambda lo, hi: flags[lo:hi], len(flags))
    at = np.flatnonzero(flags)
    assert s.select(np.arange(len(at) + 1)).tolist() == [*at.tolist(), len(flags)]
    assert s.rank(np.arange(len(flags) + 1)).tolist() == [0, *np.cumsum(flags).tolist()]


def test_containers_choose_the_smallest_form():
    kinds = [type(fim._container(m)).__name__ for m in (np.ones(fim.SPAN, bool), np.arange(fim.SPAN) % 500 == 0, np.arange(fim.SPAN) % 3 == 0)]
    assert kinds == ["_Runs", "_Array", "_Bitmap"]


def rows_of_all_kinds():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab é漢😀\n <PSM>") for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (None, None), (1002, "has <M> inside"), (1003, "<"), (1004, ">" * 50),
             (1005, "long é漢😀 text\n" * 40_000), (1006, "a" * 300_000), rows[3], rows[3], (1007, "﻿<\u0000x y")]
    return rows


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_against_brute_force(frame, unit):
    rows = rows_of_all_kinds()
    out = cut_texts(frame(rows), unit=unit)
    got = sorted((r for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()), key=str)
    want = sorted(((i, *brute(i, t, unit), t or "") for i, t in rows), key=lambda w: str(w))
    assert sorted(map(tuple, got), key=str) == want
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_empty_table(frame):
    assert cut_texts(frame([])).collect() == []


def test_markers_that_could_overlap_are_refused():
    for bad in (("<P>", "<S>", "<S>"), ("aba", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("<P>", "<P>y", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            check_markers(bad)
    check_markers(("[pre]", "[suf]", "[mid]"))


def test_other_markers_round_trip(frame):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = rows_of_all_kinds()
    out = cut_texts(frame(rows), markers=marks)
    back = out.select("doc_id", restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t in rows)


def test_query_against_brute_force(spark, frame, tmp_path):
    rows = rows_of_all_kinds()
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_fill_in_middle"](spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        n, form, p, m, o = brute(i, t)
        want.append((i, n, form, p, m, sha(o), sha(t or "")))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
