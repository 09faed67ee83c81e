from collections import Counter

from stratum.llm.sharding import bounded_flow, moved_rows, ring_owners, shard_documents


def test_counts_slots_and_every_row_once(frame):
    rows = [(i, f"t{i}") for i in range(1003)] + [(7, "again"), (7, "again"), (None, "n"), (None, None)]
    got = shard_documents(frame(rows), 16).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    size = Counter(r["shard"] for r in got)
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 1
    for s, n in size.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_fewer_rows_than_shards_and_empty(frame):
    got = shard_documents(frame([(1, "a"), (2, "b")]), 16).collect()
    assert len(got) == 2 and [r["slot"] for r in got] == [0, 0] and len({r["shard"] for r in got}) == 2
    assert shard_documents(frame([]), 16).collect() == []


def test_ring_keeps_its_nodes_when_it_grows():
    small, large = dict(ring_owners(16)), dict(ring_owners(17))
    assert all(large[c] in (s, 16) for c, s in small.items())


def test_full_shard_overflows_clockwise():
    ring = ring_owners(2, 1, 8)
    first = ring[0]
    flow = bounded_flow({first[0]: 4}, 2, 1, 8)
    assert flow[0][3] == first[1] and flow[0][1:3] == (0, 2) and flow[1][3] != first[1] and flow[1][1:3] == (2, 4)


def test_growing_moves_fewer_rows_than_dealing_anew(frame):
    r = moved_rows(frame([(i, "t") for i in range(4000)]), 16, 17).first()
    assert r["rows"] == 4000 and r["moved"] < 0.6 * 4000
