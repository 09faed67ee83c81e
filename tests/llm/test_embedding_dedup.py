import numpy as np
import pytest

from stratum.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, dim int, unit string"


def brute(rows, least=0.9):
    n = len(rows)
    units = [E.unit(v) for _, v in rows]
    hit = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                hit[i, j] = units[i] @ units[j] >= least
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(hit[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(rows[j][0] for j in range(n) if comp[j] == comp[i])
        out.append((d, int(hit[i].sum()), c, d == c))
    return sorted(out)


def vectors(seed, dim=16, n=150):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dim) for _ in range(n)]
    for size, noise in ((12, .05), (9, .12), (25, .1), (3, .02), (40, .3)):
        centre = rng.normal(size=dim)
        x += [centre + noise * np.linalg.norm(centre) / np.sqrt(dim) * 1.3 * rng.normal(size=dim) for _ in range(size)]
    x += [x[0], x[0], x[151], 3 * x[151], x[151]]
    rows = [[float(np.float32(v)) for v in r] for r in x]
    rows += [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * 3, [1.0, 1.0, 1.01], [float("inf")] * dim]
    return [(i * 2 + 1, r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [8192, 37])
def test_against_brute_force(spark, block):
    rows = vectors(block)
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df, block_rows=block).collect())
    assert got == brute(rows)


def test_cover_tree_levels():
    x = np.stack([E.unit(v) for _, v in vectors(3) if E.unit(v) is not None and len(v) == 16])
    place, path = E.cover_paths(x)
    order = np.argsort(place)
    tree = E.Tree.of(x[order], np.ones(len(x), np.int64), path[order])
    for level, radius in enumerate(E.RADII):
        assert (tree.radii[level] <= radius + 1e-9).all()
        assert set(tree.starts[level]) <= set(tree.starts[level + 1])
    for level in range(len(E.RADII)):
        assert (np.diff(tree.starts[level]) > 0).all() and tree.ends[level][-1] == len(x)


def test_whole_nodes_are_counted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in np.float32(np.ones(8) + 0.01 * rng.normal(size=8))]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    assert {(r["n_links"], r["component_id"]) for r in E.near_duplicates(df, block_rows=25).collect()} == {(59, 0)}


def test_empty_and_repeated_ids(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(4, [1.0, 0.0], 0, 0, ""), (4, [1.0, 0.0], 0, 0, ""), (None, [1.0, 0.0], 0, 0, ""), (2, [0.0, 1.0], 0, 0, ""), (None, None, 0, 0, "")], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, None), (2, 0, 2, True), (None, 0, None, None)], key=str)
