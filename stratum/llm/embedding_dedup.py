"""Operator 9: embedding near-dedup by cover trees and dual traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import connected_components, join_groups, materialise

#: Vectors of one block; a task joins two blocks.
BLOCK_ROWS = 8192
#: Vectors that the top of the tree is chosen from, and its most cells: what is broadcast is bounded by them.
TOP_SAMPLE = 4096
TOP_CELLS = 256
#: Covering radii of the levels below the root, each half of the one above. The root covers all unit vectors (radius 2); a level of
#: radius 1 is left out, since node pairs that wide are never far enough apart to be left.
RADII = (0.5, 0.25, 0.125, 0.0625)
_ROWS = 512
_SLACK = 1e-9


def unit(vector) -> np.ndarray | None:
    """The vector scaled to length 1 in double precision; None if null, empty, zero or with null or non-finite parts."""
    if vector is None or len(vector) == 0 or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centres, each the point farthest from those before: their prefixes are nets of falling radii."""
    chosen, far = [0], np.sqrt(np.maximum(0, 2 - 2 * x @ x[0]))
    while len(chosen) < min(k, len(x)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * x @ x[chosen[-1]])))
    return x[chosen]


def _net(x: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """Cells of ``rows``, each led by its centre: centres are over ``radius`` apart and every row is within it of its centre."""
    near, cells, left = 1 - radius * radius / 2, [], rows
    while len(left):
        head = left[:256]
        cos = x[head] @ x[head].T
        picked: list[int] = []
        for i in range(len(head)):
            if not picked or cos[i, picked].max() < near:
                picked.append(i)
        cos = x[left] @ x[head[picked]].T
        best = cos.argmax(1)
        best[picked] = np.arange(len(picked))
        member = np.ones(len(left), bool)
        member[picked] = False
        inside = (cos[np.arange(len(left)), best] >= near) | ~member
        order = np.lexsort((member[inside], best[inside]))
        own, at = left[inside][order], best[inside][order]
        cells += np.split(own, np.flatnonzero(np.diff(at)) + 1)
        left = left[~inside]
    return cells


def cover_paths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, path) of each row of a cover tree: the place in the tree's order and the number of its node on each level.

    Levels are nested; a node's first row is its centre, which leads one of the nodes below it too. A node of one row stays
    alone on all levels below."""
    place, path = np.zeros(len(x), np.int64), np.zeros((len(x), len(RADII)), np.int32)
    cells = [np.arange(len(x))]
    for level, radius in enumerate(RADII):
        below: list[np.ndarray] = []
        for c in cells:
            below += [c] if len(c) == 1 else _net(x, c, radius)
        for k, c in enumerate(below):
            path[c, level] = k
        cells = below
    order = np.concatenate(cells) if cells else np.zeros(0, int)
    place[order] = np.arange(len(order))
    return place, path


@dataclass
class Tree:
    """A block's vectors in tree order. Level k has nodes of rows [start, end) with the centre first and their true radius;
    the last level has one node per row."""

    x: np.ndarray
    weight: np.ndarray
    starts: list[np.ndarray]
    ends: list[np.ndarray]
    radii: list[np.ndarray]

    @staticmethod
    def of(x: np.ndarray, weight: np.ndarray, path: np.ndarray) -> Tree:
        starts, ends, radii = [], [], []
        for level in range(path.shape[1]):
            cut = np.flatnonzero(np.concatenate(([True], path[1:, level] != path[:-1, level])))
            end = np.append(cut[1:], len(x))
            lead = np.repeat(cut, end - cut)
            off = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[lead])))
            off[cut] = 0
            starts.append(cut), ends.append(end), radii.append(np.maximum.reduceat(off, cut))
        each = np.arange(len(x))
        return Tree(x, weight, [*starts, each], [*ends, each + 1], [*radii, np.zeros(len(x))])

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        a = np.searchsorted(self.starts[level + 1], self.starts[level][nodes])
        b = np.searchsorted(self.starts[level + 1], self.ends[level][nodes])
        return np.concatenate([np.arange(i, j) for i, j in zip(a, b)])


class DualJoin:
    """All pairs of two trees (or of one) with cosine of at least ``least``: ``counts`` sums the weights of each row's partners,
    ``label`` names the components among the rows of both trees."""

    def __init__(self, a: Tree, b: Tree | None, least: float):
        self.a, self.b, self.same, self.least = a, b if b is not None else a, b is None, least
        self.reach = np.sqrt(2 - 2 * least)
        self.counts = [np.zeros(len(a.x), np.int64), np.zeros(0 if self.same else len(b.x), np.int64)]
        self.shift = 0 if self.same else len(a.x)
        self.label = np.arange(len(a.x) + len(self.counts[1]))
        if len(a.x) and len(self.b.x):
            roots = np.arange(len(a.starts[0]))
            self._walk(0, roots, roots if self.same else np.arange(len(self.b.starts[0])))

    def _walk(self, level: int, na: np.ndarray, nb: np.ndarray) -> None:
        a, b = self.a, self.b
        one_a, one_b = a.ends[level][na] - a.starts[level][na] == 1, b.ends[level][nb] - b.starts[level][nb] == 1
        rows_a, rows_b = a.starts[level][na[one_a]], b.starts[level][nb[one_b]]
        centres, half = b.x[rows_b], self.same and na is nb
        for k in range(0, len(rows_a), _ROWS):
            begin = k if half else 0  # rows against themselves: each pair once, counted both ways
            i, j = np.nonzero(a.x[rows_a[k:k + _ROWS]] @ centres[begin:].T >= self.least)
            if half:
                i, j = i[i < j], j[i < j]
                self._pairs(rows_b[begin + j], rows_a[k + i])
            self._pairs(rows_a[k + i], rows_b[begin + j])
        if not one_b.all():
            self._wide(level, na, nb[~one_b])
        if not one_a.all() and one_b.any():
            self._wide(level, na[~one_a], nb[one_b])

    def _wide(self, level: int, na: np.ndarray, nb: np.ndarray) -> None:
        """Node pairs of which at least one has several rows: left by the covering radii, counted whole, or opened."""
        a, b = self.a, self.b
        sa, sb, ra, rb = a.starts[level], b.starts[level], a.radii[level], b.radii[level]
        for k in range(0, len(na), _ROWS):
            part = na[k:k + _ROWS]
            far = np.sqrt(np.maximum(0, 2 - 2 * a.x[sa[part]] @ b.x[sb[nb]].T))
            both = ra[part][:, None] + rb[nb][None, :]
            open_ = far <= self.reach + both + _SLACK
            whole = far + both <= self.reach - _SLACK
            for i in np.flatnonzero(open_.any(1)):
                if whole[i].any():
                    for j in nb[whole[i]]:
                        self._whole(slice(sa[part[i]], a.ends[level][part[i]]), slice(sb[j], b.ends[level][j]))
                rest = nb[open_[i] & ~whole[i]]
                if len(rest):
                    self._walk(level + 1, a.children(level, part[i:i + 1]), b.children(level, rest))

    def _pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.same:
            i, j = i[i != j], j[i != j]
        if not len(i):
            return
        self.counts[0] += np.bincount(i, self.b.weight[j], len(self.a.x)).astype(np.int64)
        if not self.same:
            self.counts[1] += np.bincount(j, self.a.weight[i], len(self.b.x)).astype(np.int64)
        self._join(i, j + self.shift)

    def _whole(self, a: slice, b: slice) -> None:
        rows_a, rows_b = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
        self.counts[0][a] += self.b.weight[b].sum()
        if self.same:
            if a == b:
                self.counts[0][a] -= self.a.weight[a]
            elif a.start < b.stop and b.start < a.stop:
                raise AssertionError("nodes of one level overlap")
        else:
            self.counts[1][b] += self.a.weight[a].sum()
        self._join(rows_a, np.full(len(rows_a), rows_b[0] + self.shift))
        self._join(np.full(len(rows_b), rows_a[0]), rows_b + self.shift)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[i], label[j]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _read(vectors: DataFrame) -> DataFrame:
    """(_id, dim, sig, unit) of (_id, _vec) rows; the last three null for vectors that link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [unit(v) for v in b.column(1).to_pylist()]
            raw = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if u is None else len(u) for u in units], pa.int32()),
                 pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                ["_id", "dim", "sig", "unit"])

    return vectors.mapInArrow(run, f"_id {vectors.schema['_id'].dataType.simpleString()}, dim int, sig binary, unit binary")


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: ``id_col``, n_links (other rows linked directly), component_id (smallest id reachable by links,
    its own included), kept (id = component_id).

    Rows are linked when their cosine in double precision is ``least`` or more; all such pairs count and no others.
    Equal vectors form one class with a weight, so copies take no further work.
    1. The top of the tree: centres chosen farthest first from a bounded sample; every vector goes to its nearest
       centre's cell. Cells are cut into blocks of about ``block_rows``, so a crowded cell is spread.
    2. A cover tree per block (nested levels, halving radii), built once.
    3. A vector is sent to the blocks whose cell's covering radius it can reach, and a task joins two blocks by
       traversing both trees: node pairs are left when the centres are farther than the radii allow, counted
       whole when all their pairs must be near, and opened otherwise; rows are compared in double precision.
    4. Partial counts are summed, and components found over a spanning set of each task's links.

    Without structure in the vectors nothing can be left out and the work is that of all pairs of blocks. Null, empty or zero vectors and
    those with null or non-finite parts link with nothing; vectors of different lengths don't link. Rows that repeat an id are rows of
    their own. An empty table gives an empty result. A null id alone has component_id and kept null."""
    rows = materialise(_read(vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))), "op9-units")
    classes = materialise(rows.where("sig is not null").groupBy("sig").agg(
        F.min("_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
        .withColumn("cid", F.monotonically_increasing_id()), "op9-classes")
    tops: dict[int, np.ndarray] = {}
    for dim, n in sorted(classes.groupBy("dim").count().collect()):
        rate = min(1.0, TOP_SAMPLE / n)
        pick = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("sig"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1))
        sample = [bytes(r[0]) for r in pick.orderBy("sig").limit(2 * TOP_SAMPLE).select("unit").collect()]
        tops[dim] = farthest_first(_matrix(sample), min(TOP_CELLS, -(-n // block_rows))) if sample else np.eye(1, dim)

    def place(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            cell, off = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim, part in pdf.groupby("dim"):
                cos = _matrix(part["unit"]) @ tops[dim].T
                at = pdf.index.get_indexer(part.index)
                cell[at] = cos.argmax(1)
                off[at] = np.sqrt(np.maximum(0, 2 - 2 * cos.max(1)))
            yield pdf.assign(cell=cell, off=off)

    kind = "sig binary, rep {}, w bigint, dim int, unit binary, cid bigint, cell int, off double".format(classes.schema["rep"].dataType.simpleString())
    placed = materialise(classes.select("sig", "rep", "w", "dim", "unit", "cid").mapInPandas(place, kind), "op9-cells")
    blocks: list[tuple[int, int, float]] = []
    first: dict[tuple[int, int], tuple[int, int]] = {}
    for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).orderBy("dim", "cell").collect():
        first[r["dim"], r["cell"]] = (len(blocks), -(-r["n"] // block_rows))
        blocks += [(r["dim"], r["cell"], r["r"])] * first[r["dim"], r["cell"]][1]
    spots = F.create_map(*[F.lit(x) for (d, c), (at, _) in first.items() for x in (d * 65536 + c, at)]) if first else F.create_map().cast("map<int,int>")
    cuts = F.create_map(*[F.lit(x) for (d, c), (_, k) in first.items() for x in (d * 65536 + c, k)]) if first else F.create_map().cast("map<int,int>")
    cell_key = F.col("dim") * 65536 + F.col("cell")
    blocked = placed.withColumn("block", (F.element_at(spots, cell_key) + F.pmod(F.xxhash64("sig"), F.element_at(cuts, cell_key))).cast("int"))

    def grow(key, pdf):
        pdf = pdf.sort_values("sig", kind="stable", ignore_index=True)
        at, path = cover_paths(_matrix(pdf["unit"]))
        return pdf[["cid", "w", "dim", "unit", "block"]].assign(place=at, path=[p.tobytes() for p in path])

    trees = materialise(blocked.select("sig", "cid", "w", "dim", "unit", "block").groupBy("block")
                        .applyInPandas(grow, "cid bigint, w bigint, dim int, unit binary, block int, place bigint, path binary"), "op9-trees")
    reach = float(np.sqrt(2 - 2 * least))

    def send(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner = np.array([(d, c) for d, c, _ in blocks], np.int64).reshape(-1, 2)
        radius = np.array([r for *_, r in blocks])
        for pdf in pdfs:
            for dim, part in pdf.groupby("dim"):
                own = np.flatnonzero(owner[:, 0] == dim)
                centres = tops[dim][owner[own, 1]]
                for k in range(0, len(part), 1024):
                    some = part.iloc[k:k + 1024]
                    far = np.sqrt(np.maximum(0, 2 - 2 * _matrix(some["unit"]) @ centres.T))
                    near = far <= radius[own][None, :] + reach + 1e-6
                    near |= own[None, :] == some["block"].to_numpy()[:, None]
                    i, j = np.nonzero(near)
                    out = some.iloc[i].reset_index(drop=True)
                    yield out.assign(a=np.minimum(out["block"], own[j]).astype(np.int32), b=np.maximum(out["block"], own[j]).astype(np.int32))

    sent = trees.mapInPandas(send, "cid bigint, w bigint, dim int, unit binary, block int, place bigint, path binary, a int, b int")

    def join(key, pdf):
        sides = []
        for block in dict.fromkeys(key):
            side = pdf[pdf["block"] == block].sort_values("place")
            tree = Tree.of(_matrix(side["unit"]), side["w"].to_numpy(), np.stack([np.frombuffer(p, np.int32) for p in side["path"]])) if len(side) else None
            sides.append((side["cid"].to_numpy(), tree))
        if any(t is None for _, t in sides):
            return pd.DataFrame({"x": [], "y": [], "n": []}).astype("int64")
        done = DualJoin(sides[0][1], sides[1][1] if len(sides) > 1 else None, least)
        cid, counts = np.concatenate([c for c, _ in sides]), np.concatenate(done.counts)
        hit = counts > 0
        return pd.DataFrame({"x": cid[hit], "y": cid[done.label][hit], "n": counts[hit]})

    found = materialise(sent.groupBy("a", "b").applyInPandas(join, "x bigint, y bigint, n bigint"), "op9-links")
    comps = connected_components(found.where("x <> y"), "x", "y")
    sums = found.groupBy("x").agg(F.sum("n").alias("n")).withColumnRenamed("x", "cid")
    named = placed.select("cid", "sig", "rep", "w").join(sums, "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("component", F.coalesce("component", "cid"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = join_groups(named, materialise(low, "op9-low"), ["component"], "_n", F.col("cid")) \
        .select("sig", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = join_groups(rows.select("_id", "sig"), materialise(named, "op9-named"), ["sig"], "w", F.col("_id"))
    component = F.when(F.col("sig").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), (F.col("_id") == component).alias("kept"))
