"""Operator 5: n-gram Jaccard join by prefix trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import connected_components, discard, flag_bitmap, flag_filter, flag_slot, flag_slots, give_back, join_groups, materialise, small_batches, text_or_empty, with_flag

#: Groups of candidates beyond this many rows are cut into blocks and joined block by block; a block's sets take about
#: GROUP_BYTES at most, whatever their length. A task holds two blocks and about as much again to join them.
GROUP_ROWS = 16_000
GROUP_BYTES = 24 << 20
#: Before groups of more bytes than this, a worker gives back what earlier ones have left.
GIVE_BACK = 1 << 20
#: Levels of a prefix tree: the range of the n-gram order is cut into this many parts.
LEVELS = 8
#: Block keys are counted in this many rounds, each a part of them, so only that part is in the shuffle at a time.
COUNT_ROUNDS = 4
#: A key is the more common the more of these counts it reaches.
COMMON = (2, 3, 4, 8, 32)
_WORDS = 100_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """n-grams of words as 64-bit numbers; their order as numbers is the global order of the join."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}

    def ngrams(self, text: str | None) -> np.ndarray:
        """Sorted distinct n-grams: words are runs without space or \\t to \\r, A-Z in lower case. A text of fewer than n words has its whole
        sequence as one n-gram, one without words none."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > _WORDS:
            self.known = {}
        codes = list(map(self.known.get, words))
        if None in codes:
            for w, c in zip(words, codes):
                if c is None:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
            codes = list(map(self.known.__getitem__, words))
        codes = np.array(codes, np.uint64)
        n = min(self.n, len(words))
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h = _mix((h + codes[k:len(codes) - n + 1 + k]) * _MIX[0] + np.uint64(k + 1))
        return np.unique(h)


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers throughout."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.floors = [1]

    def enough(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def needed(self, a: int, b: int) -> int:
        """The least overlap with which sets of a and b elements are similar."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def size_class(self, size: int) -> int:
        """Classes [f, floor(f / t)], so a set's partners of at least its size lie in its own class or the next one."""
        while self.floors[-1] <= size:
            self.floors.append(self.floors[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.floors, size, "right")) - 1

    def segments(self, k: int) -> tuple[int, int]:
        """(segments, spare) for pairs whose smaller set is of class k: similar sets differ in at most d elements, so of
        d + 1 + spare segments at least 1 + spare agree. (0, 0) if only equal sets are similar."""
        self.size_class(self.floors[-1] if len(self.floors) <= k + 1 else self.floors[k + 1])
        d = (self.floors[k + 1] - 1) * (self.den - self.num) // self.num
        return (d + 2 + d // 2, 1 + d // 2) if d else (0, 0)


def segment_keys(grams: np.ndarray, t: Threshold) -> np.ndarray:
    """The keys of a set's segments: a key is the whole content of one of the equal parts that the order's range is cut into. A set has
    keys for its own size class and then, as the larger partner, for the class below; each by number of elements, then by key."""
    if not len(grams):
        return np.zeros(0, np.int64)
    own, out = t.size_class(len(grams)), []
    mixed = _mix(grams + _MIX[0])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    for k in (own, own - 1):
        n, _ = t.segments(k) if k >= 0 else (0, 0)
        if not n:
            continue
        segment = ((grams >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)
        sizes = np.bincount(segment.astype(np.int64), minlength=n)
        ends = np.cumsum(sizes)
        sums = total[ends] - total[ends - sizes]
        keys = _mix(sums + _mix(np.arange(n, dtype=np.uint64) + np.uint64(k << 32) + _MIX[1]))
        out.append(keys[np.lexsort((keys, sizes))])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def chosen_keys(keys: np.ndarray, sizes: np.ndarray, t: Threshold, common: np.ndarray) -> np.ndarray:
    """Which of the ``segment_keys`` of sets of ``sizes`` elements, one set after another, are their block keys: two similar, unequal
    sets share at least one. ``common`` says how common each key is, by any rule that depends on nothing but the key.

    Every set leaves out the ``spare`` most common keys of a class (of equally common ones the first), which unlike sets with a
    common passage are most likely to share. Of the 1 + spare or more segments that two similar sets have in common, the last in this
    order has ``spare`` before it in both sets, so both keep it. Of keys that are not common at all (0), which may be given for any
    or none of the sets' keys, none is among those marked."""
    counts, spares = [], []
    for own in map(t.size_class, sizes.tolist()):
        for k in (own, own - 1):
            n, spare = t.segments(k) if k >= 0 else (0, 0)
            counts.append(n)
            spares.append(spare)
    at = np.flatnonzero(common)
    part = np.repeat(np.arange(len(counts)), counts)[at]
    order = np.lexsort((at, -common[at], part))
    first = np.searchsorted(part, np.arange(len(counts)))
    left = np.arange(len(at)) - first[part] < np.array(spares, np.int64)[part]
    marked = np.zeros(len(keys), bool)
    marked[at[order[~left]]] = True
    return marked


def block_keys(grams: np.ndarray, t: Threshold) -> np.ndarray:
    """Keys such that two similar, unequal sets share at least one, where nothing is known of how common they are."""
    keys = segment_keys(grams, t)
    return keys[chosen_keys(keys, np.array([len(grams)]), t, np.ones(len(keys), np.int8))]


class Parts:
    """Ordered n-gram sets cut into the LEVELS parts of the order's range. Equal parts of a level are kept once, their n-grams as
    consecutive numbers, one part after another. One level is sorted at a time, so beside the sets there is an eighth of them or less
    to work on and half of them to keep."""

    def __init__(self, sets: list[np.ndarray], cuts: np.ndarray, order: np.ndarray):
        """``cuts``: per set where each level's part begins and the last one ends; parts are numbered as they come in ``order``."""
        self.of = np.zeros((LEVELS, len(sets)), np.int32)  # the part that a set has on a level
        self.grams, self.at, self.width = [], [], []
        for level in range(LEVELS):
            known: dict[bytes, int] = {}
            for k in order.tolist():
                self.of[level, k] = known.setdefault(sets[k][cuts[k, level]:cuts[k, level + 1]].tobytes(), len(known))
            self.at.append(np.cumsum([0, *map(len, known)]) // 8)
            raw = np.frombuffer(b"".join(known), np.uint64)
            del known
            values = np.unique(raw)
            self.grams.append(np.searchsorted(values, raw).astype(np.int32))
            self.width.append(len(values))

    def part(self, level: int, row: int) -> np.ndarray:
        k = self.of[level, row]
        return self.grams[level][self.at[level][k]:self.at[level][k + 1]]


class PrefixTree:
    """A trie of some rows' sets; each level holds the part of a set in one LEVELS-th of the order's range, so sets that begin
    alike share nodes. Rows are sorted by their parts, so a node is a range of rows on its level. Their parts are the first ones."""

    def __init__(self, parts: Parts, rows: np.ndarray, sizes: np.ndarray, cuts: np.ndarray):
        """``sizes``, ``cuts``: of the ``rows`` only."""
        self.parts = parts
        of = parts.of[:, rows]
        self.grams = [parts.grams[level][:parts.at[level][of[level].max() + 1]] for level in range(LEVELS)]
        self.order = np.lexsort(of[::-1])
        new = np.zeros(len(rows), bool)
        self.first, self.last, self.parent, self.part, self.left, self.least = [], [], [], [], [], []
        size, above = sizes[self.order], np.zeros(len(rows), np.int64)
        for level in range(LEVELS):
            mine = of[level][self.order]
            new = new | np.concatenate(([True], mine[1:] != mine[:-1]))
            first = np.flatnonzero(new)
            self.first.append(first)
            self.last.append(np.append(first[1:], len(rows)))
            self.parent.append(above[first])
            above = np.cumsum(new) - 1
            self.part.append(mine[first])
            self.left.append(np.maximum.reduceat(size - cuts[self.order, level + 1], first))
            self.least.append(np.minimum.reduceat(size, first))

    def overlaps(self, level: int, nodes: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """How many n-grams of each node's part are marked in ``mine``."""
        grams, part = self.grams[level], self.part[level][nodes]
        at, end = self.parts.at[level][part], self.parts.at[level][part + 1]
        n = end - at
        if 2 * n.sum() > len(grams):
            total = np.concatenate((np.zeros(1, np.int32), np.cumsum(mine[grams], dtype=np.int32)))
            return (total[end] - total[at]).astype(np.int64)
        start = np.cumsum(n) - n
        hit = mine[grams[np.arange(n.sum()) + np.repeat(at - start, n)]]
        total = np.concatenate(([0], np.cumsum(hit)))
        return total[start + n] - total[start]


def _probes(sets: list[np.ndarray], side: list[int], t: Threshold) -> Iterator[tuple[int, np.ndarray]]:
    """(row, all rows that it probes and is similar to), every similar pair once. Rows of side 0 are the tree's; those of side 1
    only probe it, and without any of side 1 every row probes for those before it.

    A probe goes down the levels with all nodes at once: the overlap with a node's part is worked out once for all sets below it. A
    node is left when its overlap so far plus the shorter remaining length can't reach what its smallest set
    needs, or when no set below it is of a possible size."""
    if len(sets) < 2:
        return
    sizes = np.array([len(g) for g in sets], np.int64)
    cross = 1 in side
    own = np.flatnonzero(np.array(side) == 0)
    if not len(own):
        return
    bounds = [np.uint64(k << 61) for k in range(1, LEVELS)]
    cuts = np.stack([np.concatenate(([0], np.searchsorted(g, bounds), [len(g)])) for g in sets])
    parts = Parts(sets, cuts, np.concatenate((own, np.flatnonzero(np.array(side) == 1))))
    tree = PrefixTree(parts, own, sizes[own], cuts[own])
    members = own[tree.order]
    marks = [np.zeros(n, bool) for n in parts.width]
    probes = [(k, len(members)) for k in np.flatnonzero(np.array(side) == 1)] if cross else [(k, i) for i, k in enumerate(members)]
    for row, before in probes:
        size = int(sizes[row])
        other = sizes[members[:before]]
        open_ = (other * t.den >= size * t.num) & (size * t.den >= other * t.num)
        if not open_.any():
            continue
        reached = np.concatenate(([0], np.cumsum(open_), np.full(len(members) - before, open_.sum())))
        alive, shared = np.ones(1, bool), np.zeros(1, np.int64)  # the root
        for level in range(LEVELS):
            nodes = np.flatnonzero(alive[tree.parent[level]])
            nodes = nodes[reached[tree.last[level][nodes]] > reached[tree.first[level][nodes]]]
            part, mine = parts.part(level, row), marks[level]
            mine[part] = True
            overlap = shared[tree.parent[level][nodes]] + tree.overlaps(level, nodes, mine)
            mine[part] = False
            left = np.minimum(size - cuts[row, level + 1], tree.left[level][nodes])
            keep = overlap + left >= -(-t.num * (size + tree.least[level][nodes]) // (t.num + t.den))
            alive, shared = np.zeros(len(tree.first[level]), bool), np.zeros(len(tree.first[level]), np.int64)
            alive[nodes[keep]], shared[nodes[keep]] = True, overlap[keep]
            if not keep.any():
                break
        leaves = np.flatnonzero(alive)
        if not len(leaves):
            continue
        at, held = tree.first[-1][leaves], tree.last[-1][leaves] - tree.first[-1][leaves]
        at = np.arange(held.sum()) + np.repeat(at - np.cumsum(held) + held, held)
        overlap = np.repeat(shared[leaves], held)[at < before]
        found = members[at[at < before]]
        found = found[t.den * overlap >= t.num * (size + sizes[found] - overlap)]
        if len(found):
            yield int(row), found


def _linked(ids: list[int], sets: list[np.ndarray], side: list[int], t: Threshold) -> list[tuple[int, int]]:
    """All links of ``_probes`` as pairs of ids."""
    return [(ids[row], ids[k]) for row, found in _probes(sets, side, t) for k in found]


def _counted(ids: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], side: list[int], t: Threshold) -> pa.Table:
    """(x, y, w) of each set with links: its id, the first id that links reach from it, and the weights of all sets linked with it."""
    total, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for row, found in _probes(sets, side, t):
        total[row] += weights[found].sum()
        total[found] += weights[row]
        joined = np.zeros(len(ids), bool)
        joined[label[found]] = joined[label[row]] = True
        label[joined[label]] = np.flatnonzero(joined)[0]
    linked = total > 0
    return pa.table({"x": ids[linked], "y": ids[label[linked]], "w": total[linked]})


def _shingled(docs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """(_id, n, sig, keys) of each (_id, _text) row: set size, 128-bit digest of the set (null if empty) and segment keys; then
    the further columns of ``docs``."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingler, limit = Shingler(n), Threshold(*t)
        for b in batches:
            sizes, digests, keys = [], [], []
            for x in b.column(1):  # one text and one set at a time
                grams = shingler.ngrams(x.as_py())
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                keys.append(segment_keys(grams, limit))
            at = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))), *b.columns[2:]], ["_id", "n", "sig", "keys", *more])

    small_batches(docs.sparkSession, 2)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, n bigint, sig binary, keys array<bigint>{kinds}")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(cid, grp, rows, _blocks, grams) of (_text, cid, sig, grp, rows, _blocks) rows whose text has that digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shingler = Shingler(n)
        for b in batches:
            sets = [shingler.ngrams(x.as_py()).tobytes() for x in b.column(0)]
            mask = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, b.column(2).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(1), *b.columns[3:], pa.array(sets, pa.binary())], ["cid", "grp", "rows", "_blocks", "grams"]).filter(mask)

    return docs.select("_text", "cid", "sig", "grp", "rows", "_blocks").mapInArrow(run, "cid bigint, grp bigint, rows bigint, _blocks int, grams binary")


def _first_of_each(every: DataFrame, seen: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``every`` that are their class's first, and a few more by chance; no keys are shuffled for it. Bitmaps from the narrow
    tables tell rows of classes with several, and among what those hit the firsts."""
    multi = classes.where("rows > 1")
    n = multi.count()
    if n == 0:
        return every.where("sig is not null")
    several = flag_slot(F.col("sig"), slots=flag_slots(n))
    flags = flag_filter(multi, several)
    hit = with_flag(seen.where("sig is not null").select("rid", "sig"), flags, several, "_hit").where("_hit").select("rid")
    stay = materialise(hit.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi"), "op5-firsts")
    first = flag_slot(F.col("rid"), slots=flag_slots(stay.count()))
    marked = with_flag(with_flag(every.where("sig is not null"), flags, several, "_hit"), flag_filter(stay, first), first, "_first")
    return marked.where("not _hit or _first")


def _commonness(counted: DataFrame) -> list[np.ndarray]:
    """One bitmap for each of the counts in ``COMMON``, as long as there are such keys: flags of the keys of ``counted`` that come so often."""
    numbers = counted.agg(*[F.count_if(F.col("_n") >= least) for least in COMMON]).first()
    return [flag_bitmap(counted.where(F.col("_n") >= least), "key", flag_slots(n, 1 << (27 if k else 28)))
            for k, (least, n) in enumerate(zip(COMMON, numbers)) if n]


def how_common(keys: np.ndarray, bitmaps: list[np.ndarray]) -> np.ndarray:
    """In how many of the ``bitmaps``, from the first one on, each key's flag is set. Other keys' flags only make a key count for more
    common than it is, the same in every set."""
    out = np.zeros(len(keys), np.int8)
    at = np.arange(len(keys))
    for bits in bitmaps:
        slot = keys[at] & (8 * len(bits) - 1)
        at = at[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
        out[at] += 1
    return out


def _repeating_keys(firsts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(cid, key): the block keys of (cid, n, keys) rows, a few of them that no other row has among them.

    Keys are counted first, without ids; those that come once are no block keys that matter, and of the others each set leaves out its
    most common ones (``chosen_keys``). Without that, passages that many texts have in common chain unlike texts into ever larger
    families as the corpus grows."""
    keys = firsts.select(F.explode("keys").alias("key"))
    turn = F.pmod(F.shiftright("key", 32), F.lit(COUNT_ROUNDS))
    counted = [materialise(keys.where(turn == k).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "op5-counted") for k in range(COUNT_ROUNDS)]
    shared = firsts.sparkSession.sparkContext.broadcast(_commonness(reduce(DataFrame.unionByName, counted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        limit = Threshold(num, den)
        for b in batches:
            keys = b.column(2).flatten().to_numpy()
            marked = chosen_keys(keys, b.column(1).to_numpy(), limit, how_common(keys, shared.value))
            cids = np.repeat(b.column(0).to_numpy(), b.column(2).value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(cids[marked]), pa.array(keys[marked])], ["cid", "key"])

    out = materialise(firsts.select("cid", "n", "keys").mapInArrow(run, "cid bigint, key bigint"), "op5-keys")
    shared.destroy()
    discard(*counted)
    return out


def _families(rows: DataFrame, n: int, num: int, den: int, group_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``_shingled`` rows without keys; their classes of equal sets (sig, rep, rep_hash, rows, cid); and the candidate classes' sets dealt
    into the groups (grp, a, b) to be joined. ``rows`` has _id, _text and _hash.

    The segment keys are written once, with the rows, and go as soon as the block keys that repeat are known. They are shuffled
    once, a part at a time, to be counted; only those that repeat meet their classes. Sets are shuffled only into their groups."""
    every = materialise(_shingled(rows, n, (num, den)).withColumn("rid", F.monotonically_increasing_id()), "op5-sets")
    seen = materialise(every.drop("keys"), "op5-seen")
    least = F.min(F.struct(F.col("_id").isNull().alias("nil"), F.col("_id").alias("id"), F.col("_hash").alias("hash")))
    classes = materialise(seen.where("sig is not null").groupBy("sig").agg(
        least.alias("least"), F.count(F.lit(1)).alias("rows"), F.min("rid").alias("cid"), F.max("n").alias("n"))
        .select("sig", F.col("least.id").alias("rep"), F.col("least.hash").alias("rep_hash"), "rows", "cid", "n"), "op5-classes")
    keyed = _repeating_keys(_first_of_each(every, seen, classes).select(F.col("rid").alias("cid"), "n", "keys"), n, num, den)
    discard(every)
    heads = materialise(keyed.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "op5-heads")
    stars = join_groups(keyed, heads, ["key"], "_n", F.col("cid")).where("head < cid").select("cid", "head")
    groups = materialise(connected_components(stars, "cid", "head").select(F.col("node").alias("cid"), F.col("component").alias("grp")), "op5-groups")
    discard(keyed, heads)
    found = materialise(groups.join(classes.select("cid", "rep", "sig", "rows", "n"), "cid"), "op5-found")
    # 8 bytes an n-gram; a set that is larger than a block by itself is a block's only one or nearly so
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / group_rows), F.ceil(F.sum("n") * 8 / GROUP_BYTES)).cast("int")
    sizes = materialise(found.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), blocks.alias("_blocks")), "op5-sizes")
    wanted = materialise(join_groups(found, sizes, ["grp"], "_n", F.col("cid")).drop("_n"), "op5-wanted")
    slots = flag_slots(wanted.count())
    texts = with_flag(rows.select("_id", "_text"), flag_filter(wanted, flag_slot(F.col("rep"), slots=slots)), flag_slot(F.col("_id"), slots=slots), "_flag") \
        .where("_flag").drop("_flag")
    sets = _sets(texts.join(wanted, F.col("_id").eqNullSafe(F.col("rep"))), n) \
        .withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))) \
        .select("cid", "grp", "rows", "grams", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), "_own")
    return seen, classes, sets


def _group(key, table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """A group's ids, one per class in order, their rows, their sets (views of the table, not copies), and the sides of ``_probes``."""
    if table.nbytes > GIVE_BACK:
        give_back()
    ids, at = np.unique(table["cid"].to_numpy(), return_index=True)
    cross, grams, own = key[1] != key[2], table["grams"], table["_own"].to_numpy()
    sets = [np.frombuffer(grams[k].as_buffer(), np.uint64) for k in at.tolist()]
    return ids, table["rows"].to_numpy()[at], sets, [int(cross and own[k] == key[2].as_py()) for k in at]


def _rows(id_col: str, text_col: str) -> list[Column]:
    text = text_or_empty(text_col)
    return [F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash")]


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5,
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """The join's pairs: (sig_a, sig_b, id_a, id_b, rows_a, rows_b), one row per two different sets that are linked (see
    ``jaccard_components``, whose ``sig`` gives the members of each): digest, smallest id and number of rows. Rows of one ``sig``
    are linked too and not listed."""
    _, classes, sets = _families(docs.select(*_rows(id_col, text_col)), n, num, den, group_rows)

    def join(key, table):
        ids, _, grams, side = _group(key, table)
        pairs = np.array(_linked(ids.tolist(), grams, side, Threshold(num, den)), np.int64).reshape(-1, 2)
        return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]})

    links = sets.groupBy("grp", "a", "b").applyInArrow(join, "x bigint, y bigint") \
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    for c, to in (("x", "a"), ("y", "b")):
        links = links.join(classes.select(F.col("cid").alias(c), F.col("sig").alias(f"sig_{to}"), F.col("rep").alias(f"id_{to}"),
                                          F.col("rows").alias(f"rows_{to}")), c)
    return links.select("sig_a", "sig_b", "id_a", "id_b", "rows_a", "rows_b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5,
                       group_rows: int = GROUP_ROWS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, n_links (how many other rows it is linked with), component_id (smallest id
    reachable by links, its own included), kept, sig (digest of the set, null if empty), then ``carry``. ``kept`` marks the row of
    a component with the smallest id, of several such the one with the smallest hash of the text; rows equal in both agree.

    Two documents are linked when the Jaccard similarity of their sets of word ``n``-grams is num / den or more. Every
    such link is verified and counted; no pair is lost and none is judged by a sketch. ``jaccard_pairs`` lists them.

    1. One pass over the texts gives each set's digest and block keys (``block_keys``, exact by the pigeonhole
       principle). Documents with equal sets form one class, so copies take no further work.
    2. Keys are counted, and every set leaves out its most common ones, so a passage that many texts have in common makes no family.
       Classes that share a key are candidates; a key gives star edges to its smallest class, never pairs. Their components are
       the join's groups, mostly real families of near copies.
    3. Only candidate texts are read again (a bounded bitmap filter keeps the others from the shuffle), one per class. Each
       group is joined by a ``PrefixTree``; groups beyond ``group_rows`` are dealt into blocks and joined for every
       two blocks. A group gives one row per class: the rows it is linked with there, and where its links lead.
    4. The links' connected components give the ids.

    N-grams are compared as 64-bit hashes. Null or wordless texts have n_shingles 0 and are linked with nothing. Rows
    that repeat an id are rows of their own, linked by their texts; a component of null ids only has component_id null, and a null-id
    row outside any component too. An empty table gives an empty result."""
    carry = carry or {}
    seen, classes, sets = _families(docs.select(*_rows(id_col, text_col), *[v.alias(k) for k, v in carry.items()]), n, num, den, group_rows)

    def join(key, table):
        return _counted(*_group(key, table), Threshold(num, den))

    links = materialise(sets.groupBy("grp", "a", "b").applyInArrow(join, "x bigint, y bigint, w bigint"), "op5-links")
    found = connected_components(links, "x", "y")
    others = links.groupBy(F.col("x").alias("cid")).agg(F.sum("w").alias("w"))
    named = classes.select("cid", "sig", "rep", "rep_hash", "rows").join(found.withColumnRenamed("node", "cid"), "cid", "left") \
        .join(others, "cid", "left") \
        .withColumn("component", F.coalesce("component", "cid")) \
        .withColumn("n_links", F.coalesce("w", F.lit(0)) + F.col("rows") - 1)
    first = F.min(F.struct(F.col("rep").isNull().alias("nil"), F.col("rep").alias("id"), F.col("rep_hash").alias("hash")))
    least = named.groupBy("component").agg(first.alias("least"), F.count(F.lit(1)).alias("_n")) \
        .select("component", F.col("least.id").alias("component_id"), F.col("least.hash").alias("kept_hash"), "_n")
    named = join_groups(named, materialise(least, "op5-least"), ["component"], "_n", F.col("cid")).select("sig", "rows", "n_links", "component_id", "kept_hash")
    out = join_groups(seen, materialise(named, "op5-named"), ["sig"], "rows", F.col("_id"))
    alone = F.col("sig").isNull()
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
                      (alone | (F.col("_id").eqNullSafe(F.col("component_id")) & (F.col("_hash") == F.col("kept_hash")))).alias("kept"), "sig", *carry)
