"""Tar shard source and sink (S1-S3, S7) as a Python DataSource ("tarshards").

Read: members are streamed (``tarfile`` mode ``r|*``) and the members that share a stem (base name up to the first dot, the shard
convention) become one row ``(shard, key, members map<string, binary>)`` keyed by the rest of the name ("json", "mp3",
"tar.gz" for compound extensions). Members of one sample are adjacent in a shard, so a reader holds one sample at a time. Small
tars share a task. A tar larger than a task's share is cut where samples begin: a Spark job hops over its
headers, skipping the payloads, and each task then reads its own byte range.

Stream: new shards in order of (modification time, path), which is the offset.

Write: each task writes its rows into tar files under a temporary name that carries the job's id;
the job commit renames them and then writes ``_SUCCESS``. In overwrite mode the commit first deletes
the folder's earlier shards. An abort deletes every temporary file of the job, also those of tasks that sent
no message. Equal rows give equal bytes. A row's ``file`` column (if present) starts a new tar whenever it
changes, so callers can size files exactly.
"""

from __future__ import annotations

import io
import json
import os
import tarfile
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

_RENAMES = 16
_TARGET = 128 * 1024 * 1024
_INLINE_SPLITS = 100
_STREAM_TARGET = 16 * 1024 * 1024
_BATCH_BYTES = 4 * 1024 * 1024
SHARD_SCHEMA = "shard string, key string, members map<string, binary>"


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _fs(path: str):
    """(filesystem, path) for local paths and any URI pyarrow knows (s3://, hdfs://, gs://, ...),
    so tasks read and write shards on the cluster's shared storage, not only on local disks."""
    import pyarrow.fs as pafs

    if "://" in path and not path.startswith("file:"):
        for hadoop_scheme in ("s3a://", "s3n://"):  # Hadoop's names for the same store
            if path.startswith(hadoop_scheme):
                path = "s3://" + path[len(hadoop_scheme):]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(_local(path))


def _size(path: str) -> int:
    fs, p = _fs(path)
    return fs.get_file_info(p).size or 0


def _join(root: str, name: str) -> str:
    return root.rstrip("/") + "/" + name


def split_member(name: str) -> tuple[str, str]:
    """('dir/abc.json') -> ('dir/abc', 'json'); the stem ends at the first dot of the base name."""
    d, base = os.path.split(name)
    stem, _, ext = base.partition(".")
    return (f"{d}/{stem}" if d else stem), ext


@dataclass
class _TarPartition(InputPartition):
    splits: list  # (path, start, end, tag), end None for a whole file


def plan_partitions(splits: list, sizes: list[int], target_bytes: int) -> list[list]:
    """Consecutive splits are grouped until a group reaches ``target_bytes``."""
    groups, cur, size = [], [], 0
    for p, n in zip(splits, sizes):
        cur.append(p)
        size += n
        if size >= target_bytes:
            groups.append(cur)
            cur, size = [], 0
    if cur:
        groups.append(cur)
    return groups


def tar_members(path: str) -> Iterator[tuple[int, str, int, int]]:
    """(offset of its header, name, offset of its data, size) of each file in an uncompressed tar, by hopping from header to header; no
    payload is read. Raises ``tarfile.ReadError`` where that can't be done (a compressed tar)."""
    fs, p = _fs(path)
    with fs.open_input_file(p) as f, tarfile.open(fileobj=f, mode="r:") as tf:
        while (m := tf.next()) is not None:
            tf.members.clear()  # else every header is kept
            if tf.pax_headers:
                raise tarfile.ReadError("headers for the whole archive: its parts can't be read alone")
            if m.isfile():
                yield m.offset, m.name, m.offset_data, m.size


def split_tar(path: str, target_bytes: int) -> list[tuple[int, int | None]]:
    """Byte ranges of a tar that begin and end between samples, each of about ``target_bytes``; the whole file if it can't be cut."""
    cuts, stem, end = [0], None, 0
    try:
        for header, name, data, size in tar_members(path):
            key = split_member(name)[0]
            if key != stem and stem is not None and header - cuts[-1] >= target_bytes:
                cuts.append(header)
            stem, end = key, data + -(-size // 512) * 512
    except tarfile.ReadError:
        return [(0, None)]
    return list(zip(cuts, [*cuts[1:], end]))


def index_members(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """Offset index of the members of uncompressed tars: path, shard, key, ext, header, offset, size. One task a tar at most; only
    headers are read. Write it once to look members up, or to see what a shard holds."""
    import pandas as pd

    def run(it):
        for pdf in it:
            for path in pdf["path"]:
                rows = []
                for header, name, data, size in tar_members(path):
                    rows.append((path, os.path.basename(_local(path).rstrip("/")), *split_member(name), header, data, size))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "shard", "key", "ext", "header", "offset", "size"]
    schema = "path string, shard string, key string, ext string, header bigint, offset bigint, size bigint"
    return _one_task_each(spark, paths).mapInPandas(run, schema)


def _one_task_each(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    df = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    n = df.count() if isinstance(paths, DataFrame) else len(paths)
    return df.repartition(max(1, min(n, 16 * spark.sparkContext.defaultParallelism)))


def _split_large(spark: SparkSession, paths: list[str], target_bytes: int) -> dict[str, list]:
    """Splits of the tars that are larger than a task's share, found by Spark; the driver gets a row per split."""
    import pandas as pd

    def run(it):
        for pdf in it:
            rows = [(p, a, b) for p in pdf["path"] for a, b in split_tar(p, target_bytes)]
            yield pd.DataFrame({"path": [r[0] for r in rows], "start": pd.array([r[1] for r in rows], "Int64"),
                                "end": pd.array([r[2] for r in rows], "Int64")})

    found: dict[str, list] = {}
    for r in _one_task_each(spark, paths).mapInPandas(run, "path string, start bigint, end bigint").orderBy("path", "start").collect():
        found.setdefault(r["path"], []).append((r["start"], r["end"]))
    return found


class _ShardReader(DataSourceReader):
    """``splits`` is a list of [path, start, end, size, tag], or the file that holds it as JSON. Spark sends the reader and its source to
    every task, so the reader keeps the name of the file and reads it only where the partitions are planned."""

    def __init__(self, splits: list | str, target_bytes: int, members: list[str] | None, tag: str | None = None):
        self.splits, self.target_bytes, self.members, self.tag = splits, target_bytes, members, tag
        self.shards: set | None = None
        self.keys: set | None = None

    def partitions(self):
        splits = self.splits
        if isinstance(splits, str):
            fs, p = _fs(splits)
            with fs.open_input_stream(p) as f:
                splits = json.loads(f.read())
        kept = [s for s in splits if self.shards is None or _shard_name(s[0]) in self.shards]
        return [_TarPartition(g) for g in plan_partitions([(*s[:3], s[4] if len(s) > 4 else None) for s in kept], [s[3] for s in kept], self.target_bytes)]

    def read(self, partition) -> Iterator:
        # without a partition there are no shard paths at all: an empty scan
        return _record_batches(partition.splits if partition else [], self.tag, self.members, self.keys)


class _FilteringShardReader(_ShardReader):
    """Takes over filters on ``shard`` and ``key`` (=, IN): other shards aren't opened, and of other samples no payload is read.
    Spark accepts such a reader only while ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("shard",), ("key",)):
                yield f
            elif f.attribute == ("shard",):
                self.shards = values if self.shards is None else self.shards & values
            else:
                self.keys = values if self.keys is None else self.keys & values


def _shard_name(path: str) -> str:
    return os.path.basename(_local(path).rstrip("/"))


class _Range:
    """The bytes of a file from ``start`` to ``end``, as a stream."""

    def __init__(self, f, start: int, end: int):
        self.f, self.left = f, end - start
        f.seek(start)

    def read(self, n: int = -1) -> bytes:
        data = self.f.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


def _read_tar(path: str, start: int = 0, end: int | None = None, wanted: list[str] | None = None, keys: set | None = None) -> Iterator[tuple]:
    """Samples of a tar or of a byte range of one; with ``wanted`` (extensions) or ``keys`` (samples) only those members'
    payloads are kept, the others are skipped."""
    shard = _shard_name(path)
    key, members = None, {}
    fs, p = _fs(path)
    with (fs.open_input_stream(p) if end is None else fs.open_input_file(p)) as f:
        if end is not None and end <= start:
            return
        with tarfile.open(fileobj=f if end is None else _Range(f, start, end), mode="r|*" if end is None else "r|") as tf:
            while (m := tf.next()) is not None:
                tf.members.clear()  # else every header is kept
                if not m.isfile():
                    continue
                stem, ext = split_member(m.name)
                if keys is not None and stem not in keys:
                    continue
                if key is not None and stem != key:
                    yield (shard, key, members)
                    members = {}
                key = stem
                if wanted is None or ext in wanted:
                    members[ext] = tf.extractfile(m).read()
    if key is not None:
        yield (shard, key, members)


def _record_batches(splits: list, tag: str | None, wanted: list[str] | None = None, keys: set | None = None) -> Iterator:
    """The samples of some splits as Arrow batches of about ``_BATCH_BYTES``, so a task holds that much and one sample, however many
    rows it reads. With ``tag``, a column of that name holds the tag of the split."""
    import pyarrow as pa

    schema = pa.schema([("shard", pa.string()), ("key", pa.string()), ("members", pa.map_(pa.string(), pa.binary())),
                        *([(tag, pa.string())] if tag else [])])

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows, size = [], 0
    for path, start, end, mark in splits:
        for shard, key, members in _read_tar(path, start, end, wanted, keys):
            rows.append((shard, key, list(members.items()), *([mark] if tag else [])))
            size += 256 + sum(map(len, members.values()))
            if size >= _BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
    if rows:
        yield batch(rows)


class _ShardStreamReader(DataSourceStreamReader):
    """Shards under a folder in order of (modification time, path); the offset is that of the last shard taken.

    A shard younger than ``settle`` seconds waits, so that none can still appear before an offset. ``limit`` shards are taken at a
    time at most; a restarted reader goes on from the last offset it handed out, which it keeps in the file ``progress`` (Spark's
    own checkpoint stays what decides: an offset that was handed out but never logged only makes the next batch larger).

    The folder is listed when all shards of the last listing are taken, not for every batch. With ``group_size``, the shards of a batch
    are numbered in groups of that many, in order, and the offset also holds the number of groups before the next batch; ``tag``
    is the column that holds the group, as shard_%03d."""

    def __init__(self, root: str, suffix: str, target_bytes: int, members: list[str] | None, settle: float, limit: int | None, progress: str | None,
                 group_size: int | None = None, tag: str | None = None):
        self.root, self.suffix, self.target_bytes, self.members = root, suffix, target_bytes, members
        self.settle, self.limit, self.progress = settle, limit, progress
        self.group_size, self.tag = group_size, tag
        self.at: list | None = None
        self.groups = 0
        self.found: list[tuple[int, str, int]] = []  # of the last listing: what is not yet in a planned batch

    def __getstate__(self) -> dict:
        return {**self.__dict__, "found": []}

    def _listed(self) -> list[tuple[int, str, int]]:
        import pyarrow.fs as pafs

        fs, p = _fs(self.root)
        young = time.time_ns() - int(self.settle * 1e9)
        found = fs.get_file_info(pafs.FileSelector(p, recursive=True, allow_not_found=True))
        return sorted((i.mtime_ns, i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(self.suffix)
                      and i.mtime_ns <= young and not i.base_name.startswith(("_", ".")))

    def _after(self, at: list) -> list[tuple[int, str, int]]:
        """Shards after ``at``, of the last listing or, where that has none, of a new one."""
        after = (at[0], at[1], float("inf"))
        if bisect_right(self.found, after) == len(self.found):
            self.found = self._listed()
        return self.found[bisect_right(self.found, after):]

    def _offset(self, at: list, groups: int) -> dict:
        return {"time": at[0], "path": at[1], **({"groups": groups} if self.group_size else {})}

    def initialOffset(self) -> dict:
        return self._offset([0, ""], 0)

    def latestOffset(self) -> dict:
        if self.at is None:
            kept = self._kept() or [0, "", 0]
            self.at, self.groups = kept[:2], kept[2] if len(kept) > 2 else 0
            if self.group_size and self.at[0] and len(kept) < 3:
                raise ValueError("the progress file was kept by a stream that numbered no groups")
        new = self._after(self.at)
        if new:
            n = min(self.limit or len(new), len(new))
            self.at = list(new[n - 1][:2])
            if self.group_size:
                self.groups += -(-n // self.group_size)
            self._keep()
        return self._offset(self.at, self.groups)

    def _kept(self) -> list | None:
        import pyarrow.fs as pafs

        if not self.progress:
            return None
        fs, p = _fs(self.progress)
        if fs.get_file_info(p).type != pafs.FileType.File or not fs.get_file_info(p).size:
            return None
        with fs.open_input_stream(p) as f:
            return json.loads(f.read())

    def _keep(self) -> None:
        if self.progress:
            fs, p = _fs(self.progress)
            fs.create_dir(os.path.dirname(p), recursive=True)
            with fs.open_output_stream(p + ".new") as f:
                f.write(json.dumps([*self.at, *([self.groups] if self.group_size else [])]).encode())
            fs.move(p + ".new", p)

    def partitions(self, start: dict, end: dict):
        lo, hi = [start["time"], start["path"]], [end["time"], end["path"]]
        if self.at is None or hi > self.at:
            self.at, self.groups = hi, end.get("groups", 0)
        if not self.found or list(self.found[0][:2]) > lo and lo[0]:  # a restarted reader, or a batch of an earlier listing
            self.found = self._listed()
        first, last = (bisect_right(self.found, (*x, float("inf"))) for x in (lo, hi))
        files = self.found[first:last]
        if first > 4 * len(files) + 10_000:  # taken long ago
            self.found = self.found[first - 1:]
        tags = [f"shard_{start['groups'] + i // self.group_size:03d}" if self.group_size else None for i in range(len(files))]
        with ThreadPoolExecutor(_RENAMES) as pool:  # headers only, and only of large tars
            cuts = pool.map(lambda f: split_tar(f[1], self.target_bytes) if f[2] > 2 * self.target_bytes else [(0, None)], files)
            splits = [(p, a, b, tag, n if b is None else b - a) for (_, p, n), tag, ranges in zip(files, tags, cuts) for a, b in ranges]
        return [_TarPartition(g) for g in plan_partitions([s[:4] for s in splits], [s[4] for s in splits], self.target_bytes)]

    def read(self, partition) -> Iterator:
        return _record_batches(partition.splits, self.tag, self.members)


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _rows(batch) -> Iterator[tuple]:
    """(key, [(extension, payload)], file or None) of each row of an Arrow batch, one row's payloads at a time."""
    names = batch.schema.names
    keys, members = batch.column(names.index("key")), batch.column(names.index("members"))
    files = batch.column(names.index("file")) if "file" in names else None
    for i in range(len(batch)):
        yield keys[i].as_py(), sorted(dict(members[i].as_py() or ()).items()), files[i].as_py() if files is not None else None


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path if "://" in path and not path.startswith("file:") else os.path.abspath(_local(path))
        self.overwrite = overwrite
        self.temporary = f"._tmp-{uuid.uuid4().hex}-"

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        attempt = ctx.attemptNumber() if ctx else 0
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        written, tf, stream, current, n = [], None, None, object(), 0
        for key, members, file, has_file in ((*row, "file" in b.schema.names) for b in iterator for row in _rows(b)):
            group = file if has_file else pid
            if tf is None or group != current:
                if tf is not None:
                    tf.close()
                    stream.close()
                current = group
                final = f"shard-{int(group):06d}.tar" if has_file else f"shard-{pid:06d}-{n:03d}.tar"
                tmp = _join(root, f"{self.temporary}{pid}-{attempt}-{n}")
                written.append((tmp, _join(root, final)))
                stream = fs.open_output_stream(tmp)
                tf = tarfile.open(fileobj=stream, mode="w|")
                n += 1
            for ext, data in members:
                info = tarfile.TarInfo(name=f"{key}.{ext}")
                info.size = len(data)
                info.mtime = 0
                tf.addfile(info, io.BytesIO(data))
                tf.members.clear()  # else every header is kept
        if tf is not None:
            tf.close()
            stream.close()
        return _Written(written)

    def _names(self, fs, root: str) -> list[str]:
        import pyarrow.fs as pafs

        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return []
        return [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File]

    def commit(self, messages) -> None:
        fs, root = _fs(self.path)
        moves = [m for msg in messages if msg is not None for m in msg.files]
        if self.overwrite:
            for old in self._names(fs, root):
                name = os.path.basename(old)
                if name == "_SUCCESS" or name.startswith("shard-") and name.endswith(".tar"):
                    fs.delete_file(old)
        fs.create_dir(root, recursive=True)
        with ThreadPoolExecutor(_RENAMES) as pool:
            list(pool.map(lambda m: fs.move(*m), moves))
        with fs.open_output_stream(_join(root, "_SUCCESS")):
            pass

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        for path in self._names(fs, root):
            if os.path.basename(path).startswith(self.temporary):
                fs.delete_file(path)


class TarShardSource(DataSource):
    """``spark.read.format("tarshards").option("splits", '[["a.tar", 0, null, 1024]]')`` (path, start, end, size; many in a file
    named by ``splitsFile``) /
    ``spark.readStream.format("tarshards").load(dir)`` / ``df.write.format("tarshards").save(dir)``."""

    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return SHARD_SCHEMA + (f", {self.options['tag']} string" if self.options.get("tag") else "")

    def _members(self) -> list[str] | None:
        members = self.options.get("members")
        return json.loads(members) if members else None

    def reader(self, schema: StructType):
        splits = self.options.get("splitsFile") or json.loads(self.options.get("splits", "[]"))
        kind = _FilteringShardReader if self.options.get("pushFilters") == "true" else _ShardReader
        return kind(splits, int(self.options.get("targetBytes", _TARGET)), self._members(), self.options.get("tag"))

    def streamReader(self, schema: StructType):
        limit, group = self.options.get("maxFilesPerTrigger"), self.options.get("groupSize")
        return _ShardStreamReader(self.options["path"], self.options.get("suffix", ".tar"), int(self.options.get("targetBytes", _TARGET)), self._members(),
                                  float(self.options.get("settleSeconds", 2)), int(limit) if limit else None, self.options.get("progress"),
                                  int(group) if group else None, self.options.get("tag"))

    def writer(self, schema: StructType, overwrite: bool):
        return _ShardWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShardSource)


def list_shards(spark: SparkSession, root: str, glob: str = "*.tar", sort: bool = True) -> DataFrame:
    """Recursive listing of shard files (path, length, modificationTime); ``content`` is
    never selected, so file bodies are not read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
          .load(root).select("path", "length", "modificationTime"))
    df = df.coalesce(4 * spark.sparkContext.defaultParallelism)  # a scan makes a task of every few files
    return df.orderBy("path") if sort else df


def _splits_option(spark: SparkSession, splits: list) -> tuple[str, str]:
    """The option that names the splits. Options go to every task, so more than a few splits are written to the shared folder."""
    if len(splits) <= _INLINE_SPLITS:
        return "splits", json.dumps(splits)
    from stratum.session import checkpoint_dir

    at = _join(checkpoint_dir(spark), f"stratum/splits-{uuid.uuid4().hex}.json")
    fs, p = _fs(at)
    fs.create_dir(os.path.dirname(p), recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(json.dumps(splits).encode())
    return "splitsFile", at


def read_shards(spark: SparkSession, paths: list[str] | DataFrame, target_bytes: int | None = None,
                members: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """One row per sample (members grouped by stem). A task reads consecutive tars up to
    ``target_bytes`` (default ``spark.sql.files.maxPartitionBytes``). A tar of more than twice that is cut between samples into byte
    ranges of about that size; a compressed one can't be and is one task. Where ``spark.sql.python.filterPushdown.enabled`` is set,
    filters on ``shard`` and ``key`` decide what is opened and read.

    ``paths`` may be the listing of ``list_shards``, which has the sizes already; for plain paths they are asked for
    once, many at a time. ``members`` (extensions) leaves all other members unread. ``tag`` is a text column of the listing that
    the samples of each shard get too. The driver holds a path and a size per file or range, as for any file scan."""
    register(spark)
    tags: dict[str, str] = {}
    if isinstance(paths, DataFrame):
        listed = sorted(paths.select("path", "length", *([tag] if tag else [])).collect())
        files = [[r["path"], r["length"]] for r in listed]
        tags = {r["path"]: r[tag] for r in listed} if tag else {}
    else:
        with ThreadPoolExecutor(_RENAMES) as pool:
            files = [[p, n] for p, n in zip(paths, pool.map(_size, paths))]
    if target_bytes is None:
        # like Spark's file scan: at most maxPartitionBytes, but small inputs still use every core
        max_bytes = int(str(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728")).rstrip("b"))
        total = sum(n for _, n in files)
        per_core = total // max(1, spark.sparkContext.defaultParallelism)
        target_bytes = max(1, min(max_bytes, max(4 * 1024 * 1024, per_core)))
        if total < 4 * 1024 * 1024 * spark.sparkContext.defaultParallelism:
            target_bytes = max(1, per_core)
    large = [p for p, n in files if n > 2 * max(target_bytes, 1 << 20)]
    cut = _split_large(spark, large, target_bytes) if large else {}
    splits = [[p, a, b, n if b is None else b - a, *([tags[p]] if tag else [])] for p, n in files for a, b in cut.get(p, [(0, None)])]
    reader = spark.read.format("tarshards").option(*_splits_option(spark, splits)).option("targetBytes", str(target_bytes)) \
        .option("pushFilters", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower())
    reader = reader.option("tag", tag) if tag else reader
    return (reader.option("members", json.dumps(members)) if members is not None else reader).load()


def stream_shards(spark: SparkSession, root: str, max_files: int | None = None, progress: str | None = None, settle_seconds: float = 2.0,
                  members: list[str] | None = None, suffix: str = ".tar", group_size: int | None = None) -> DataFrame:
    """The samples of shards as they appear under ``root``, as a streaming DataFrame. The offset is (modification time, path) of the last
    shard taken, so a shard must get its time when it appears there; ``settle_seconds`` covers stores with coarse
    times. ``max_files`` limits a micro-batch and needs ``progress``, a file of this query's own. With ``group_size``, the column ``output``
    names the group of that many neighbouring shards that a sample is in: shard_%03d, numbered on from batch to batch."""
    register(spark)
    if group_size and not progress:
        raise ValueError("group_size needs a progress file")
    if max_files and not progress:
        raise ValueError("max_files needs a progress file")
    reader = spark.readStream.format("tarshards").option("suffix", suffix).option("settleSeconds", str(settle_seconds))
    for name, value in (("maxFilesPerTrigger", max_files), ("progress", progress), ("members", json.dumps(members) if members is not None else None),
                        ("groupSize", group_size), ("tag", "output" if group_size else None), ("targetBytes", _STREAM_TARGET if group_size else None)):
        reader = reader.option(name, str(value)) if value is not None else reader
    return reader.load(root)


def shard_samples(shards: DataFrame, json_ddl: str = "text string", audio_ext: str | None = None) -> DataFrame:
    """Sample view of a shard scan: ``json`` parsed with a declared schema, plus the audio bytes."""
    meta = F.from_json(F.decode(F.col("members")["json"], "UTF-8"), json_ddl)
    out = shards.select("shard", "key", meta.alias("json"), "members")
    if audio_ext:
        out = out.withColumn("audio", F.col("members")[audio_ext])
    return out


def write_shards(df: DataFrame, path: str, min_rows_per_file: int, order_col: str | None = None,
                 overwrite: bool = False) -> int:
    """S3: write samples ``(key, members)`` as tar files with at least ``min_rows_per_file`` rows each, in
    ``order_col`` order where given. ``overwrite`` replaces the folder's earlier shards.

    The rows are written once to the shared folder, so what made them runs once, and numbered densely there;
    then file = index * files // n, and the payload moves in one shuffle. A task writes a run of neighbouring files, several where they are
    small. Returns the number of files."""
    from stratum.operators.common import write_once
    from stratum.operators.ordering import dense_index, even_files, global_rank

    register(df.sparkSession)
    if order_col:
        rows = write_once(df, "shard-rows")
        n = rows.count()
        idx = global_rank(rows, [F.col(order_col)], out="_idx")
    else:
        idx, n = dense_index(df, "_idx")
    if n == 0 and not overwrite:
        return 0
    out, files = even_files(idx, n, min_rows_per_file, task_bytes=_TARGET)
    out.sortWithinPartitions("file", "key").select("key", "members", F.col("file").cast("bigint").alias("file")) \
        .write.format("tarshards").mode("overwrite" if overwrite else "append").save(path)
    return files if n else 0
