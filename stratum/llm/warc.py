"""Operator 11: WARC archives, written with an index and read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import flag_filter, flag_slot, flag_slots, join_groups, materialise, small_batches, text_or_empty, with_flag
from stratum.session import checkpoint_dir
from stratum.sources.shards import _fs, _join

# fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header that carries the row's id, and on a revisit that of the row it refers to.
ROW_ID, ROW_REFERS_TO = "WARC-X-Row-Id", "WARC-X-Refers-To-Row-Id"

INDEX = "file string, offset bigint, length bigint, url string, digest string, record_type string, row_id string"
RECORD = "file string, offset bigint, record_type string, row_id string, refers_to string, url string, payload string, payload_bytes bigint, payload_digest string"
_BATCH = 8 << 20


# ------------------------------------------------------------------ one record
def header_text(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded, as URLs want them."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_id(row_id: str | None, url: str | None, digest: str, copy: int) -> str:
    """The same for equal rows in any run; ``copy`` tells repeated rows apart."""
    name = hashlib.sha1(repr((row_id, url, digest, copy)).encode("utf-8", "surrogatepass")).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def write_record(row: dict, date: str, gzip: bool) -> bytes:
    """The bytes of a response or revisit record. A revisit has the HTTP header of the page and no payload."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = http if revisit else http + (row["payload"] or "").encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["row_id"], row["url"], row["digest"], row["copy"])),
            ("WARC-Date", date), ("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", digest), (ROW_ID, row["row_id"])]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(row["to_id"], row["to_url"], row["digest"], 0)),
                 ("WARC-Refers-To-Target-URI", row["to_url"]), (ROW_REFERS_TO, row["to_id"])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {header_text(v)}\r\n" for k, v in head if v is not None)
    data = f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"
    if not gzip:
        return data
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member of its own, so the record can be read alone
    return packer.compress(data) + packer.flush()


def read_record(data: bytes) -> dict:
    """What ``write_record`` wrote; raises where the payload doesn't have the digest that the record states."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"record_type": fields["WARC-Type"], "row_id": fields.get(ROW_ID), "refers_to": fields.get(ROW_REFERS_TO),
            "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload.decode(), "payload_bytes": size, "payload_digest": digest}


# ------------------------------------------------------------------ which rows revisit
_KEY = ["digest", "_k", "_u"]


def _prepared(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = text_or_empty(payload_col)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("row_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("size"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    return rows.withColumn("_k", F.coalesce("row_id", F.lit(""))).withColumn("_u", F.coalesce("url", F.lit("")))


def _records(pages: DataFrame, least: int, split: int = 4096) -> DataFrame:
    """Every record to write: row_id, url, digest, size, payload, record_type, to_id, to_url, copy.

    A narrow table (id, URL, digest, size) decides who revisits whom. Its rows that revisit are written from it alone. For the
    payloads two bitmaps say which rows are responses for certain (written where they are read) and which are revisits for certain
    (not read further); only those of neither kind, rows repeated with id and URL and false hits, are shuffled."""
    narrow = materialise(pages.where(F.col("size") >= least).select("_id", "row_id", "url", "_k", "_u", "size", "digest"), "op11-narrow")
    groups = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_k", "_u", "row_id", "url")).alias("to")).where("n > 1")
    groups = materialise(groups, "op11-groups")
    keys = join_groups(narrow, groups, ["digest"], "n", F.concat_ws(" ", "_k", "_u")).where("n is not null") \
        .groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("row_id", "url", "size", "to")])
    keys = keys.withColumn("wins", (F.col("to._k") == F.col("_k")) & (F.col("to._u") == F.col("_u")))
    keys = materialise(keys, "op11-keys")
    again = keys.where("copies > 1 or not wins")
    n = again.count()
    kept = ["row_id", "url", "digest", "size", "payload"]
    response = [F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("to_id"), F.lit(None).cast("string").alias("to_url")]
    copy = F.when(F.col("size") >= least, F.lit(0).cast("bigint")).alias("copy")
    if n == 0:
        return pages.select(*kept, *response, copy)

    slot = flag_slot(*_KEY, slots=flag_slots(n))
    flags = flag_filter(again, slot)
    hit = with_flag(narrow, flags, slot, "_hit").where("_hit").select(*_KEY).distinct()
    stay = materialise(hit.join(again.where("not wins").select(*_KEY), _KEY, "left_anti"), "op11-stay")
    seen = flag_slot(F.lit("stay"), *_KEY, slots=flag_slots(n))
    marked = with_flag(with_flag(pages, flags, slot, "_hit"), flag_filter(stay, seen), seen, "_stay")
    large = F.col("size") >= least
    direct = marked.where(~large | ~F.col("_hit")).select(*kept, *response, copy)
    open_rows = marked.where(large & F.col("_hit") & F.col("_stay")).groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in kept if c != "digest"])
    settled = open_rows.join(stay, _KEY, "left_semi").select(*kept, *response, copy)

    low = F.col("wins").cast("int")  # of the rows that repeat the response itself, one is the response
    parts = again.withColumn("_from", F.explode(F.sequence(low.cast("bigint"), F.col("copies") - 1, F.lit(split).cast("bigint")))) \
        .repartition(*_KEY, "_from")
    revisits = parts.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + (split - 1), F.col("copies") - 1))))
    revisits = revisits.select("row_id", "url", "digest", "size", F.lit(None).cast("string").alias("payload"), F.lit("revisit").alias("record_type"),
                               F.col("to.row_id").alias("to_id"), F.col("to.url").alias("to_url"), "copy")
    return direct.unionByName(settled).unionByName(revisits)


# ------------------------------------------------------------------ write and read
def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least: int = 1000, archive_bytes: int = 256 << 20, gzip: bool = True, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into WARC archives under ``folder`` and return their index, itself a written table: file, offset,
    length, url, digest, record_type, row_id.

    Payloads are the UTF-8 bytes of ``payload_col`` (null counts as empty). Of rows with equal payloads of at least ``least`` bytes the one with the
    largest id (null is the smallest; of equal ids the largest URL, of equal rows one) becomes the response and all others revisit it;
    shorter ones are all responses. A null URL gives no target header; spaces and control characters of a URL are percent-encoded. An empty
    table gives an empty index and no archive.

    Each task writes its own archives, a new one after ``archive_bytes``, and its part of the index, so files and offsets
    belong together: a task that ran twice leaves archives that no index row names, never wrong rows. Archives are streamed; a task
    holds one Arrow batch (bounded by bytes; a longer payload is a batch of its own)."""
    spark = pages.sparkSession
    small_batches(spark)
    root = folder or f"{checkpoint_dir(spark).rstrip('/')}/stratum-llm/op11-archives-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _fs(root)
        out, name, offset = None, "", 0
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if out is None or offset >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc{'.gz' if gzip else ''}", 0
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(_join(at, name), compression=None)
                if row["copy"] is None:
                    row["copy"] = f"{name}:{offset}"
                data = write_record(row, date, gzip)
                out.write(data)
                rows.append((_join(root, name), offset, len(data), header_text(row["url"]) if row["url"] is not None else None, row["digest"],
                             row["record_type"], row["row_id"]))
                offset += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], _INDEX_NAMES)
        if out is not None:
            out.close()

    records = _records(_prepared(pages, id_col, url_col, payload_col), least)
    return materialise(records.mapInArrow(run, INDEX), "op11-index")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in INDEX.split(", ")]
_RECORD_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_RECORD_TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in RECORD.split(", ")]


def coalesce_ranges(entries: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list]]:
    """(file, start, end, entries) of byte ranges that hold sorted (file, offset, length) entries: neighbours at most ``gap`` bytes apart
    share a read of at most ``most`` bytes. A longer entry is read alone."""
    held, file, start, end = [], None, 0, 0
    for e in entries:
        if held and (e[0] != file or e[1] > end + gap or e[1] + e[2] - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start = e[0], e[1]
        held.append(e)
        end = e[1] + e[2]
    if held:
        yield file, start, end, held


def read_archives(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records that the rows of ``index`` name (select rows of it first): file, offset, record_type, row_id, refers_to, url,
    payload (null on a revisit), payload_bytes, payload_digest (bare hex). Both of the latter are those of the full payload, on a revisit too.

    The index rows are range-partitioned by (file, offset), about ``task_bytes`` of records to a task, and sorted; each task coalesces neighbours into
    single reads. Every response's payload is hashed again and compared with its digest; a difference raises. An
    empty index gives no rows."""
    small_batches(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = ((f, o, n) for b in batches for f, o, n in zip(*[b.column(i).to_pylist() for i in range(3)]))
        opened, source, rows, held = None, None, [], 0
        for file, start, end, found in coalesce_ranges(entries, gap, most):
            if file != opened:
                if source is not None:
                    source.close()
                fs, path = _fs(file)
                opened, source = file, fs.open_input_file(path)
            data = source.read_at(end - start, start)
            for _, offset, length in found:
                r = read_record(data[offset - start:offset - start + length])
                rows.append((file, offset, *[r[c] for c in _RECORD_NAMES[2:]]))
                held += r["payload_bytes"] if r["payload"] is not None else 200
                if held >= _BATCH:
                    yield _record_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _record_batch(rows)
        if source is not None:
            source.close()

    parts = max(1, -(-total // task_bytes), min(index.sparkSession.sparkContext.defaultParallelism, total >> 20))
    return index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset") \
        .mapInArrow(run, RECORD)


def _record_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_TYPES)], _RECORD_NAMES)
