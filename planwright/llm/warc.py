"""Deterministic sharded WARC writer, and its reader.

Files are named by shard and sequence number and their bytes follow from the records alone: a shard is a number
of records in the order of page ids, each is a gzip member of its own without a time stamp, and a new file
begins when the compressed size passes a limit. A task writes to a temporary name and renames; a repeated
task renames the same bytes over them. The manifest is a Parquet table written last, and readers open only the
files it lists, so what lost executors leave behind is never read. The folder is any that pyarrow.fs opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.session import bound_batches, discard, materialize

ROLL_BYTES = 64 << 20
ROWS_PER_SHARD = 2_000
#: Ranges of ids that tasks write, at most: the driver holds the id at which each begins.
MAX_REGIONS = 1 << 14
#: Tasks that read archives back, at most; a number makes adaptive execution keep them apart.
READ_TASKS = 10_000
#: Smallest payload that later copies of it may refer to.
REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard bigint, n_records bigint, n_bytes bigint, sha256 string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"
_ID = "urn:x-page:"
_ONE_LINE = {13: "%0D", 10: "%0A"}


def digested(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest): a null html is an empty payload."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))


def revisits(rows: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that refer to another: ids and digests alone move, never payloads.

    Largest page ids are found per digest with map-side combining; the join back may meet one digest in a third
    of all rows, which adaptive execution splits on the side of the pages.
    """
    long = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = (
        long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("digest").alias("d"), "first")
    )
    joined = long.join(firsts, F.col("digest") == F.col("d"))
    return joined.where(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))).select(
        "page_id", "digest", F.col("first").alias("refers_to"))


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    body = b"" if payload is None else payload.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + body
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{name}>", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {url.translate(_ONE_LINE)}"]), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    def __init__(self, folder: str, shard: int, seq: int):
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.name, self.shard = f"part-{shard:012d}-{seq:05d}.warc.gz", shard
        self.temporary = f"{self.base}/_temporary-{uuid.uuid4().hex}"
        self.out, self.records, self.size, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()

    def write(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)

    def commit(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        return self.name, self.shard, self.records, self.size, self.sha.hexdigest()


def regions(ids: DataFrame, rows_per_shard: int) -> tuple[list[int], int]:
    """(ids at which the second and later regions begin, the shards of a region): regions hold as many rows each, whatever the ids.

    Bounds are the ids at exact ranks, so they follow from the ids alone and not from how they are dealt to tasks.
    """
    numbered = ids.repartitionByRange("page_id").sortWithinPartitions("page_id").select("page_id", F.monotonically_increasing_id().alias("at"))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    table = materialize(numbered, "warc-ids")
    counts = table.groupBy(part.alias("part")).count().orderBy("part").collect()
    n = sum(r["count"] for r in counts)
    shards = -(-n // (rows_per_shard * MAX_REGIONS)) or 1
    found = []
    if n > shards * rows_per_shard:
        first, before = [], 0
        for r in counts:
            first.append((r["part"], before))
            before += r["count"]
        known = F.broadcast(table.sparkSession.createDataFrame(first, "part bigint, first bigint"))
        rank = F.col("first") + place
        found = table.withColumn("part", part).join(known, "part").where((rank > 0) & (rank % (shards * rows_per_shard) == 0)).select("page_id").collect()
    discard(table)
    return sorted({r.page_id for r in found if r.page_id is not None}), shards


def region_of(page_id: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above the id, by halving; 0 for a null id."""
    starts = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if len(bounds) < 2 else F.lit(bounds).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda a, p: F.when(F.get(starts, a + p - 1) <= page_id, a + p).otherwise(a)) if bounds else F.lit(0)


def write_shards(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Writes the archive files when evaluated; each row of the result is a manifest entry.

    Records with equal payloads of REVISIT_BYTES or more become revisits of the one with the largest page_id.
    Payloads move once: verdicts on them travel as narrow rows of their own to the same range partitions, where
    they sort before the payload that they are about. A shard is `rows_per_shard` records, the last of a region fewer
    (or more, where records of one id would be parted); a task writes a region of shards, so one far id or a dense
    range of them makes no task longer.
    Defined results: a null html is an empty payload; null page ids sort first, in one region, and
    revisit like the smallest id; a null url leaves its header out; rows that tie on the largest id are all
    responses; other columns are not read; an empty table writes no file.
    """
    fs_, base = fs.FileSystem.from_uri(folder)
    fs_.create_dir(base, recursive=True)
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, seq, verdict, region, n = [], None, 0, None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    verdict = row["page_id"], row["digest"], row["refers_to"]
                    continue
                region, n = row["region"], n + 1 if region == row["region"] else 0
                shard = region * shards + min(n // rows_per_shard, shards - 1)
                if file and (file.shard != shard or file.size >= roll_bytes):
                    seq = seq + 1 if file.shard == shard else 0
                    done.append(file.commit())
                    file = None
                elif file is None:
                    seq = 0
                file = file or _File(folder, shard, seq)
                refers_to = verdict[2] if verdict and verdict[:2] == (row["page_id"], row["digest"]) else None
                file.write(record_bytes(row["page_id"], row["url"], row["payload"] if refers_to is None else None, row["payload_bytes"], row["digest"], refers_to))
        if file:
            done.append(file.commit())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], ["file", "shard", "n_records", "n_bytes", "sha256"])

    bounds, shards = regions(pages.select(F.col("page_id").cast("bigint").alias("page_id")), rows_per_shard)
    rows = digested(pages)
    none = lambda kind: F.lit(None).cast(kind)
    verdicts = revisits(rows).select("page_id", none("string").alias("url"), none("string").alias("payload"), none("bigint").alias("payload_bytes"), "digest", "refers_to")
    both = rows.withColumn("refers_to", none("bigint")).unionByName(verdicts).withColumn("region", region_of(F.col("page_id"), bounds))
    ordered = both.repartitionById(len(bounds) + 1, "region").sortWithinPartitions("region", "page_id", "digest", F.col("payload").isNotNull(), "url")
    return ordered.mapInArrow(run, MANIFEST)


def read_file(stream) -> Iterator[tuple]:
    """(page_id, url, type, refers_to, payload_bytes, digest, payload or None) of an open gzip stream; digests are checked."""
    number = lambda v: None if v is None or v.endswith("null>") else int(v.strip("<>").removeprefix(_ID))
    data = gzip.GzipFile(fileobj=stream)
    while line := data.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = data.read(int(head["Content-Length"]))
        data.read(4)
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload digest differs: {head['WARC-Record-ID']}")
        yield (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], number(head.get("WARC-Refers-To")),
               int(head["X-Payload-Length"]), digest, None if payload is None else payload.decode())


def read_shards(manifest: DataFrame, folder: str, rows_per_batch: int = 256) -> DataFrame:
    """The records of the files that the manifest lists; files are dealt to tasks and streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [part.split(" ")[0] for part in RECORD.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for row in read_file(stream):
                        rows.append(row)
                        if len(rows) == rows_per_batch:
                            yield pack(rows)
                            rows = []
                yield pack(rows)

    bound_batches(manifest.sparkSession)
    n_tasks = min(max(1, manifest.count()), READ_TASKS)
    return manifest.select("file").repartition(n_tasks, "file").mapInArrow(run, RECORD)
