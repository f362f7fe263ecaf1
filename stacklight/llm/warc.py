"""A deterministic sharded WARC writer, and a reader of its archives.

Which record of equal payloads is the response is settled on digests alone: a partially aggregated maximum per digest and a
join back of (page_id, digest), whose skew AQE splits; the html isn't moved for it. Revisit marks then join the records
through the same range sort that orders them, so the html is shuffled once. Each task writes its range as files of gzip members, rolled by
compressed size, under temporary names that carry the attempt; a finished file is renamed, and the task's rows of
the manifest are committed by Spark's writer. Readers take the files that the manifest lists and nothing else.

Null html is empty. Null urls give records without a target. Null page_ids come first and count as the smallest. Rows that share the largest page_id
of a payload are all responses. An empty table gives an empty manifest. Very long html is one record. Other columns aren't read."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm.common import filesystem, input_parts, renamed
from stacklight.session import work_path

ROLL_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, first_page_id long, last_page_id long, sha256 string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record. Headers are made from the payload: lengths and digests are never copied from elsewhere."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one task: temporary until full, then renamed."""

    def __init__(self, folder: str, shard: int, attempt: int, most: int):
        self.files, self.folder = filesystem(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.shard, self.attempt, self.most = shard, attempt, most
        self.seq, self.file, self.done = 0, None, []

    def add(self, page_id: int | None, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        if self.file and self.size + len(member) > self.most:
            self.close()
        if not self.file:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
            self.file, self.size, self.records, self.first, self.sha = self.files.open_output_stream(self.temporary, compression=None), 0, 0, page_id, hashlib.sha256()
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id

    def close(self) -> None:
        if self.file:
            self.file.close()
            renamed(self.files, self.temporary, f"{self.folder}/{self.name}")  # every attempt writes the same bytes
            self.done.append((self.name, self.records, self.size, self.first, self.last, self.sha.hexdigest()))
            self.file, self.seq = None, self.seq + 1

    def abort(self) -> None:
        if self.file:
            self.file.close()
            with contextlib.suppress(OSError):
                self.files.delete_file(self.temporary)


def _writer(folder: str, most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, at, marks = _Roller(folder, task.partitionId(), task.taskAttemptId(), most), object(), {}
        try:
            for b in it:
                for page_id, kind, digest, refers_to, url, html in zip(*[b.column(c).to_pylist() for c in ("page_id", "kind", "digest", "refers_to", "url", "html")], strict=True):
                    if page_id != at:
                        at, marks = page_id, {}
                    if kind == 0:
                        marks[digest] = refers_to
                        continue
                    payload = html or b""
                    out.add(page_id, record(page_id, url, payload, marks.get(hashlib.sha1(payload).hexdigest()), digest32(payload)))
            out.close()
        except BaseException:
            out.abort()
            raise
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "first_page_id", "last_page_id", "sha256"), x, strict=True)) for x in out.done], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_page_id", pa.int64()), ("last_page_id", pa.int64()), ("sha256", pa.string())]))

    return run


def write_warc(pages: DataFrame, path: str | None = None, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Writes one record for each row of (page_id, url, html); returns the folder, whose manifest/ is the commit."""
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    d = p.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit_bytes)
    most = d.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    marks = d.select("page_id", "digest").join(most, "digest").where("page_id IS NULL OR page_id <> refers_to")
    marks = marks.select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    rows = p.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html").unionByName(marks)
    rows = rows.repartitionByRange(input_parts(pages), "page_id").sortWithinPartitions("page_id", "kind", "url", "digest", F.xxhash64("html"))
    rows.mapInArrow(_writer(f"{path}/data", roll_bytes), MANIFEST).write.parquet(f"{path}/manifest")
    return path


def records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in the members of an archive."""
    for raw in data:
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        yield headers, rest[:n]


def members(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after another; memory holds one."""
    files, name = filesystem(path)
    with files.open_input_stream(name, compression=None) as f:
        rest = b""
        while rest or (rest := f.read(chunk)):
            one, parts = zlib.decompressobj(31), []
            while not one.eof:
                if not rest and not (rest := f.read(chunk)):
                    raise ValueError(f"{path} ends inside a record")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield b"".join(parts)


def _reader(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in it:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                for h, block in records(members(f"{folder}/{name}")):
                    if digest32(block) != h["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"block digest differs in {name}, {h['WARC-Record-ID']}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    whole = h["WARC-Type"] == "response"
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and (len(payload) != size or digest32(payload) != digest):
                        raise ValueError(f"payload differs in {name}, {h['WARC-Record-ID']}")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append(dict(zip(names, (number("X-Page-ID"), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], number("X-Refers-To-Page"), payload if whole else None), strict=True)))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record that the manifest covers.

    payload is null for revisits. Digests of blocks and payloads are checked on the way."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file").mapInArrow(_reader(f"{path}/data"), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
