"""Deterministic sharded WARC writer, and a reader.

Records are dealt into shards by ranges of their ids. Ranges come from an exact histogram (cells of equal width, bytes summed),
so they depend on the data only, not on sampling or on how the input is split; a cell that holds more than a shard is dealt by
hash of id, URL and payload. Each shard is sorted by id and written as gzip members, one a record, into files that roll at ROLL compressed
bytes. Headers, record ids and digests are regenerated from the payload. A file is written under a temporary name of the
attempt and renamed when complete, and every attempt writes the same bytes, so a retry after a lost executor replaces a file
by its equal; the list of files, written last and renamed to the next free number, is the commit, and older lists go after it.
Readers take the files of the newest list only. Each file begins with a warcinfo record, which isn't counted.

Of records with equal payloads of at least REVISIT bytes the one with the largest id is the response and the others are
revisits of it; smaller ones are all responses.

Files go through pyarrow's file systems (local, HDFS, S3, GCS by URI), in the folder that all executors share.

Cases: a null html is an empty payload. A null URL becomes urn:page:<id>; control and non-ASCII characters of a URL are
percent-encoded. A null id is written, is never referred to, and is read back as null. Rows that repeat id and payload are
written each with the same role. Ids may span the whole range of 64 bits. An empty table commits an empty list. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, text_of

#: Raw bytes of a shard, about; compressed bytes at which a file rolls; smallest payload that is revisited.
SHARD, ROLL, REVISIT = 24 << 20, 8 << 20, 1000
#: Most cells of the histogram of ids (they are summed up on the driver), and most revisited payloads that are broadcast.
CELLS, BROADCAST_GROUPS = 1 << 16, 300_000
#: Date of all records, and the profile of revisits (fixed values of the WARC format).
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _sha1(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def target(page_id: int | None, url: str | None) -> str:
    return quote(url, safe=QUOTE_SAFE) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_to_url: str | None = None) -> bytes:
    """One record; a revisit if it refers to another page."""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest.hexdigest())}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(page_id, url)}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}", f"WARC-Block-Digest: {_sha1(block)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if refers_to is None else [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hexdigest())}", f"WARC-Refers-To-Target-URI: {target(refers_to, refers_to_url)}",
            f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}",
        ]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record at the beginning of a file."""
    block = b"software: wherewise\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of a URL that stay as they are.
QUOTE_SAFE = "!#$%&'()*+,/:;=?@[]~"


def _member(data: bytes) -> bytes:
    """A gzip member without a date."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> dict | None:
    """A record's fields, None for a warcinfo; digests are computed again and must be those of its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[int(h["Content-Length"]) :] != b"\r\n\r\n" or _sha1(block) != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    if h["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or _sha1(payload) != h["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
    number = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": number("X-Page-ID"), "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": None if revisit else payload,
    }


class _Files:
    """The files of one shard."""

    def __init__(self, fs: pafs.FileSystem, root: str, shard: int, roll: int):
        self.fs, self.root, self.shard, self.roll, self.seq, self.out = fs, root, shard, roll, 0, None

    def add(self, data: bytes) -> dict | None:
        """The row of the file that this record completes, if it does."""
        if self.out is None:
            self.tmp = f"{self.root}/_tmp/{self.shard:06d}-{self.seq:04d}-{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
            self._write(info(self.name()))
        self._write(data)
        self.n += 1
        return self.close() if self.size >= self.roll else None

    def name(self) -> str:
        return f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"

    def _write(self, data: bytes) -> None:
        m = _member(data)
        self.out.write(m)
        self.sha.update(m)
        self.size += len(m)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        name = self.name()
        self.fs.move(self.tmp, f"{self.root}/{name}")
        self.out, self.seq = None, self.seq + 1
        return {"shard": self.shard, "seq": self.seq - 1, "name": name, "records": self.n, "bytes": self.size, "sha256": self.sha.hexdigest()}


MANIFEST = "shard int, seq int, name string, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD, roll: int = ROLL, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Writes the pages under uri and commits; returns the list of files."""
    spark = pages.sparkSession
    html = text_of(F.col(html_col))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    # SHA-1, another hash and the length together stand for the payload
    key = [F.sha1(F.col("html").cast("binary")).alias("sha1"), F.xxhash64("html").alias("x"), F.octet_length("html").cast("long").alias("n")]
    narrow = cut(base.select("page_id", "url", *key), "warc-keys")
    groups = narrow.where(F.col("n") >= REVISIT).groupBy("sha1", "x", "n").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("rows")).where("rows > 1 and o.page_id is not null")
    groups = cut(groups.select("sha1", "x", "n", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url")), "warc-groups")

    low, high, total = narrow.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("n") + 600)).first()
    low, high, total = low or 0, high or 0, total or 0
    shards = max(1, -(-total // shard_bytes))
    halved = int(high - low >= 1 << 62)  # then differences of ids don't fit their type, those of halved ids do
    width = max(1, -(-((high >> halved) - (low >> halved) + 1) // min(CELLS, 64 * shards)))
    cell = lambda c: F.coalesce(F.expr(f"(shiftright({c}, {halved}) - {low >> halved}L) div {width}L"), F.lit(-1)).cast("long")
    plan, at, before = [], 0, 0
    for c, size in sorted((r[0], r[1]) for r in narrow.groupBy(cell("page_id").alias("c")).agg(F.sum(F.col("n") + 600)).toLocalIterator()):
        if before and before + size > shard_bytes:
            at, before = at + 1, 0
        parts = max(1, -(-size // shard_bytes))
        plan.append((c, at, parts))
        at, before = (at + parts, 0) if parts > 1 else (at, before + size)
    cells = F.broadcast(spark.createDataFrame(plan or [(0, 0, 1)], "cell long, shard int, parts int"))

    few = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    with_key = base.select("*", *key)
    roles = with_key.join(F.broadcast(groups) if few else groups, ["sha1", "x", "n"], "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("original"))
    roles = roles.select("page_id", "url", "html", "x", F.when(revisit, F.col("original")).alias("refers_to"), F.when(revisit, F.col("original_url")).alias("refers_to_url"), cell("page_id").alias("cell"))
    part = F.pmod(F.xxhash64("page_id", "url", "x"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = roles.join(cells, "cell", "left").select((F.coalesce("shard", F.lit(0)) + part).alias("shard"), "page_id", "url", "html", "refers_to", "refers_to_url")
    # a shard is a partition: by hash some partitions would get several and some none
    dealt = dealt.repartitionById(max(1, min(at + 1, 200_000)), F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(f"{root}/_tmp", recursive=True)
        files, rows = None, []
        for batch in batches:
            for shard, page, url, text, refers, at in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if files is None or files.shard != shard:
                    rows.append(files and files.close())
                    files = _Files(fs, root, shard, roll)
                rows.append(files.add(record(page, url, text.encode("utf-8", "surrogatepass"), refers, at)))
        rows.append(files and files.close())
        done = [r for r in rows if r]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    made = f"{uri}/_made-{uuid.uuid4().hex}"
    dealt.mapInArrow(run, MANIFEST).write.json(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(uri).getFileSystem(spark._jsc.hadoopConfiguration())
    old = _lists(spark, uri)
    new = f"{uri}/_manifest-{old[-1] + 1 if old else 0:08d}"
    if not files.rename(path(made), path(new)):
        raise OSError(f"{uri}: the list of files can't be put into place")
    for v in old:
        drop_path(spark, f"{uri}/_manifest-{v:08d}")
    drop_path(spark, f"{uri}/_tmp")
    return listed(spark, uri)


def _lists(spark: SparkSession, uri: str) -> list[int]:
    """Numbers of the lists of files under uri, the newest last."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = path(uri).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(f"{uri}/_manifest-*"))
    return sorted(int(f.getPath().getName().rsplit("-", 1)[1]) for f in found or [])


def listed(spark: SparkSession, uri: str) -> DataFrame:
    found = _lists(spark, uri)
    if not found:
        raise FileNotFoundError(f"{uri}: no list of files, so nothing was committed")
    return spark.read.schema(MANIFEST).json(f"{uri}/_manifest-{found[-1]:08d}")


def members(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    d, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(d.decompress(data))
            data = d.unused_data
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []
    if any(out):
        raise EOFError("the last member is cut short")


def read_warc(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and the payload (null for revisits), of listed files."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(fields if with_payload else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for m in members(f):
                        if found := parse(m):
                            rows.append(found)
                            size += len(m)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = listed(spark, uri).select("name")
    n = max(1, min(files.count(), 200_000))
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return files.repartition(n).mapInArrow(run, ddl)
