"""Deterministic sharded WARC writer and reader.

Records are range-sorted by payload digest: digests are uniform, so equal-width ranges are exact splitters that
depend on nothing but the number of shards, and equal payloads lie side by side. A payload that holds over
1/1000 of all rows (1,000 such at most) is salted, its first page known beforehand. One task writes all of a shard
and salt as gzip members, rolls files by compressed size, and regenerates headers and digests. Files get their names by an
atomic rename from a name of the attempt; contents are deterministic, so a repeated attempt changes nothing.
The manifest table is the commit: readers open only what it lists.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, no_null

LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space of URLs
MANIFEST = "file string, records long, bytes long, sha256 string"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}:{digest}:{nth}')}>"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, is_revisit: bool, nth: int) -> bytes:
    """One WARC record, its headers derived from its contents. Urls are percent-encoded where a header needs it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = {
        "WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": record_id(page_id, digest, nth), "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response", "X-Payload-Length": size,
    }
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if is_revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest, 0), "X-Refers-To-Page": refers_to}
    head["Content-Length"] = len(block)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes gzip members to files of a shard, a new file once one has reached the limit."""

    def __init__(self, root: str, limit: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.limit, self.out, self.done, self.shard = limit, None, [], None

    def put(self, shard: str, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name, self.temp = f"part-{shard}-{self.seq:05d}.warc.gz", f"{self.root}/_tmp-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.place(f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1

    def place(self, to: str) -> None:
        """Give the file its name. A file that an earlier attempt left there must hold the same bytes."""
        if self.fs.get_file_info(to).type != pafs.FileType.NotFound:
            sha = hashlib.sha256()
            with self.fs.open_input_stream(to, compression=None) as stream:
                while data := stream.read(1 << 20):
                    sha.update(data)
            if sha.digest() != self.sha.digest():
                raise ValueError(f"{to} holds other records")
            self.fs.delete_file(self.temp)  # not every store lets a name be taken over
        else:
            self.fs.move(self.temp, to)


def _writer(root: str, limit: int):
    def run(batches):
        roller, last, nth = Roller(root, limit), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"])
                nth, last = (nth + 1 if key == last else 0), key
                is_revisit = row["first"] is not None and (row["page_id"] != row["first"] or nth > 0)
                data = record(row["page_id"], row["url"], row["payload"] or b"", row["n"], row["digest"], row["first"], is_revisit, nth)
                roller.put(f"{row['shard']:06d}-{row['salt']:03d}", gzip.compress(data, 6, mtime=0))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*roller.done)], [f.split()[0] for f in MANIFEST.split(", ")])

    return run


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20) -> DataFrame:
    """Write ``pages`` under ``root`` and return the manifest: file, records, bytes, sha256.

    The payload is the html in UTF-8; null is empty. Of equal payloads of 100 bytes or more the record of the
    smallest page_id is the response, others revisit it; a row that repeats id and payload revisits its first.
    Payloads whose ids are all null have no smallest id and are responses. A null url becomes a urn. Other
    columns are not read. An empty table gives an empty manifest. ``roll_bytes`` is the compressed size at
    which a file is closed.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), no_null(html_col).cast("binary").alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    count, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    small = rows.select("digest", "page_id", "n").groupBy("digest").agg(F.count(F.lit(1)).alias("k"), F.min("page_id").alias("hot_first"), F.first("n").alias("m"))
    hot = small.filter(F.col("k") > max(64, count // HOT_SHARE)).select("digest", "hot_first")
    rows = rows.join(F.broadcast(hot), "digest", "left")  # 1,000 rows at most
    width = -(-(1 << 32) // shards)
    rows = rows.withColumn("shard", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / F.lit(width)).cast("int"))
    rows = rows.withColumn("salt", F.when(F.col("hot_first").isNull() | (F.col("page_id") == F.col("hot_first")), 0).otherwise(F.pmod(F.xxhash64("page_id"), F.lit(333))).cast("int"))
    # Copies of a hot payload needn't carry it.
    rows = rows.withColumn("payload", F.when((F.col("page_id") != F.col("hot_first")) & (F.col("n") >= LEAST_REVISIT), F.lit(None)).otherwise(F.col("payload")))
    # Not by digest too: files are numbered within a shard and salt, so no bound may part one.
    rows = rows.repartitionByRange("shard", "salt")
    order = Window.partitionBy("shard", "salt", "digest").orderBy(F.asc_nulls_last("page_id"), F.asc_nulls_last("url"))
    first = F.coalesce("hot_first", F.first("page_id").over(order))
    rows = rows.select("shard", "salt", "digest", "page_id", "url", "n", "payload", F.when(F.col("n") >= LEAST_REVISIT, first).alias("first"))
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    manifest = rows.sortWithinPartitions("shard", "salt", "digest", F.asc_nulls_last("page_id"), F.asc_nulls_last("url")).mapInArrow(_writer(root, roll_bytes), MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    for left in fs.get_file_info(pafs.FileSelector(path)):  # of attempts that were lost
        if left.base_name.startswith("_tmp-"):
            fs.delete_file(left.path)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(stream, chunk: int = 1 << 18):
    """The gzip members of a stream, one at a time."""
    rest, parts, z = b"", [], zlib.decompressobj(31)
    while data := rest or stream.read(chunk):
        parts.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            parts, z = [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("a WARC file ends inside a record")


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of a record; digests are held against its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, block.partition(b"\r\n\r\n")[2]


class Counted:
    """A stream that counts and digests what is read."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def _reader(root: str):
    def row(data: bytes) -> tuple:
        h, payload = parse(data)
        page_id, digest = h.get("X-Page-ID"), h["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(h["X-Payload-Length"])
        if h["WARC-Type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        refers = h.get("X-Refers-To-Page")
        return (page_id and int(page_id)), size, digest, h["WARC-Type"], (refers and int(refers))

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(root)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name, *listed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, records, stream = [], 0, Counted(stream)
                    for data in members(stream):
                        rows.append(row(data))
                        records += 1
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in ROWS.split(", ")])
                            rows = []
                    if [records, stream.size, stream.sha.hexdigest()] != listed:
                        raise ValueError(f"{name} isn't the file that the manifest lists")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in ROWS.split(", ")])

    return run


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record the manifest lists. Records, bytes and SHA-256 of each file are held against the manifest."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    return files.repartition(F.col("file")).mapInArrow(_reader(root), ROWS)
