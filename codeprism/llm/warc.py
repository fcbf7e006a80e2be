"""WARC archives: a deterministic sharded writer with two-phase commit, and a reader, as a Spark data source."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import bounded, materialise, require, utf8, work_dir

MANIFEST = "_manifest.json"
DATE = "2026-01-01T00:00:00Z"
#: Records of about so many payload bytes are a shard, and more (a SHARDS-th of all) where the table is large.
SHARD_BYTES = 32 << 20
SHARDS = 4096
#: A shard's file is closed beyond this part of the shard's bytes, compressed.
ROLL_PART = 8
#: Hexadecimal digits by which key ranges are refined at a time.
DIGITS = 3
#: Files that the commit renames at a time.
RENAMES = 32
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _name(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'record:{page_id} {url}')}>"


def info(shard: int, number: int, date: str = DATE) -> bytes:
    """The warcinfo record that opens a file."""
    block = b"software: codeprism\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'info:{shard} {number}')}>", f"WARC-Date: {date}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, refers_to_url: str | None = None) -> bytes:
    """One record: a response with the payload, or a revisit of refers_to without it. Headers follow from the arguments only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, url)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, refers_to_url)}", f"WARC-Refers-To-Date: {date}", f"WARC-X-Refers-To-Page: {refers_to}"]
        if refers_to_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_safe(refers_to_url)}")
    if page_id is not None:
        lines.append(f"WARC-X-Page-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict | None:
    """The fields of RECORDS from one record, none for warcinfo; a digest that doesn't fit its content is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {h['warc-record-id']}")
    if h["warc-type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload digest of {h['warc-record-id']}")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("warc-x-page-id"), "url": h.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number("warc-x-refers-to-page")}


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(1 << 20):
        rest = b""
        out.append(z.decompress(chunk))
        if z.eof:
            yield b"".join(out)
            rest = z.unused_data
            z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):  # file:/x and file:///x
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Rows (page_id, url, payload, refers_to, refers_to_url, shard) in shard order → files; see write_warc."""

    def __init__(self, path: str, roll: int, date: str):
        self.path, self.roll, self.date = path, roll, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = _open(self.path)
        files.create_dir(f"{base}/_temporary", recursive=True)
        attempt, done = uuid.uuid4().hex, _Written()
        out = at = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or r["shard"] != at["shard"] or at["bytes"] >= self.roll:
                    close()
                    number = at["number"] + 1 if at and at["shard"] == r["shard"] else 0
                    at = {"shard": r["shard"], "number": number, "name": f"part-{r['shard']:07d}-{number:05d}.warc.gz", "temporary": f"_temporary/{attempt}-{r['shard']}-{number}", "bytes": 0, "records": 0}
                    done.files.append(at)
                    out = files.open_output_stream(f"{base}/{at['temporary']}", compression=None)
                    head = _member(info(r["shard"], number, self.date))
                    out.write(head)
                    at["bytes"] += len(head)
                data = _member(record(r["page_id"], r["url"], r["payload"], r["refers_to"], self.date, r["refers_to_url"]))
                out.write(data)
                at["bytes"] += len(data)
                at["records"] += 1
        close()
        return done

    def commit(self, messages: list) -> None:
        """Move the files of successful tasks to their names; the manifest comes last, and only with it the archive is there."""
        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        listed = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: files.move(f"{base}/{f['temporary']}", f"{base}/{f['name']}"), listed))
        with files.open_output_stream(f"{base}/_temporary-manifest", compression=None) as out:
            out.write(json.dumps([{k: f[k] for k in ("name", "bytes", "records")} for f in listed]).encode())
        files.move(f"{base}/_temporary-manifest", f"{base}/{MANIFEST}")
        if files.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
            files.delete_dir(f"{base}/_temporary")

    def abort(self, messages: list) -> None:
        files, base = _open(self.path)
        if files.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
            files.delete_dir(f"{base}/_temporary")


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        files, base = _open(self.path)
        with files.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
            listed = json.loads(f.read())
        return [_File(x["name"]) for x in listed] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        files, base = _open(self.path)
        with files.open_input_stream(f"{base}/{partition.name}", compression=None) as f:
            rows, size = [], 0
            pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in self.columns], names=self.columns)
            for m in members(f):
                r = parse(m)
                if r is None:
                    continue
                size += len(m)
                rows.append({c: r[c] for c in self.columns})
                if size >= 8 << 20 or len(rows) >= 5000:
                    yield pack()
                    rows, size = [], 0
            if rows:
                yield pack()


class WarcSource(DataSource):
    """format("warc"): reads archives that have a manifest; writes rows that are in shard order (use write_warc)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("roll_bytes", SHARD_BYTES // ROLL_PART)), self.options.get("date", DATE))


def _shards(narrow: DataFrame, shard_bytes: int) -> tuple[DataFrame, list[int]]:
    """Key ranges and the shard of each: (range, shard), and the lengths that ranges have. narrow: key, size.

    A range is a prefix of the key, so ranges stand in the order of keys. Those of more than shard_bytes are refined,
    DIGITS digits at a time, until none is left or a key is whole; their sizes, summed up in order, are cut into shards.
    This follows from keys and sizes only, however Spark deals the rows out. Sums go over ranges, not rows.
    """
    ends = narrow.agg(F.min("key").alias("a"), F.max("key").alias("z")).first()
    common = 0
    if ends["a"] is not None:
        while common < len(ends["a"]) and ends["a"][common] == ends["z"][common]:
            common += 1
    whole, length, lengths, done, left = len(ends["a"] or "0"), min(common, len(ends["a"] or "0") - 1), [], None, narrow
    while left is not None:
        length = min(length + DIGITS, whole)
        lengths.append(length)
        sizes = materialise(left.groupBy(F.substring("key", 1, length).alias("range")).agg(F.sum("size").alias("size")), "warc-ranges")
        heavy = sizes.where(F.col("size") > shard_bytes) if length < whole else sizes.limit(0)
        light = sizes if length == whole else sizes.where(F.col("size") <= shard_bytes)
        done = light if done is None else done.unionByName(light)
        if heavy.isEmpty():
            left = None
        else:
            on = F.substring("key", 1, length) == F.col("range")
            left = materialise(left.join(bounded(heavy.select("range"), "warc-heavy"), on, "left_semi"), "warc-left")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    return done.select("range", F.floor(F.coalesce(F.sum("size").over(upto), F.lit(0)) / shard_bytes).cast("int").alias("shard")), lengths


def write_warc(pages: DataFrame, path: str, shard_bytes: int | None = None, roll_bytes: int | None = None, date: str = DATE) -> None:
    """Write a record for each row of pages (page_id, url, html) below path, which must not hold an archive yet.

    Rows are range-sorted by page_id, then by hashes of url and payload: key ranges, refined where they are heavy, are
    cut into shards of about shard_bytes, so the same rows give the same files byte for byte, however Spark deals them
    out, and one far-off page_id or one page_id of very many rows changes nothing about the balance. A shard is written
    by one task of its own, under a name of its own attempt; files open with a warcinfo record and roll at roll_bytes of
    compressed data (a record is never split). The commit renames what successful tasks wrote, then writes the manifest.
    Payloads are equal if their length, SHA-1 and SHA-256 are. Of rows with equal payloads the largest page_id is the
    response, the others revisit it. Null html: an empty payload. Null page_ids and urls have no such header; null
    page_ids count as smallest. Rows that repeat the response's page_id are responses too. Other columns are not read.
    An empty table gives an archive without files.
    """
    require(pages, ["page_id", "url", "html"])
    spark = pages.sparkSession
    files, base = _open(path)
    if files.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise ValueError(f"{path} holds an archive")
    rows = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("same", F.unhex(F.concat(F.sha1("payload"), F.sha2("payload", 256), F.lpad(F.hex(F.length("payload")), 16, "0"))))
    # hexadecimal digits in the order of page_id (null first), then of the hash of url and payload
    number = F.coalesce(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0"), F.lit("0" * 16))
    rows = rows.withColumn("key", F.concat(F.when(F.col("page_id").isNull(), "0").otherwise("1"), number, F.md5(F.concat_ws("|", F.coalesce("url", F.lit("")), F.hex("same")))))
    narrow = materialise(rows.select("page_id", "url", "same", "key", (F.length("payload") + 512).cast("long").alias("size")), "warc-sizes")
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shard_bytes = shard_bytes or max(SHARD_BYTES, total // SHARDS)
    roll_bytes = roll_bytes or shard_bytes // ROLL_PART
    last = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("u"), "url"))
    twins = narrow.groupBy("same").agg(last.alias("m"), F.count("*").alias("many")).where("many > 1").select("same", F.col("m.page_id").alias("keep"), F.col("m.url").alias("keep_url"), F.lit(True).alias("several"))
    out = rows.join(bounded(twins, "warc-twins"), "same", "left")
    again = F.col("several").isNotNull() & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    out = out.withColumns({"refers_to": F.when(again, F.col("keep")), "refers_to_url": F.when(again, F.col("keep_url"))})
    ranges, lengths = _shards(narrow.select("key", "size"), shard_bytes)
    ranges = bounded(ranges, "warc-shards")
    shards = (ranges.agg(F.max("shard")).first()[0] or 0) + 1
    out = out.select("page_id", "url", "payload", "refers_to", "refers_to_url", "key")
    # each row is in one range, of one of a few lengths
    for n in lengths:
        side = ranges.where(F.length("range") == n).select(F.col("range").alias(f"range_{n}"), F.col("shard").alias(f"shard_{n}"))
        out = out.join(side, F.substring("key", 1, n) == F.col(f"range_{n}"), "left")
    out = out.withColumn("shard", F.coalesce(*[F.col(f"shard_{n}") for n in lengths])).select("page_id", "url", "payload", "refers_to", "refers_to_url", "shard", "key")
    out = out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").drop("key")
    spark.dataSource.register(WarcSource)
    out.write.format("warc").option("path", path).option("roll_bytes", roll_bytes).option("date", date).mode("append").save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below path, one task for each file, checked against their digests; revisits have no payload."""
    spark.dataSource.register(WarcSource)
    schema = RECORDS if payload else RECORDS.replace("payload binary, ", "")
    return spark.read.format("warc").schema(schema).load(path)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or work_dir(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
