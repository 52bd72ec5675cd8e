"""WARC archives as a PySpark data source (operator 9).

`register(spark)`, then
`df.write.format("warc").mode("append").save(folder)` and
`spark.read.format("warc").load(folder)`.

Written columns (any order): record_type (`response` or `revisit`), record_id
(a URI), target_uri, refers_to (a revisit's record_id of the response),
payload_digest (hex SHA-1), payload_length, payload (binary; revisits have
none).  Each task writes files of its own under new names, and the commit
lists those of the tasks that counted, so lost or repeated tasks leave nothing
that a reader sees.  Records are single gzip members with a skip-length extra
field.

Reading plans partitions of whole files by size.  Predicates on record_type,
target_uri, record_id and refers_to are pushed down (options `record_types`
and `uri_prefix` do the same by hand): headers are parsed first, and the payload of an unwanted record
is neither inflated nor read, nor is any payload when the schema asked for
(`.schema(...)`) has none.  `.warc` and `.warc.gz` of other writers are read
as well; a member without skip lengths is inflated to find its end.

Defined results: null columns leave their header out and read as null; a
null payload is an empty one; control characters in URIs are percent-encoded;
an empty table makes an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from codeaudit.llm.common import scratch
from codeaudit.session import qualified

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, payload binary")
_LIST = "_files.json"
_HEAD = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri",
         "refers_to": b"warc-refers-to", "payload_digest": b"warc-payload-digest",
         "payload_length": b"warc-payload-length"}
_BATCH_BYTES, _BLOCK = 8 << 20, 1 << 16


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (
        pafs.LocalFileSystem(), uri.removeprefix("file:"))


# Writing

def _header(name: str, value: str | None) -> bytes:
    if value is None:
        return b""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)
    return f"{name}: {safe}\r\n".encode()


def _uri(value: str | None) -> str | None:
    return None if value is None else f"<{value}>"


def _record(r: dict) -> bytes:
    payload = b"" if r.get("record_type") == "revisit" else r.get("payload") or b""
    digest = r.get("payload_digest")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = (b"WARC/1.1\r\n" + _header("WARC-Type", r.get("record_type")) + _header("WARC-Record-ID", _uri(r.get("record_id")))
            + _header("WARC-Target-URI", r.get("target_uri")) + _header("WARC-Refers-To", _uri(r.get("refers_to")))
            + (_header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
               if r.get("record_type") == "revisit" else b"")
            + _header("WARC-Payload-Digest",
                      digest and "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
            + _header("WARC-Payload-Length", None if r.get("payload_length") is None else str(r["payload_length"]))
            + b"Content-Type: application/http;msgtype=response\r\n"
            + f"Content-Length: {len(block)}\r\n\r\n".encode())
    return head + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field `sl` has its packed and plain length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.level = int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for start in range(0, batch.num_rows, 256):  # never a whole batch as Python objects
                    for r in batch.slice(start, 256).to_pylist():
                        if out is None:
                            files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                            out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                        member = _member(_record(r), self.level)
                        out.write(member)
                        size += len(member)
                        if size >= self.file_bytes:
                            out.close()
                            out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{uuid.uuid4().hex}{_LIST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a list are never read."""


# Reading

@dataclass
class Files(InputPartition):
    paths: list[str]


def _parse(head: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon:
            out.setdefault(k.strip().lower(), v.strip().decode("utf-8", "replace"))
    return out


def _field(h: dict[bytes, str], name: str):
    v = h.get(_HEAD[name])
    if v is None:
        return None
    if name in ("record_id", "refers_to"):
        return v.removeprefix("<").removesuffix(">")
    if name == "payload_digest":
        kind, _, d = v.partition(":")
        if kind.lower() != "sha1":
            return v
        try:
            return base64.b32decode(d).hex() if len(d) == 32 else d.lower()
        except ValueError:
            return v
    return int(v) if name == "payload_length" else v


def _body(block: bytes, h: dict[bytes, str]) -> bytes:
    """The payload: what follows the HTTP headers, or the block itself."""
    if not h.get(b"content-type", "").startswith("application/http"):
        return block
    _, gap, rest = block.partition(b"\r\n\r\n")
    return rest if gap else b""


class _Source:
    """A file read from `at` on, through a buffer."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self._start, self._held = file, 0, 0, b""

    def read(self, n: int) -> bytes:
        i = self.at - self._start
        if not 0 <= i <= len(self._held) or len(self._held) - i < n:
            self._start, self._held, i = self.at, self.file.read_at(max(n, 1 << 20), self.at), 0
        out = self._held[i:i + n]
        self.at += len(out)
        return out


def _members(f: _Source, wanted) -> Iterator[tuple[dict[bytes, str], bytes | None]]:
    """(headers, block or None) of each gzip record that `wanted(headers)`
    asks for: None leaves it out, False asks for the headers only."""
    while True:
        begin = f.at
        fixed = f.read(12)
        if len(fixed) < 12:
            return
        extra = f.read(struct.unpack("<H", fixed[10:12])[0]) if fixed[3] & 4 else b""
        packed = struct.unpack("<I", extra[4:8])[0] if extra[:2] == b"sl" and len(extra) >= 12 else None
        f.at = begin
        z, data, end = zlib.decompressobj(31), bytearray(), -1
        while end < 0 and not z.eof:
            chunk = z.unconsumed_tail or f.read(_BLOCK)
            if not chunk:
                return
            data += z.decompress(chunk, 4096)
            end = data.find(b"\r\n\r\n")
        head = _parse(bytes(data[:max(end, 0)]))
        ask = wanted(head)
        block = None
        if ask or not packed:
            while not z.eof:
                chunk = z.unconsumed_tail or f.read(_BLOCK)
                if not chunk:
                    break
                more = z.decompress(chunk, 1 << 20)
                if ask:
                    data += more
            if ask:
                block = bytes(data[end + 4:end + 4 + int(head.get(b"content-length", 0))])
        f.at = begin + packed if packed else f.at - len(z.unused_data)
        if ask is not None:
            yield head, block


def _plain(f: _Source, wanted) -> Iterator[tuple[dict[bytes, str], bytes | None]]:
    while True:
        while (mark := f.read(2)) == b"\r\n":
            pass
        begin, size, end = f.at - len(mark), 4096, -1
        while end < 0:
            f.at = begin
            data = f.read(size)
            end = data.find(b"\r\n\r\n")
            if end < 0 and len(data) < size:
                return
            size *= 2
        h = _parse(data[:end])
        f.at = begin + end + 4
        n = int(h.get(b"content-length", 0))
        ask = wanted(h)
        if ask is not None:
            yield h, f.read(n) if ask else None
        f.at = begin + end + 4 + n


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"].rstrip("/")
        self.names = [f.name for f in schema.fields]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.types = set(options["record_types"].split(",")) if options.get("record_types") else None
        self.tests: list[tuple[str, str, object]] = []
        if options.get("uri_prefix"):
            self.tests.append(("starts", "target_uri", options["uri_prefix"]))

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "record_type" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.types = values if self.types is None else self.types & values
            elif name in ("target_uri", "record_id", "refers_to") and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                kind = {EqualTo: "in", In: "in", StringStartsWith: "starts", IsNotNull: "set"}[type(f)]
                value = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else getattr(f, "value", None)
                self.tests.append((kind, name, value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, folder = _filesystem(self.path)
        found = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File}
        lists = [x for n, x in found.items() if n.endswith(_LIST)]
        if lists:
            names = {n for x in lists for n in json.loads(fs.open_input_stream(x.path).read())}
        else:
            names = {n for n in found if n.endswith((".warc", ".warc.gz"))}
        out, size = [], 0
        for n in sorted(names, key=lambda n: (-found[n].size, n)):
            if not out or size + found[n].size > self.split_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(found[n].path)
            size += found[n].size
        return out or [Files([])]

    def _wanted(self, h: dict[bytes, str]):
        if self.types is not None and h.get(b"warc-type") not in self.types:
            return None
        for kind, name, value in self.tests:
            v = _field(h, name)
            if v is None or kind == "in" and v not in value or kind == "starts" and not v.startswith(value):
                return None
        return "payload" in self.names

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for h, block in (_members if path.endswith(".gz") else _plain)(_Source(file), self._wanted):
                    rows.append({n: (_body(block, h) if h.get(b"warc-type") != "revisit" else None) if n == "payload"
                                 else _field(h, n) for n in self.names})
                    size += len(block or b"") + 500
                    if size >= _BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to, not overwritten")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format `warc` known; Spark asks for its push-down setting
    before it plans a reader that takes predicates."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# Pages

def archive(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html",
            least: int = 1000, path: str | None = None) -> str:
    """Writes a record for each page and gives the archive's folder.  Of pages
    with equal payloads of `least` bytes or more, that with the largest page_id
    (each of them, if repeated) is a response and the others revisit it; pages
    of equal payloads that all lack an id are responses."""
    spark = pages.sparkSession
    register(spark)
    path = qualified(spark, path or scratch(spark, "warc"))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                     F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    same = (p.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("c"))
            .filter("c > 1 and kept is not null").select("digest", "n", "kept"))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    p.join(same, ["digest", "n"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"), F.when(revisit, urn(F.col("kept"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"), F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload")).write.format("warc").mode("append").save(path)
    return path


def records(spark: SparkSession, path: str, page_type: str = "long") -> DataFrame:
    """page_id, target_uri, record_type, refers_to, payload, payload_bytes and
    payload_digest of the records; of responses, the last two are taken from
    the payload itself."""
    register(spark)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(.*)$', 1) as {page_type})")
    response = F.col("record_type") == "response"
    return spark.read.format("warc").load(qualified(spark, path)).select(
        page("record_id").alias("page_id"), "target_uri", "record_type", page("refers_to").alias("refers_to"), "payload",
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"))
