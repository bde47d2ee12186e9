"""WARC archives as a Spark data source, and archives of pages with revisits.

Reading plans a partition for each archive file, takes predicates on record headers, and parses a record's
header before anything else: the payload of a record that no predicate wants, or of any record when payloads
are not asked for, is skipped by its stored length and never decoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from foliospark.llm.common import cut, qualified, shared_dir, sized

SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, "
    "headers map<string,string>, content_length long, payload binary, payload_sha1 string"
)
#: Column of the schema -> header field.
FIELDS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
FILE_BYTES = 128 << 20
_BATCH_BYTES = 8 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MEMBER = struct.Struct("<4sIBBH2sHII")  # gzip header with an "sl" extra field: compressed and plain length


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open_fs(path: str):
    scheme, colon, rest = path.partition(":")
    if colon and rest.startswith("/") and not rest.startswith("//"):  # as Hadoop writes local paths
        path = f"{scheme}://{rest}"
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _member(data: bytes) -> bytes:
    """A gzip member that says its own length, so that readers can step over it."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return " ".join(value.split())


@dataclass
class _Files(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    """Appends files under names of their own; only those that a manifest lists, written at commit, are part of the archive."""

    def __init__(self, path: str):
        self.path = path

    def _record(self, row: dict) -> bytes:
        payload = row.get("payload") or b""
        kind = row.get("warc_type") or "resource"
        block = _HTTP + payload if kind == "response" else _HTTP if kind == "revisit" else payload
        head = {field: row[col] for col, field in FIELDS.items() if row.get(col)}
        if (digest := head.get(FIELDS["payload_digest"], "")).startswith("sha1:") and len(digest) == 45:  # hex, as Spark gives it
            head[FIELDS["payload_digest"]] = f"sha1:{base64.b32encode(bytes.fromhex(digest[5:])).decode()}"
        head |= {k: v for k, v in (row.get("headers") or []) if v is not None}
        head |= {"Content-Type": "application/http; msgtype=response" if kind in ("response", "revisit") else "application/octet-stream", "Content-Length": str(len(block))}
        lines = "".join(f"{_clean(k)}: {_clean(v)}\r\n" for k, v in head.items())
        return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"

    def write(self, iterator):
        fs, base = _open_fs(self.path)
        fs.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                data = _member(self._record(row))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Files(names)

    def commit(self, messages):
        fs, base = _open_fs(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        fs, base = _open_fs(self.path)
        for m in messages:
            for n in m.names if m else ():
                fs.delete_file(f"{base}/{n}")


@dataclass
class _File(InputPartition):
    name: str


class _Input:
    """Bytes of an archive file: peeked at, decoded or stepped over."""

    def __init__(self, source):
        self.source, self.held = source, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.source.read(max(1 << 20, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        data = self.peek(n)
        self.held = self.held[len(data):]
        return data

    def skip(self, n: int) -> None:
        inside = min(n, len(self.held))
        self.held = self.held[inside:]
        if n > inside:
            self.source.seek(n - inside, 1)


class _Member:
    """The plain bytes of the gzip member that begins where ``data`` (an _Input) stands, decoded as they are read."""

    def __init__(self, data: _Input):
        self.data, self.inflate = data, zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while not self.inflate.eof:
            taken = self.inflate.unconsumed_tail or self.data.take(1 << 18)
            if not taken:
                break
            plain = self.inflate.decompress(taken, n)
            if self.inflate.eof:  # what is beyond the member goes back
                self.data.held = self.inflate.unused_data + self.data.held
            if plain:
                return plain
        return b""

    def seek(self, n: int, whence: int) -> None:
        while n > 0 and (plain := self.read(min(n, 1 << 20))):
            n -= len(plain)


class Header(list):
    """(name, value) of a record's header as written; names are looked up in any case, the first of a name counts."""

    def get(self, name: str, other: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), other)

    @property
    def length(self) -> int:
        n = self.get("Content-Length", "")
        return int(n) if n.isascii() and n.isdigit() else 0

    def joined(self) -> list[tuple[str, str]]:
        """Names as first written, each with all its values, joined by commas."""
        out: dict[str, tuple[str, list[str]]] = {}
        for k, v in self:
            out.setdefault(k.lower(), (k, []))[1].append(v)
        return [(k, ", ".join(v)) for k, v in out.values()]


def _split_head(data: bytes) -> tuple[Header, int] | None:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    pairs = (line.partition(":") for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:])
    return Header((k.strip(), v.strip()) for k, _, v in pairs if k.strip()), end + 4


def _plain_records(data: _Input, wanted, with_payload):
    """(header, block or None) of the plain records one after another, however long a header is."""
    while first := data.peek(2):
        if first == b"\r\n":
            data.skip(2)
            continue
        if first == b"\x1f\x8b":
            return
        n = 1 << 12
        while (got := _split_head(data.peek(n))) is None:
            if len(data.held) < n:
                return  # no record: what is left has no end of a header
            n *= 4
        head, at = got
        data.skip(at)
        if wanted(head) and with_payload(head):
            yield head, data.take(head.length)
            continue
        data.skip(head.length)
        if wanted(head):
            yield head, None


def _sized_head(data: _Input, size: int, plain: int):
    """The header of a member that states its lengths, if that is of one record: of it alone is decoded as much as the header needs."""
    n = 1 << 13
    while True:
        some = zlib.decompressobj(31).decompress(data.peek(min(n, size)), n)
        if got := _split_head(some):
            head, at = got
            return got if at + head.length + 4 >= plain else None
        if len(some) >= plain or (n >= size and len(some) < n):
            return None
        n *= 4


def _records(source, wanted, with_payload):
    """(header, block or None) of the records whose header is ``wanted``: of plain files, of members of one record that state their length, which are stepped over, and of any others."""
    data = _Input(source)
    while first := data.peek(_MEMBER.size):
        if first[:2] != b"\x1f\x8b":
            yield from _plain_records(data, wanted, with_payload)
            if data.peek(2) != b"\x1f\x8b":
                return
            continue
        if len(first) == _MEMBER.size and first[:4] == b"\x1f\x8b\x08\x04" and (parts := _MEMBER.unpack(first))[5] == b"sl" and (got := _sized_head(data, *parts[7:])):
            if wanted(got[0]) and with_payload(got[0]):
                plain = zlib.decompress(data.take(parts[7]), 31)
                yield got[0], plain[got[1]:got[1] + got[0].length]
            else:
                data.skip(parts[7])
                if wanted(got[0]):
                    yield got[0], None
            continue
        member = _Member(data)
        yield from _plain_records(_Input(member), wanted, with_payload)
        member.seek(1 << 62, 1)  # to the end of the member


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, (EqualTo, In, IsNotNull)):
                self.tests.append((FIELDS[name], None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        fs, base = _open_fs(self.path)
        found = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(base))]
        listed = []
        for n in (n for n in found if n.startswith("manifest-")):
            with fs.open_input_stream(f"{base}/{n}", compression=None) as data:
                listed += json.loads(data.read())
        return [_File(n) for n in sorted(listed or [n for n in found if n.endswith((".warc", ".warc.gz"))])] or [_File("")]

    def read(self, partition):
        if not partition.name:
            return
        schema = pa.schema([(c, pa.string()) for c in FIELDS] + [("headers", pa.map_(pa.string(), pa.string())), ("content_length", pa.int64()), ("payload", pa.binary()), ("payload_sha1", pa.string())])
        fs, base = _open_fs(self.path)
        wanted = lambda h: all(h.get(k) is not None if v is None else h.get(k) in v for k, v in self.tests)
        with_payload = lambda h: self.payload and h.get("WARC-Type") != "revisit"
        rows, size = [], 0
        with fs.open_input_file(f"{base}/{partition.name}") as source:
            for head, block in _records(source, wanted, with_payload):
                payload = block
                if block is not None and head.get("WARC-Type") == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                row = {c: head.get(f) for c, f in FIELDS.items()}
                row |= {"headers": head.joined(), "content_length": head.length, "payload": payload, "payload_sha1": None if payload is None else base32_sha1(payload)}
                rows.append(row)
                size += 1000 + len(payload or b"")
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)``; ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


def page_records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of ``pages`` (page_id, url, html; other columns are not read) for the archive writer.

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest page_id is a response and the
    others revisit it; shorter ones are all responses. Null html is an empty payload. Rows that share a
    page_id and a payload are marked alike. A null page_id is never revisited: among null ids alone, all are
    responses. Null urls get a placeholder URI. No pages give no records.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "size": F.length("payload")})
    shared = rows.filter(F.col("size") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.filter("n > 1 AND first IS NOT NULL").select("key", "first"), "warc-shared")
    placed = rows.join(sized(shared), "key", "left")
    again = F.col("first").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.map_filter(F.create_map(
        F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("X-Payload-Length"), F.col("size").cast("string"),
        F.lit("X-Refers-To-Page"), F.when(again, F.col("first").cast("string")), F.lit("WARC-Profile"), F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    ), lambda k, v: v.isNotNull())
    return placed.select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(F.col("url"), urn(F.col("page_id"))).alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), F.sha1("payload")).alias("payload_digest"), F.when(again, urn(F.col("first"))).alias("refers_to"),
        head.alias("headers"), F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Write a record for every page; returns the archive's path, by default a new one in the shared folder."""
    path = qualified(pages.sparkSession, path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)
    return path


def page_index(records: DataFrame) -> DataFrame:
    """The contract's columns, from records read back: of responses by their decoded payloads, of revisits by their headers."""
    header = lambda k: F.element_at("headers", k)
    return records.select(
        header("X-Page-Id").cast("long").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), header("X-Payload-Length").cast("long")).alias("payload_bytes"),
        F.coalesce("payload_sha1", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), header("X-Refers-To-Page").cast("long").alias("refers_to"),
    )
