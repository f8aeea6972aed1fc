"""WARC: a Python data source that writes and reads web archives, and the choice of revisit records.

Writing: one gzip member a record, each with the compressed length of its member in a gzip extra field (``sl``), so a reader can step over a record without
inflating it. A task writes a file under a name of its own; the commit lists the files that count, with places where large ones can be cut, and
readers of the folder read those alone, so what lost or repeated tasks leave is never read.

Reading: files are planned into partitions of about ``partition_bytes`` (large ones cut where the commit says, foreign ones whole). Predicates on header columns
are pushed down; a record's headers are parsed first, and the payload of a record that fails them is neither inflated nor decoded.
Files are reached with ``pyarrow.fs``, so a path may be local or a URI that it knows (file, hdfs, s3, gs).

Edge cases: a null payload is empty; a null url leaves its header out; control bytes in a url are percent-encoded; pages without an id come last among equal
payloads; repeated rows are records of their own, all but the first of them revisits. An empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import HOT, bounded_batches, hot_join, placed, stash

#: The profile that a revisit names, and the columns that are read from headers alone.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type", "content_length": "content-length"}
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, content_length long, headers map<string,string>, payload_bytes long, payload binary"
PIECE = 1 << 16


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int) -> bytes:
    """``record`` as one gzip member that names its own compressed and plain length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if len(body) >= 1 << 32 or len(record) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body), len(record)) + body + tail


def record(record_id: str, record_type: str, uri: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """One record. A revisit holds the HTTP headers of its payload alone; digest and length there are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if record_type == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


# --- writing --------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, record_type, target_uri, refers_to, payload) as records; options ``date``, ``level``, ``partition_bytes``."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date, self.level = options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", 6))
        self.cut = int(options.get("partition_bytes", 64 << 20))

    def write(self, iterator):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in iterator:
                cols = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload")]
                for i in range(batch.num_rows):
                    rid, kind, uri, refers, payload = (c[i].as_py() for c in cols)
                    payload = payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else payload or b""
                    data = member(record(rid, kind, uri, refers, payload, self.date), self.level)
                    if at - cuts[-1] >= self.cut:
                        cuts.append(at)
                    out.write(data)
                    at += len(data)
        return Written(name, at, cuts)

    def commit(self, messages):
        fs, path = filesystem(self.path)
        before = committed(fs, path) if self.overwrite else {}
        with fs.open_output_stream(f"{path}/_committed-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([[m.name, m.size, m.cuts] for m in messages if m and m.size]).encode())
        for name in before:
            fs.delete_file(f"{path}/{name}")

    def abort(self, messages):
        fs, path = filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{path}/{m.name}")


def committed(fs: pafs.FileSystem, path: str) -> dict[str, list]:
    """Files by commit list; a list itself is among the names, with no contents."""
    out: dict[str, list] = {}
    for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith("_committed-"):
            out[f.base_name] = []
            with fs.open_input_stream(f.path, compression=None) as data:
                out |= {n: [size, cuts] for n, size, cuts in json.loads(data.read())}
    return out


# --- reading --------------------------------------------------------------------------------------


@dataclass
class Ranges(InputPartition):
    """(file, first byte, end; None: the file's) of one partition."""

    parts: list

    def __init__(self, parts: list):
        self.parts = parts


class Input:
    """Bytes of an open file from ``at``, read in pieces; skipping seeks."""

    def __init__(self, file, at: int, end: int):
        self.raw, self.end, self.at = file, end, at
        self.held, self.i = b"", 0
        file.seek(at)

    def read(self, n: int) -> bytes:
        if len(self.held) - self.i < n:
            rest = self.held[self.i :]
            self.held = rest + self.raw.read(max(n - len(rest), 1 << 20))
            self.i = 0
        out = self.held[self.i : self.i + n]
        self.i += len(out)
        self.at += len(out)
        return out

    def unread(self, data: bytes) -> None:
        self.i -= len(data)
        self.at -= len(data)

    def skip(self, n: int) -> None:
        if len(self.held) - self.i >= n:
            self.i += n
        else:
            self.raw.seek(self.at + n)
            self.held, self.i = b"", 0
        self.at += n


GAP = re.compile(rb"\r?\n\r?\n")


class Plain:
    """One record of an uncompressed archive: ``head`` gives its bytes up to a blank line (at most ``most``), ``pull`` some more, ``leave`` steps over the rest."""

    def __init__(self, source: Input):
        self.source = source

    def head(self, most: int) -> bytes:
        data = b""
        while True:
            piece = self.source.read(min(1 << 13, most - len(data)))
            data += piece
            m = GAP.search(data, max(0, len(data) - len(piece) - 3))
            if m or not piece or len(data) == most:
                end = m.end() if m else len(data)
                self.source.unread(data[end:])
                return data[:end]

    def pull(self, n: int) -> bytes:
        return self.source.read(n)

    def leave(self, left: int) -> None:
        self.source.skip(left)


class Member:
    """One gzip member: inflated as far as it is asked for; the rest is stepped over by its stated length, or inflated where none is stated."""

    def __init__(self, source: Input):
        head = source.read(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {source.at - len(head)}")
        flags, self.stated = head[3], None
        if flags & 4:
            (n,) = struct.unpack("<H", source.read(2))
            extra = source.read(n)
            while len(extra) >= 4:
                kind, size = struct.unpack("<2sH", extra[:4])
                if kind == b"sl" and size >= 8:
                    self.stated = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for bit in (8, 16):  # a name, a comment
            while flags & bit and source.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            source.read(2)
        self.source, self.inflate, self.taken, self.held = source, zlib.decompressobj(-15), 0, b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail
        if not data:
            size = PIECE if self.stated is None else min(PIECE, self.stated - self.taken)
            data = self.source.read(size)
            self.taken += len(data)
            if not data:
                raise ValueError("a gzip member ends early")
        self.held += self.inflate.decompress(data, 4 * PIECE)
        return True

    def head(self, most: int) -> bytes:
        at = 0
        while not (m := GAP.search(self.held, at)) and len(self.held) < most:
            at = max(0, len(self.held) - 3)
            if not self._more():
                break
        end = min(m.end() if m else len(self.held), most)
        out, self.held = self.held[:end], self.held[end:]
        return out

    def pull(self, n: int) -> bytes:
        parts, need = [], n
        while True:
            parts.append(self.held[:need])
            need -= len(parts[-1])
            self.held = self.held[len(parts[-1]) :]
            if not need or not self._more():
                return b"".join(parts)

    def leave(self, left: int) -> None:
        if self.stated is not None:
            self.source.skip(self.stated - self.taken + 8)
            return
        while self._more():
            self.held = b""
        self.source.unread(self.inflate.unused_data)
        self.source.skip(8)


#: Headers are no longer than this.
MOST = 1 << 20


def headers_of(data: bytes) -> tuple[str, dict[str, str]]:
    """First line and headers (lower-case names, the first of a repeated one; folded lines joined)."""
    lines = re.sub(r"\r?\n[ \t]+", " ", data.decode("utf-8", "surrogateescape").strip()).split("\n")
    found: dict[str, str] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return lines[0].strip(), found


def value_of(column: str, headers: dict[str, str]):
    v = headers.get(HEADERS[column])
    if v is None:
        return None
    if column == "content_length":
        return int(v)
    return v.strip("<>") if column in ("record_id", "refers_to", "target_uri") else v.removeprefix("sha1:") if column == "payload_digest" else v


#: What is pushed down, on header columns; strings order by bytes in Spark and by code point here, which is the same.
TESTS = {
    EqualTo: lambda a, f: a is not None and a == f.value, EqualNullSafe: lambda a, f: a == f.value, In: lambda a, f: a is not None and a in f.value,
    GreaterThan: lambda a, f: a is not None and a > f.value, GreaterThanOrEqual: lambda a, f: a is not None and a >= f.value,
    LessThan: lambda a, f: a is not None and a < f.value, LessThanOrEqual: lambda a, f: a is not None and a <= f.value,
    StringStartsWith: lambda a, f: a is not None and a.startswith(f.value), StringEndsWith: lambda a, f: a is not None and a.endswith(f.value), StringContains: lambda a, f: a is not None and f.value in a,
    IsNull: lambda a, f: a is None, IsNotNull: lambda a, f: a is not None,
}


class WarcReader(DataSourceReader):
    """Options: ``path`` (a file or a folder), ``partition_bytes``, ``payload`` (false: the column stays null), ``verify`` (true: payload digests are computed again)."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("partition_bytes", 64 << 20))
        self.payload, self.verify = options.get("payload", "true").lower() == "true", options.get("verify", "false").lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            return [Ranges([(path, 0, info.size)])]
        listed = committed(fs, path)
        if listed:
            parts = []
            for name, found in listed.items():
                if found:
                    size, cuts = found
                    parts += [(f"{path}/{name}", a, b) for a, b in zip(cuts, [*cuts[1:], size])]
        else:
            found = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.base_name) and f.base_name[0] not in "._"]
            parts = [(f.path, 0, f.size) for f in found]
        out, total = [[]], 0
        for p in sorted(parts):
            if out[-1] and total + p[2] - p[1] > self.size:
                out.append([])
                total = 0
            out[-1].append(p)
            total += p[2] - p[1]
        return [Ranges(p) for p in out]

    def read(self, partition):
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        for path, at, end in partition.parts:
            with fs.open_input_file(path) as file:
                source = Input(file, at, end)
                kind = Member if path.endswith(".gz") else Plain
                while source.at < end:
                    found = self.one(kind(source))
                    if found:
                        rows.append(found)
                        held += len(found[-1] or b"")
                    if len(rows) >= 256 or held > 1 << 24:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def one(self, rec):
        """The row of a record, or None if its headers fail the filters or nothing but line ends is left; steps to the next one."""
        first, headers = headers_of(rec.head(MOST))
        if not first:
            if isinstance(rec, Member):
                rec.leave(0)
            return None
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        left = int(headers["content-length"])
        if not all(TESTS[type(t)](value_of(t.attribute[0], headers), t) for t in self.tests):
            rec.leave(left + 4)
            return None
        kind, size, payload = headers.get("warc-type"), left, None
        digest = value_of("payload_digest", headers)
        if headers.get("content-type", "").startswith("application/http"):
            data = rec.head(left)
            _, http = headers_of(data)
            left -= len(data)
            size = int(http.get("content-length", left)) if kind == "revisit" else left
        if (self.payload or self.verify) and kind != "revisit":
            payload = rec.pull(left)
            left = 0
            if self.verify and digest is not None and digest != sha1_base32(payload):
                raise ValueError(f"the payload of {headers.get('warc-record-id')} has another digest")
        rec.leave(left + 4)
        return (*(value_of(c, headers) for c in HEADERS), list(headers.items()), size, payload if self.payload else None)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = [text] * 7 + [pa.int64(), pa.map_(text, text), pa.int64(), pa.binary()]
    names = [*HEADERS, "headers", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


# --- revisits -------------------------------------------------------------------------------------


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload) of ``pages`` (page_id, url, html): of equal payloads of ``least_bytes`` or more, the one of least
    page_id is the response and the others revisit it. Payloads are compared by SHA-256 and length; the response of each is found by partial aggregation."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    x = placed(pages, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    x = x.withColumn("key", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html"))
    name = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rf", "ri")
    first = x.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.min(name).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = stash(first, "warc-first")
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    x = hot_join(x, first, ["key", "size"], F.col("copies") > max(total, 1) * HOT, ["rf", "ri"], "left")
    urn = lambda p: F.concat_ws(":", F.lit("urn:page"), F.coalesce(p("page_id").cast("string"), F.lit("")), p("rf"), p("ri"))
    own, other = urn(F.col), urn(lambda c: F.col(f"first.{c}"))
    again = F.col("first").isNotNull() & ~((F.col("first.rf") == F.col("rf")) & (F.col("first.ri") == F.col("ri")))
    return x.select(own.alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.when(again, other).alias("refers_to"), F.col("html").alias("payload"))


def page_of(urn: str):
    """The page id in a record's name."""
    return F.get(F.split(urn, ":"), F.lit(2)).cast("long")


def write(records: DataFrame, path: str, **options) -> None:
    bounded_batches(records.sparkSession)
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)
