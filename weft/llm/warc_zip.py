"""WARC records in ZIP packages: writing with revisit records, and reading by ranges.

Writing puts every page into a WARC record: of pages with equal payloads the one with the smallest id
is a response, the others are revisits that refer to it. A task writes packages of bounded size, each
with a gzipped WARC member (a gzip member for each record) and a sorted CDXJ index of the records'
offsets and lengths, both stored without compression, so that records can be read in place.

Reading never extracts a package. A task opens it at its end, parses the end record, the ZIP64 locator
and end record where they are needed, and the central directory; finds all stored archives
(``archive/*.warc.gz``, ``*.warc``) and indexes (``indexes/*.cdx``, ``*.cdxj``, gzipped or not) through
their local headers; and goes through the indexes' lines. An archive that no line refers to, and a line
of an archive that isn't there, are errors. The records' ranges are then dealt out, and neighbouring ones
are read together. Digests of responses are checked against their payloads. Packages of other writers
may name records by other ids (page_id is null then), have several archives and indexes, CDX lines whose
header names the fields, no lengths (a record ends where the next one begins), and names in code page 437.

Files are reached through pyarrow's file systems (local and shared folders, S3, GCS, HDFS).

Defined cases: null html is the empty payload; very long payloads are held whole, a few times over, in one
task, and are records of their own package size; null ids sort last among equal payloads and are written
as such; pages with one id and equal payloads are all responses if theirs is the smallest id; a null url
is left out of the record; repeated rows each get a record; an empty table gives packages of no records or
none, and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, fresh_path, materialise

ID, DATE = "urn:x-page:", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Names of archives and indexes in a package.
ARCHIVES, INDEXES = re.compile(r"archive/.*\.warc(\.gz)?"), re.compile(r"indexes/.*\.cdxj?(\.gz)?")
#: Bytes after which a new package is begun, and bytes of neighbouring records that are read together.
PACKAGE_BYTES, RANGE_BYTES = 1 << 28, 1 << 20
#: Bytes of records that a reading task gets on average, until there are as many tasks for each core.
TASK_BYTES, TASKS_A_CORE = 1 << 23, 64


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1, by five hexadecimal digits at a time."""
    hex_ = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# -- records -------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record, gzipped."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes) -> dict:
    """A record's page, url, kind, digest, payload length and referred page; responses with a SHA-1 are checked."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind, digest = h["warc-type"], h.get("warc-payload-digest")
    name, _, value = digest.partition(":") if digest else ("", "", None)
    if kind == "revisit":  # headers of the response that it repeats
        payload, size = None, headers(http).get("content-length")
        size = int(size) if size else None
    else:
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if kind == "response" and name.lower() == "sha1" and value.upper() != own:
            raise ValueError(f"{h['warc-record-id']}: the payload doesn't have its digest")
        value = value if name.lower() == "sha1" else own
    page = lambda s: int(t) if s and (t := s.strip("<>")).startswith(ID) and (t := t.removeprefix(ID)) else None
    return {
        "page_id": page(h["warc-record-id"]), "payload_bytes": size, "payload_digest": value, "record_type": kind,
        "refers_to": page(h.get("warc-refers-to")), "url": h.get("warc-target-uri"), "payload": payload,
    }


# -- writing -------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = 0, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): the records that pages become.

    The smallest id of each digest comes from partial minima and is materialised; the join with it
    takes each payload along once, and Spark can split a digest that very many pages share.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    first = materialise(rows.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first-ids")
    repeats = (F.octet_length("payload") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "digest").select(
        "page_id", "url", "payload", "digest", F.when(repeats, "revisit").otherwise("response").alias("kind"), F.when(repeats, F.col("first_id")).alias("refers_to")
    )


def sort_key(url: str | None) -> str:
    """The key that index lines are sorted by: the host's labels from the last to the first, then the rest; without blanks."""
    host, slash, path = re.sub(r"^[^/]*://", "", url or "").partition("/")
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in f"{','.join(reversed(host.lower().split('.')))}){slash}{path}")


class Package:
    """A ZIP package that is written in one pass."""

    def __init__(self, folder: str):
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"  # each attempt of a task has its own; only finished ones are listed
        self.path = f"{folder}/{name}"
        self.stream = system.open_output_stream(f"{root}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, url: str | None, digest: str, data: bytes) -> None:
        self.member.write(data)
        at = {"url": url or "", "digest": f"sha1:{digest}", "offset": str(self.size), "length": str(len(data)), "filename": WARC_MEMBER.rpartition("/")[2]}
        self.index.append(f"{sort_key(url)} {''.join(c for c in DATE if c.isdigit())} {json.dumps(at)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(sorted(self.index)))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index), self.size


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes packages below ``folder``; (path, records, bytes) of those that finished tasks have written."""

    def run(batches):
        package, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "kind", "refers_to"))):
                package = package or Package(folder)
                package.add(url, digest, record(page_id, url, payload, digest, kind, refers_to))
                if package.size > PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        columns = zip(*done) if done else ((), (), ())
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "records", "bytes"])

    return materialise(records.mapInArrow(run, "path string, records long, bytes long"), "packages")


# -- reading -------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def directory(file, size: int) -> list[Member]:
    """The members that the central directory lists, with ZIP64 values where the short ones are full."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail_at + at - 20
        found = file.read_at(20, locator)
        if found[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = file.read_at(56, struct.unpack_from("<Q", found, 8)[0])
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    data, out, p = file.read_at(length, start), [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        stored, full, n, extra, note = struct.unpack_from("<IIHHH", data, p + 20)
        header, = struct.unpack_from("<I", data, p + 42)
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        x, end = p + 46 + n, p + 46 + n + extra
        while x + 4 <= end:
            kind, width = struct.unpack_from("<HH", data, x)
            if kind == 1:  # in this order, only those that are full above
                values = iter(struct.unpack_from(f"<{width // 8}Q", data, x + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                stored = next(values) if stored == 0xFFFFFFFF else stored
                header = next(values) if header == 0xFFFFFFFF else header
            x += 4 + width
        out.append(Member(name, method, full, stored, header))
        p = end + note
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0 or member.size != member.stored:
        raise ValueError(f"{member.name} is compressed and can't be read in place")
    local = file.read_at(30, member.header)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    name, extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name + extra


def lines_of(file, member: Member, piece: int = 1 << 22) -> Iterator[str]:
    """The lines of a stored member, gunzipped where its name says so, a piece at a time."""
    at, left, rest = data_start(file, member), member.size, b""
    unzip = zlib.decompressobj(31) if member.name.endswith(".gz") else None
    while left:
        data = file.read_at(min(piece, left), at)
        at, left = at + len(data), left - len(data)
        if unzip:
            parts = []
            while data:
                parts.append(unzip.decompress(data))
                data = unzip.unused_data
                if unzip.eof:  # another gzip member may follow
                    unzip = zlib.decompressobj(31)
            data = b"".join(parts)
        *lines, rest = (rest + data).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in lines)
    if rest:
        yield rest.decode("utf-8", "replace")


def entries_of(lines: Iterator[str]) -> Iterator[tuple[str | None, int, int | None]]:
    """(file name, offset, length) of the lines of a CDX or CDXJ index; names and lengths may be missing."""
    fields: list[str] | None = None
    for line in lines:
        if not line.strip() or line.startswith("!"):
            continue
        if line.strip().startswith("CDX "):
            fields = line.split()[1:]
        elif (brace := line.find("{")) >= 0 and fields is None:
            entry = json.loads(line[brace:])
            length = entry.get("length")
            yield entry.get("filename"), int(entry["offset"]), int(length) if length not in (None, "", "-") else None
        elif fields is None:
            raise ValueError("an index without lines of CDXJ or a header of CDX")
        else:
            entry = dict(zip(fields, line.split()))
            length = entry.get("S", "-")
            yield entry.get("g"), int(entry["V"]), int(length) if length != "-" else None


def index_of(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of each record, from the package's indexes."""
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        members = directory(file, file.size())
        archives = {m.name.rpartition("/")[2]: m for m in members if ARCHIVES.fullmatch(m.name)}
        starts = {n: data_start(file, m) for n, m in archives.items()}
        met, open_ended = set(), {}
        for member in members:
            if not INDEXES.fullmatch(member.name):
                continue
            for of, offset, length in entries_of(lines_of(file, member)):
                of = of.rpartition("/")[2] if of else next(iter(archives)) if len(archives) == 1 else None
                if of not in archives:
                    raise ValueError(f"{path}: {member.name} refers to the archive {of}, which isn't there")
                met.add(of)
                if length is None:
                    open_ended.setdefault(of, set()).add(offset)
                else:
                    yield starts[of] + offset, length
        if missed := [n for n, m in archives.items() if m.size and n not in met]:
            raise ValueError(f"{path}: no index covers {missed}")
        for of, offsets in open_ended.items():  # a record without length ends where the next begins
            edges = [*sorted(offsets), archives[of].size]
            yield from ((starts[of] + a, b - a) for a, b in zip(edges, edges[1:]))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(spark: SparkSession, packages: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of the packages at column ``path``, in any order; the payload of revisits is null."""

    def locate(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                entries = index_of(path)
                while found := list(islice(entries, 50_000)):
                    offset, length = (pa.array(c, pa.int64()) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), offset, length], ["path", "offset", "length"])

    names = [f.split()[0] for f in READ.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def fetch(batches):
        opened: dict[str, object] = {}
        for batch in batches:
            ranges = list(zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            a = 0
            while a < len(ranges):  # neighbours up to RANGE_BYTES
                b, (path, start, length) = a + 1, ranges[a]
                end = start + length
                while b < len(ranges) and ranges[b][0] == path and ranges[b][1] == end and end - start < RANGE_BYTES:
                    end += ranges[b][2]
                    b += 1
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    system, name = file_system(path)
                    opened = {path: system.open_input_file(name)}
                data = opened[path].read_at(end - start, start)
                rows = [parse(data[o - start : o - start + n]) for _, o, n in ranges[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names)
                a = b
        for f in opened.values():
            f.close()

    located = packages.select("path").repartition(F.col("path")).mapInArrow(locate, "path string, offset long, length long")
    located = materialise(located, "located").distinct()  # several indexes may list a record
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(most, -(-(located.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)))
    # by number, as the ranges say nothing of the bytes behind them
    dealt = located.repartition(tasks, F.col("path"), F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(fetch, READ + ", payload binary" * with_payload)


def archive(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Pages written to packages and read back, without payloads and urls."""
    spark = pages.sparkSession
    bounded_batches(spark)
    packages = write(with_revisits(pages, least_bytes), folder or fresh_path(spark, "wacz"))
    return read(spark, packages).drop("url")
