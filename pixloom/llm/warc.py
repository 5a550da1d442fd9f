"""Web archives: writing legacy ARC (versions 1 and 2), converting ARC to WARC 1.1 with revisits, reading both.

Archives are written as gzip members, one a record, so that a record can be read alone; ARC files that are read may be packed
otherwise, or not at all. Archives live in a
folder that all executors share. A task names its file with a fresh uuid and closes it before it reports it, and only
reported files are read, so a task that is lost or runs twice leaves nothing that counts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored

# Fixed values of the ARC and WARC formats.
ARC_V1_NAMES = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2_NAMES = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
_PAGE = b"X-Page-Id"


# ---- files -------------------------------------------------------------------------------------------------------


def _open(uri: str, mode: str):
    """A local file, or one of another store through Arrow's file systems."""
    if uri.startswith("file:"):
        return open(uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file://") else uri.removeprefix("file:"), mode)
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if "w" in mode else system.open_input_file(path)


def member(record: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members(stream, block: int = 1 << 18) -> Iterator[bytes]:
    """The record of each gzip member; memory is bounded by the largest record."""
    rest = b""
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest and not (rest := stream.read(block)):
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


class Plain:
    """The bytes of an archive, uncompressed or in gzip members of whatever content, by lines and lengths."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.held, self.at, self.offset = stream, block, b"", 0, 0
        self.packed = stream.read(2)
        self.unpack = zlib.decompressobj(31) if self.packed == b"\x1f\x8b" else None

    def _more(self) -> bool:
        """One more block of bytes, if there is any."""
        raw, self.packed = self.packed or self.stream.read(self.block), b""
        if not raw:
            if self.unpack is not None and not self.unpack.eof and self.offset + len(self.held) - self.at:
                raise ValueError("the archive ends within a gzip member")
            return False
        if self.unpack is not None:
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            out = [self.unpack.decompress(raw)]
            while self.unpack.unused_data:
                raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
                out.append(self.unpack.decompress(raw))
            raw = b"".join(out)
        self.held, self.at = self.held[self.at :] + raw, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; null at the end of the archive."""
        sought = self.at
        while (end := self.held.find(b"\n", sought)) < 0:
            sought = len(self.held) - self.at
            if not self._more():
                end = len(self.held)
                if end == self.at:
                    return None
                break
        found, self.offset, self.at = self.held[self.at : end], self.offset + end + 1 - self.at, end + 1
        return found

    def take(self, n: int) -> bytes:
        """The next n bytes, or as many as there are."""
        parts, size = [self.held[self.at : self.at + n]], min(n, len(self.held) - self.at)
        self.at += size
        while size < n:
            self.held, self.at = b"", 0
            if not self._more():
                break
            parts.append(self.held[: n - size])
            self.at = len(parts[-1])
            size += self.at
        self.offset += size
        return b"".join(parts)


# ---- ARC ---------------------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    fields: dict[str, str]


def arc_file_header(version: int, name: str, date: str) -> bytes:
    """The version block that begins an ARC file."""
    names = ARC_V1_NAMES if version == 1 else ARC_V2_NAMES
    body = f"{version} 0 pixloom\n{names}\n".encode()
    tail = str(len(body)) if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, ip: str = "0.0.0.0", content_type: str = "text/html", name: str = "-", offset: int = 0) -> bytes:
    tail = str(len(block)) if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}"
    return f"{url} {ip} {date} {content_type} {tail}\n".encode() + block + b"\n"


def parse_header(line: bytes, names: list[str]) -> dict[str, str]:
    """The fields of a record's header line, as named by its file's version block.

    A URL may hold spaces in careless archives, so fields are counted from the right.
    """
    parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"an ARC header line of {len(parts)} fields, {len(names)} are declared")
    return dict(zip(names, parts, strict=True))


def read_arc(stream) -> Iterator[tuple[int, ArcRecord]]:
    """(offset, record) of each record after the version block, for either version; offsets count unpacked bytes.

    The declared length says where a record ends, so a file may be uncompressed, hold one record or several in a gzip
    member, or a record over several.
    """
    plain, names = Plain(stream), []
    while True:
        at = plain.offset
        line = plain.line()
        if line is None:
            return
        if not line.strip():
            continue  # between records
        if not names:
            body = plain.take(int(line.rsplit(b" ", 1)[1])).split(b"\n")
            if body[0].split(b" ")[0] not in (b"1", b"2"):
                raise ValueError(f"ARC version {body[0]!r}")
            names = body[1].decode().rstrip("\r").split(" ")
            continue
        fields = parse_header(line, names)
        length = int(fields[names[-1]])
        block = plain.take(length)
        if len(block) < length:
            raise ValueError(f"an ARC record of {len(block)} bytes, {length} are declared")
        yield at, ArcRecord(fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], block, fields)


# ---- WARC --------------------------------------------------------------------------------------------------------


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"" if page_id is None else b"%s: %d\r\n" % (_PAGE, page_id)
    return head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def split_http(block: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """Header fields, the header with its blank line, and the body; a block without HTTP header is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    return fields, head + b"\r\n\r\n", body


def warc_date(arc_date: str) -> str:
    """ARC's 14 digits (shorter ones are filled) as a WARC timestamp."""
    digits = (arc_date + "19700101000000"[len(arc_date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, page_id: int | None) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{date} {page_id} {url}')}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def convert_record(record: ArcRecord, refers_to: dict | None) -> bytes:
    """The WARC record that says what an ARC record said; with ``refers_to`` a revisit, without its payload."""
    http, head, body = split_http(record.block)
    page = _page_id(http)
    fields = {
        "WARC-Record-ID": record_id(record.url, record.date, page), "WARC-Date": warc_date(record.date), "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip, "WARC-Payload-Digest": f"sha1:{hashlib.sha1(body).hexdigest()}",
        "Content-Type": HTTP_TYPE if head else record.content_type,
    }
    if refers_to is None:
        return warc_record("response", fields, record.block)
    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to["id"], "WARC-Refers-To-Target-URI": refers_to["url"], "WARC-Refers-To-Date": warc_date(refers_to["date"])}
    return warc_record("revisit", fields | {"X-Refers-To-Page": str(refers_to["page_id"]), "X-Payload-Length": str(len(body))}, head)


# ---- jobs --------------------------------------------------------------------------------------------------------

_FILES = "file string, records long"
_INDEX = "file string, at long, page_id long, url string, date string, bytes long, digest string"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string, warc_id string, intact boolean"


class _Roll:
    """A file that is ended, and the next begun, at a size."""

    def __init__(self, folder: str, suffix: str, header, most: int):
        self.folder, self.suffix, self.header, self.most, self.out, self.done = folder, suffix, header, most, None, []

    def add(self, packed: bytes) -> None:
        if self.out is None:
            self.name, self.size, self.count = f"{uuid.uuid4().hex}{self.suffix}", 0, 0
            self.out = _open(f"{self.folder}/{self.name}", "wb")
            head = self.header(self.name)
            self.out.write(head)
            self.size += len(head)
        self.out.write(packed)
        self.size += len(packed)
        self.count += 1
        if self.size >= self.most:
            self.end()

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.count))
            self.out = None


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared place, made by Spark's own file system."""
    path = scratch_path(spark, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_arc(pages: DataFrame, version: int = 1, date: str = "20240101000000", most: int = 16 << 20) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ARC ``version``; returns their list (file, records).

    Null html is an empty payload, a null url ``urn:page``, a null page_id has no identifying header; repeated
    rows are repeated records; an empty table gives no archive. Spaces and controls in a URL are percent-encoded.
    """
    folder = _new_folder(pages.sparkSession, "arc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roll(folder, ".arc.gz", lambda name: member(arc_file_header(version, name, date)), most)
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                roll.add(member(arc_record(version, quote(url or "urn:page", safe="!#$%&'()*+,/:;=?@[]~"), date, http_block(page, body))))
        roll.end()
        yield _rows(roll.done, ("file", "records"), (pa.string(), pa.int64()))

    return stored(pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("string")).mapInArrow(each, _FILES), "arc-files")


def _rows(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))


def _named(file: str, records: Iterator) -> Iterator:
    try:
        yield from records
    except ValueError as error:
        raise ValueError(f"{file}: {error}") from error


def _page_id(http: dict[bytes, bytes]) -> int | None:
    stated = http.get(_PAGE, b"").strip()
    return int(stated) if stated.removeprefix(b"-").isdigit() else None


def index_arc(files: DataFrame) -> DataFrame:
    """A row for each record: where it is, and its payload's size and SHA-1.

    page_id is null where the block has no HTTP header that states one. A file listed twice is indexed twice; an empty list
    gives no row. A file that is damaged (a length that runs beyond its end, a header line of too few fields) fails the
    job with its name, as what follows can't be found.
    """
    names = tuple(x.split()[0] for x in _INDEX.split(", "))
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with _open(file, "rb") as stream:
                    for at, r in _named(file, read_arc(stream)):
                        http, _, body = split_http(r.block)
                        rows.append((file, at, _page_id(http), r.url, r.date, len(body), hashlib.sha1(body).hexdigest()))
                yield _rows(rows, names, types)

    return stored(_spread(files).mapInArrow(each, _INDEX), "arc-index")


def _spread(files: DataFrame) -> DataFrame:
    """Files are the unit of work; each goes to any task."""
    return files.select("file").repartition(_tasks(files.sparkSession), "file")


def _tasks(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism * 4


def convert(index: DataFrame, least: int = 1000, most: int = 16 << 20) -> DataFrame:
    """WARC archives of the indexed ARC records; returns their list (file, records).

    Of records with equal payloads of at least ``least`` bytes that with the largest page_id is a response (null is
    smallest; of equal ones the one in the last place), the others are revisits of it; smaller ones all are responses.
    An empty index gives no archive; a record indexed twice counts as one.
    Which is which takes one maximum per digest, combined before the shuffle; the join back splits hot digests. The
    decisions then gather by ARC file, whose size is bounded, and files are dealt to all cores.
    """
    spark = index.sparkSession
    folder = _new_folder(spark, "warc")
    place = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("rank"), "file", "at", "page_id", "url", "date")
    first = index.where(F.col("bytes") >= least).groupBy("digest").agg(F.max(place).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = index.where(F.col("bytes") >= least).join(first, "digest").where("file <> to.file OR at <> to.at")
    revisits = revisits.select("file", "at", F.col("to.page_id").alias("to_page"), F.col("to.url").alias("to_url"), F.col("to.date").alias("to_date"))
    lists = revisits.groupBy("file").agg(F.collect_list(F.struct("at", "to_page", "to_url", "to_date")).alias("revisits"))
    # The rows are few and small, whatever the archives hold, so their number of tasks has to be told.
    work = index.select("file").distinct().join(lists, "file", "left").repartition(_tasks(spark), "file")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roll(folder, ".warc.gz", lambda name: member(warc_record("warcinfo", {"WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: pixloom\r\nformat: WARC File Format 1.1\r\n")), most)
        for batch in batches:
            for file, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = {x["at"]: {"page_id": x["to_page"], "url": x["to_url"], "date": x["to_date"], "id": record_id(x["to_url"], x["to_date"], x["to_page"])} for x in again or ()}
                with _open(file, "rb") as stream:
                    for at, record in _named(file, read_arc(stream)):
                        roll.add(member(convert_record(record, to.get(at))))
        roll.end()
        yield _rows(roll.done, ("file", "records"), (pa.string(), pa.int64()))

    return stored(work.mapInArrow(each, _FILES), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """A row for each response or revisit of the archives; sizes and digests are of the full payload.

    A response's are measured on its payload, and intact says whether the digest is the stated one; a revisit's are as
    the record states, since its payload is in the record it refers to, and intact is null. What an old server said of
    its Content-Length counts for nothing. A file listed twice is read twice; an empty list gives no row.
    """
    names = tuple(x.split()[0] for x in _READ.split(", "))
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind, (http, _, body) = head["WARC-Type"], split_http(block)
        stated, to = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Refers-To-Page", "None")
        size, found = (int(head["X-Payload-Length"]), stated) if kind == "revisit" else (len(body), hashlib.sha1(body).hexdigest())
        same = None if kind == "revisit" else found == stated
        return (_page_id(http), head["WARC-Target-URI"], size, found, kind, None if to == "None" else int(to), head["WARC-Date"], head["WARC-Record-ID"], same)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with _open(file, "rb") as stream:
                    records = map(parse_warc, _named(file, members(stream)))
                    rows = [row(head, block) for head, block in records if head["WARC-Type"] != "warcinfo"]
                yield _rows(rows, names, types)

    return _spread(files).mapInArrow(each, _READ)


def archive(pages: DataFrame, version: int = 1, least: int = 1000) -> DataFrame:
    """``pages`` written as ARC, converted to WARC and read back: one row (see read_warc) for each page.

    Nulls and repeated rows are as write_arc says; an empty table gives an empty table; columns but page_id, url, html aren't read.
    """
    return read_warc(convert(index_arc(write_arc(pages, version)), least))
