"""WARC archives of gzip members: a writer of responses and revisits, and a splittable reader.

Writing: equal payloads (by SHA-1 and length) of at least ``least`` bytes are stored once, with the
largest id; the others become revisit records that name it. Tasks write archives of bounded size to a
folder that all executors reach, under names of their own, and return a list of files; only the list
that Spark commits counts, so files of lost or repeated attempts are never read.

Reading: every file is cut into byte ranges. A task looks for the gzip magic in its range, and takes
a place for a member when its header decodes, its content starts as a WARC record and, if the
member names its place (a gzip extra field that the writer adds), that place is its own. The task
owns the members that start inside its range, follows them one by one and reads the last one beyond the
range's end. A member may hold any number of records; one record is in memory at a time. URLs come back as
they were written: one that a header line cannot hold is percent-encoded as a whole and marked.

Null payloads are empty, null ids and urls have no header line and come back null. Rows that repeat
the largest id of a payload are all responses. Other columns are not read. An empty table gives no
archive and an empty result.
"""
from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.storage import materialise, shared_folder

ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 4 << 20
READ_BYTES = 256 << 10
MAGIC = b"\x1f\x8b\x08"
_HEAD = b"WARC/1."
_URN = "urn:saddle:page:"
#: Says that the URI is percent-encoded as a whole, since a header line cannot hold it.
_ESCAPED = "WARC-Saddle-URI-Encoding"
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]")
#: Bytes of a gzip header that are looked into.
LONGEST_HEADER = 1 << 20
#: Byte ranges of one reading task.
RANGES = 4
#: Subfield of the gzip header that holds the member's offset in its file.
_PLACE = b"AT"


def _urn(page) -> str:
    return f"<{_URN}{page}>"


def member(record: bytes, offset: int) -> bytes:
    """A gzip member that names its place."""
    extra = _PLACE + struct.pack("<HQ", 8, offset)
    head = MAGIC + b"\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return head + packer.compress(record) + packer.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page, url, payload: bytes, digest: str, size: int, original) -> bytes:
    """A response, or a revisit of the page ``original``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if original is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if page is not None:
        lines.append(f"WARC-Record-ID: {_urn(page)}")
    if url is not None:
        plain = url == url.strip() and not _CONTROL.search(url)
        lines.append(f"WARC-Target-URI: {url if plain else quote(url, safe='')}")
        if not plain:
            lines.append(f"{_ESCAPED}: percent")
    if original is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_urn(original)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Writes the archives; returns the committed list ``path, length, records``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    large = F.col("size") >= least
    copies = (rows.where(large).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", "size", "original"))
    # few payloads repeat; the rest of the table stays where it is if they fit a broadcast
    dealt = rows.join(copies, ["digest", "size"], "left")
    original = F.when(F.col("page_id") == F.col("original"), None).otherwise(F.col("original"))
    dealt = dealt.select("page_id", "url", "digest", "size", original.alias("original"),
                         F.when(original.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, at, n, name, found = None, 0, 0, "", []
        for batch in batches:
            for page, url, digest, size, first, body in zip(*[batch[c].to_pylist() for c in batch.schema.names]):
                if out is None:
                    name, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(page, url, body, digest, size, first), at)
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= ARCHIVE_BYTES:
                    out.close()
                    found.append((f"{folder}/{name}", at, n))
                    out = None
        if out is not None:
            out.close()
            found.append((f"{folder}/{name}", at, n))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["path", "length", "records"])

    return materialise(dealt.mapInArrow(work, "path string, length bigint, records bigint"))


# -- reading -------------------------------------------------------------------------------

class _Window:
    """Bytes of a file from a moving place on, fetched a piece at a time."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def fetch(self) -> bool:
        start = self.at + len(self.data)
        if start >= self.size:
            return False
        self.file.seek(start)
        got = self.file.read(min(READ_BYTES, self.size - start))
        self.data += got
        return bool(got)

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.fetch():
                return False
        return True

    def move(self, to: int) -> None:
        self.data = self.data[to - self.at:] if to - self.at < len(self.data) else b""
        self.at = to


def _place(head: bytes) -> int | None:
    """The offset that the member's header names, if any; -1 for a header that cannot be one."""
    if len(head) < 10 or head[:3] != MAGIC or head[3] & 0xE0:
        return -1
    if not head[3] & 4:
        return None
    if len(head) < 12:
        return -1
    length, = struct.unpack("<H", head[10:12])
    extra, at = head[12:12 + length], 0
    if len(extra) < length:
        return None  # longer than what was read ahead; left to the decoder
    while at + 4 <= length:
        size, = struct.unpack("<H", extra[at + 2:at + 4])
        if extra[at:at + 2] == _PLACE and size == 8 and at + 12 <= length:
            return struct.unpack("<Q", extra[at + 4:at + 12])[0]
        at += 4 + size
    return None


def _starts_record(window: _Window) -> bool:
    """Whether a member with a WARC record starts at the window's place; reads on while the gzip header is not complete."""
    size = 4096
    while True:
        window.need(size)
        head = window.data[:size]
        named = _place(head)
        if named is not None and named != window.at:
            return False
        try:
            got = zlib.decompressobj(31).decompress(head, len(_HEAD))
        except zlib.error:
            return False
        if got or len(head) < size or size >= LONGEST_HEADER:
            return got == _HEAD
        size *= 4


def _next_member(window: _Window, end: int) -> bool:
    """Moves the window to the next member that starts before ``end``."""
    while window.at < end:
        if not window.need(len(MAGIC)):
            return False
        found = window.data.find(MAGIC)
        if found < 0:
            window.move(window.at + len(window.data) - len(MAGIC) + 1)
            if not window.fetch():
                return False
            continue
        window.move(window.at + found)
        if window.at >= end:
            return False
        if _starts_record(window):
            return True
        window.move(window.at + 1)
    return False


def _pieces(window: _Window) -> Iterator[bytes | None]:
    """The content of the member at the window's place, piece by piece; the window moves behind it. None if it is damaged."""
    unpacker = zlib.decompressobj(31)
    try:
        while not unpacker.eof:
            if not window.data and not window.fetch():
                yield None
                return
            data, window.data = window.data, b""
            window.at += len(data)
            piece = unpacker.decompress(data, READ_BYTES)
            while piece:
                yield piece
                piece = unpacker.decompress(unpacker.unconsumed_tail, READ_BYTES) if unpacker.unconsumed_tail else b""
    except zlib.error:
        yield None
        return
    window.at, window.data = window.at - len(unpacker.unused_data), unpacker.unused_data


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _split(pieces: Iterator[bytes | None]) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """Header and block of each record of a member; one record is held. None where the member is damaged or goes on as something else.

    A record is given out when the next one starts or the member has ended well. A member that ends inside a block, as one
    whose length is wrong, gives what there is.
    """
    held, ready = bytearray(), None
    for piece in pieces:
        if piece is None:
            yield None
            return
        held += piece
        while held:
            del held[:len(held) - len(held.lstrip(b"\r\n"))]
            if held[:len(_HEAD)] != _HEAD[:len(held)]:
                yield from [ready] if ready else []
                yield None
                return
            end = held.find(b"\r\n\r\n")
            fields = _fields(bytes(held[:end])) if end >= 0 else {}
            length = fields.get("content-length", "")
            if not length.isdigit() or len(held) < end + 4 + int(length):
                break
            if ready:
                yield ready
            ready = fields, bytes(held[end + 4:end + 4 + int(length)])
            del held[:end + 4 + int(length)]
    if ready:
        yield ready
    end = held.find(b"\r\n\r\n")
    if end >= 0:
        yield _fields(bytes(held[:end])), bytes(held[end + 4:])


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, Iterator]]:
    """(offset, records) of the members that start in ``[start, end)``; records must be read before the next member."""
    window = _Window(file, size, start)
    while _next_member(window, end):
        at = window.at
        whole = True

        def records():
            nonlocal whole
            for found in _split(_pieces(window)):
                if found is None:
                    whole = False
                else:
                    yield found

        yield at, records()
        if not whole:
            window = _Window(file, size, at + 1)


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block behind its HTTP header, if it has one."""
    return block.partition(b"\r\n\r\n")[2] if "msgtype=response" in fields.get("content-type", "") else block


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the archives of a folder, for archives that others wrote."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", "length")


def _page(urn: str | None) -> int | None:
    return int(urn[len(_URN) + 1:-1]) if urn and urn.startswith("<" + _URN) else None


def read_archives(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``files(path, length)``: ``path, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Size and digest of a response are taken from its payload, of a revisit from its header.
    """
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("start"))
    ranges = materialise(ranges)
    # a given number of partitions is not merged, however small the rows that name the ranges are
    ranges = ranges.repartition(max(1, -(-ranges.count() // RANGES)), "path", "start")
    names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        for batch in batches:
            for path, length, start in zip(*[batch[c].to_pylist() for c in ("path", "length", "start")]):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    for at, records in members(file, length, start, min(start + split, length)):
                        for fields, block in records:
                            payload = payload_of(fields, block)
                            kind, url = fields.get("warc-type"), fields.get("warc-target-uri")
                            if url is not None and _ESCAPED.lower() in fields:
                                url = unquote(url)
                            if kind == "revisit":
                                n, digest = int(fields.get("warc-payload-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                            else:
                                n, digest = len(payload), sha1(payload).hexdigest()
                            held.append((path, at, _page(fields.get("warc-record-id")), url, kind, _page(fields.get("warc-refers-to")), n, digest, payload))
                            size += len(payload) + 256
                            if size >= 4 << 20:
                                yield flush()
                                held, size = [], 0
        if held:
            yield flush()

    return ranges.mapInArrow(work, "path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, "
                                   "payload_bytes bigint, payload_digest string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one, as a URI."""
    base = shared_folder(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{uuid.uuid4().hex}"
