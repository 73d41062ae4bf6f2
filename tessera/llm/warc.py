"""WARC records in ZIP-packaged archives, written and read back by byte ranges.

``write_archives`` writes a WARC record per page into archives: ZIP files whose
members (``archive/data.warc`` and ``indexes/index.cdx``) are stored without
compression, with ZIP64 fields where sizes ask for them. ``read_archive_files``
opens such files for random access: it reads the tail to find the end of the
central directory, follows the ZIP64 locator if there is one, locates the members
by their local headers, reads the index in blocks and deals its entries out over
tasks, which range-read each record by its offset and length. Nothing is extracted,
and no file is loaded whole, so files may have any size. ``pack_archives`` and
``read_archives`` do the same for archives held as a binary column (at most 2 GB each).

``plan_records`` decides response or revisit: of records with equal payloads of at
least ``min_bytes`` the smallest page_id is the response and others revisit it.

Defined results for odd input: a null html is an empty payload; rows that repeat a
page_id with the same payload are all the response (they carry the id that others
revisit); a null page_id never is a response that others revisit, and revisits if
another row has its payload; a null url is written as an empty target; an empty
table gives an empty result; extra columns are ignored; texts of any length are one
record each; broken or missing archives and broken records give rows with an error.
Files are opened by URI through pyarrow (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import join_groups

MEMBER, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Fixed values of the ZIP format: signatures and field layouts.
LOCAL, CENTRAL, END, LOCATOR, END64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
LOCAL_FIELDS, CENTRAL_FIELDS, END_FIELDS = "<4sHHHHHIIIHH", "<4sHHHHHHIIIHHHHHII", "<4sHHHHIIH"
LOCATOR_FIELDS, END64_FIELDS = "<4sIQI", "<4sQHHIIQQQQ"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Bytes of a read ahead; bytes and records of one row of ranges; bytes of an archive file.
AHEAD, RANGE_BYTES, RANGE_RECORDS, FILE_BYTES = 1 << 17, 4 << 20, 512, 16 << 20


class Ranges:
    """A file as a sliceable: a slice is read by seek, with some bytes ahead for the next ones."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        first, last, _ = part.indices(self.size)
        if not self.at <= first <= last <= self.at + len(self.held):
            self.file.seek(first)
            self.at, self.held = first, self.file.read(max(last - first, min(AHEAD, self.size - first)))
        return self.held[first - self.at : max(last - self.at, 0)]


def _fields(layout: str, data: memoryview | Ranges, at: int) -> tuple:
    return struct.unpack(layout, bytes(data[at : at + struct.calcsize(layout)]) if at >= 0 else b"")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; ``zip64`` forces the large form of all fields."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at, n = name.encode(), zlib.crc32(data), len(out), len(data)
        large = zip64 or n >= FULL32 or at >= FULL32
        size, where = (FULL32, FULL32) if large else (n, at)
        more = struct.pack("<HHQQ", 1, 16, n, n) if large else b""
        out += struct.pack(LOCAL_FIELDS, LOCAL, 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(more)) + raw + more + data
        more = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
        directory += struct.pack(CENTRAL_FIELDS, CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(more), 0, 0, 0, 0, where) + raw + more
    start, n, size = len(out), len(members), len(directory)
    out += directory
    if zip64 or start >= FULL32 or n >= FULL16:
        end = len(out)
        out += struct.pack(END64_FIELDS, END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack(LOCATOR_FIELDS, LOCATOR, 0, end, 1)
        n, size, start = FULL16, FULL32, FULL32
    return bytes(out + struct.pack(END_FIELDS, END, 0, 0, n, n, size, start, 0))


def zip_members(data: memoryview | Ranges) -> dict[str, tuple[int, int]]:
    """(offset, length) of the bytes of each stored member, from the central directory."""
    tail = bytes(data[max(0, len(data) - 65_536 - 22) : len(data)])
    at = tail.rfind(END)
    whole = lambda at: len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)
    while at >= 0 and not whole(at):  # a signature inside the comment
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    end = len(data) - len(tail) + at
    *_, count, size, start, _ = _fields(END_FIELDS, data, end)
    if FULL16 == count or FULL32 in (size, start):
        signature, _, where, _ = _fields(LOCATOR_FIELDS, data, end - 20)
        if signature == LOCATOR:
            *_, count, size, start = _fields(END64_FIELDS, data, where)
    found = {}
    for _ in range(count):
        (signature, _, _, flags, method, _, _, _, packed, n, n_name, n_more, n_note, _, _, _, local) = _fields(CENTRAL_FIELDS, data, start)
        if signature != CENTRAL:
            raise ValueError("broken central directory")
        name = bytes(data[start + 46 : start + 46 + n_name]).decode("utf-8" if flags & 0x800 else "cp437")
        more = bytes(data[start + 46 + n_name : start + 46 + n_name + n_more])
        while len(more) >= 4:
            kind, length = struct.unpack_from("<HH", more)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", more, 4))
                n = next(wide) if n == FULL32 else n
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            more = more[4 + length :]
        if method == 0 and packed == n:
            *_, l_name, l_more = _fields(LOCAL_FIELDS, data, local)
            found[name] = (local + 30 + l_name + l_more, n)
        start += 46 + n_name + n_more + n_note
    return found


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str) -> bytes:
    """A WARC 1.1 response or revisit record; a revisit holds only the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    quote = lambda u: "".join(c if " " < c else f"%{ord(c):02X}" for c in u)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"),
        ("WARC-Target-URI", quote(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", quote(refers_url)), ("X-Refers-To-Page-ID", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, and refers_to and refers_url (null for a response) of every page."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("mark", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= min_bytes)
    first = large.groupBy("mark").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("copies")).where("copies > 1")
    joined = join_groups(rows, materialise(first, "payloads"), "mark", pages.count())
    revisits = (F.octet_length("html") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(revisits, F.col("first_id")).alias("refers_to"), F.when(revisits, F.col("first_url")).alias("refers_url"))


def _archives(planned: DataFrame, archive_bytes: int, zip64: bool, column: str, kind: str, keep) -> DataFrame:
    """One row per archive, each of about ``archive_bytes`` or one record: what ``keep`` returns for its bytes."""

    def closed(records: list[bytes], index: list[str]) -> pa.RecordBatch:
        made = zip_stored([(MEMBER, b"".join(records)), (INDEX, "\n".join(index).encode())], zip64)
        return pa.record_batch([pa.array([keep(made)], pa.binary() if kind == "binary" else pa.string())], [column])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, index, at = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    payload = row["html"].encode()
                    digest = sha1_base32(payload)
                    record = warc_record(row["page_id"], row["url"], payload, digest, row["refers_to"], row["refers_url"] or "")
                    index.append(json.dumps({"offset": at, "length": len(record), "digest": f"sha1:{digest}", "filename": MEMBER}))
                    records.append(record)
                    at += len(record)
                    if at >= archive_bytes:
                        yield closed(records, index)
                        records, index, at = [], [], 0
        if records:
            yield closed(records, index)

    return planned.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(apply, f"{column} {kind}")


def pack_archives(planned: DataFrame, archive_bytes: int = 1 << 20, zip64: bool = False) -> DataFrame:
    """One row per archive (column ``content``)."""
    return _archives(planned, archive_bytes, zip64, "content", "binary", lambda made: made)


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = FILE_BYTES, zip64: bool = False) -> DataFrame:
    """One row per archive file (column ``path``) written below ``folder``, a URI that all executors reach.

    A name is never used twice, so a task that runs again leaves only files that no row names:
    write the rows to a table before reading the files.
    """

    def keep(made: bytes) -> str:
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        where, name = fs.FileSystem.from_uri(path)
        with where.open_output_stream(name) as out:
            out.write(made)
        return path

    return _archives(planned, archive_bytes, zip64, "path", "string", keep)


BROKEN = (ValueError, KeyError, TypeError, IndexError, OverflowError, struct.error)


def _lines(data: memoryview | Ranges, start: int, length: int) -> Iterator[str]:
    """The lines of a stored member, read in blocks."""
    rest, end = b"", start + length
    for at in range(start, end, AHEAD):
        *lines, rest = (rest + bytes(data[at : min(at + AHEAD, end)])).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in lines)
    if rest:
        yield rest.decode("utf-8", "replace")


def located(data: memoryview | Ranges) -> Iterator[tuple[int, int] | str]:
    """First and last byte of each indexed record of one archive; a text says what can't be read."""
    try:
        members = zip_members(data)
    except BROKEN as e:
        yield f"broken archive: {e}"
        return
    indexes = [m for name, m in members.items() if name.startswith("indexes/")]
    if not indexes:
        yield "no stored index"
    for start, length in indexes:
        for line in _lines(data, start, length):
            try:
                entry = json.loads(line)
                if entry["filename"] not in members:
                    raise ValueError(f"{entry['filename']} is missing or compressed")
                base, size = members[entry["filename"]]
                first, last = base + entry["offset"], base + entry["offset"] + entry["length"]
                if entry["offset"] < 0 or entry["length"] < 0 or last > base + size:
                    raise ValueError("the index points outside its member")
                yield first, last
            except BROKEN as e:
                yield f"broken record: {e}"


ROW_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
ROW_NAMES = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
ROW_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"


def _row(found: tuple[int, int] | str, data: memoryview | Ranges) -> tuple:
    """The row of one record; the payload of a response is checked against its digest."""
    try:
        if isinstance(found, str):
            return (*[None] * 7, found)
        fields, block = parse_record(bytes(data[found[0] : found[1]]))
        payload = block.partition(b"\r\n\r\n")[2]
        response, digest = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if response and sha1_base32(payload) != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
        number = lambda name: int(fields[name]) if fields.get(name) else None
        return (number("X-Page-ID"), fields["WARC-Target-URI"], payload if response else None, len(payload) if response else number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), None)
    except BROKEN as e:
        return (*[None] * 7, f"broken record: {e}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(ROW_KINDS)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, ROW_KINDS, strict=True)], ROW_NAMES)


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of every record, and error.

    What can't be read (a broken archive, a compressed member, a damaged record) is a row
    with an ``error`` and nulls; the records beside it are read all the same.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                view = memoryview(archive.as_py() or b"")
                yield _batch([_row(found, view) for found in located(view)])

    return archives.select("content").mapInArrow(apply, ROW_SCHEMA)


def record_ranges(paths: DataFrame) -> DataFrame:
    """path, firsts, lasts and error: the indexed records of each file, in rows of bounded bytes and records."""
    kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())

    def rows(path: str) -> Iterator[tuple]:
        firsts, lasts, held = [], [], 0
        try:
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_file(name) as file:
                for found in located(Ranges(file)):
                    if isinstance(found, str):
                        yield path, [], [], found
                        continue
                    firsts.append(found[0])
                    lasts.append(found[1])
                    held += found[1] - found[0]
                    if len(firsts) == RANGE_RECORDS or held >= RANGE_BYTES:
                        yield path, firsts, lasts, None
                        firsts, lasts, held = [], [], 0
        except (*BROKEN, FileNotFoundError) as e:  # other failures of the storage end the task, which runs again
            yield path, [], [], f"broken archive: {e}"
        if firsts:
            yield path, firsts, lasts, None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["path", "firsts", "lasts", "error"])

    return paths.where("path is not null").select("path").mapInArrow(apply, "path string, firsts array<bigint>, lasts array<bigint>, error string")


def read_archive_files(paths: DataFrame) -> DataFrame:
    """The rows of ``read_archives`` for archive files by their URI (column ``path``; null: none), by range reads.

    The ranges of the records, few numbers each, are dealt out over all tasks, so one
    large archive is read by many.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, firsts, lasts, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is not None:
                    yield _batch([_row(error, b"")])
                    continue
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as file:
                    data = Ranges(file)
                    yield _batch([_row(found, data) for found in zip(firsts, lasts, strict=True)])

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return record_ranges(paths).repartition(n).mapInArrow(apply, ROW_SCHEMA)
