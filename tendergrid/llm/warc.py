"""WARC records in ZIP archives: written as files, read back by ranges.

An archive is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz`
(records compressed one by one) and `indexes/index.cdx` (offset and length of
every record). The reader parses the end record, its ZIP64 form where present,
and the central directory, finds the stored members, and fetches each record by
its byte range; nothing is extracted.

Which record is a response is settled before writing, from narrow rows: of equal
payloads of at least LEAST_BYTES bytes the one with the largest page_id
answers and the others revisit it. Null html counts as an empty payload. A null
page_id is smaller than any other. Repeated rows (same page_id and payload) of
a group: the first written by nothing but order is not defined, so all of them
that carry the largest page_id are responses. An empty table gives no archive
and an empty result. Tasks write under names of their own and report them, so
files of lost attempts are never read.
"""

import gzip
import hashlib
import io
import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendergrid import session
from tendergrid.llm import common

LEAST_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
MOST_TASKS = 20_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed signatures and sizes of the ZIP format.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def with_record_type(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = [F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha1(html).alias("payload_digest")]
    groups = (
        pages.select("page_id", *narrow)
        .where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    rows = pages.select("page_id", "url", "html", *narrow).join(groups, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("first"))
    ).drop("first")


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Target-URI": " ".join((url or "urn:page:none").split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        headers["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class ArchiveWriter:
    """Stored members one after another; ZIP64 fields where numbers ask for them, or always."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.entries, self.at = out, zip64, [], 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> None:
        size, crc, start = sum(map(len, chunks)), 0, self.at
        for chunk in chunks:
            crc = zlib.crc32(chunk, crc)
        big = self.zip64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = _FULL32 if big else size
        raw = name.encode()
        self._write(_LOCAL + struct.pack("<5H3I2H", 45, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            self._write(chunk)
        self.entries.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            big = self.zip64 or size >= _FULL32 or offset >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            shown, where = (_FULL32, _FULL32) if big else (size, offset)
            self._write(
                _ENTRY + struct.pack("<6H3I5H2I", 45, 45, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra
            )
        size, count = self.at - start, len(self.entries)
        big = self.zip64 or start >= _FULL32 or count >= _FULL16
        if big:
            end = self.at
            self._write(_END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, size, start))
            self._write(_LOCATOR + struct.pack("<IQI", 0, end, 1))
        shown = (_FULL16, _FULL16, _FULL32, _FULL32) if big else (count, count, size, start)
        self._write(_END + struct.pack("<4H2IH", 0, 0, *shown, 0))


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Start and length of every stored member, from the end record and the central directory.

    `file` has read_at(length, offset). Deflated members are an error.
    """
    tail_size = min(size, 22 + _FULL16 + 20)
    tail = file.read_at(tail_size, size - tail_size)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if _FULL16 == count or _FULL32 in (length, start):
        locator = tail[at - 20 : at]
        if at < 20 or locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        end = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<3Q", end, 32)
    directory, at, found = file.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("bad central directory")
        method, packed, plain = (struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<II", directory, at + 20))
        names, extras, comments = struct.unpack_from("<3H", directory, at + 28)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode()
        extra, at_extra = directory[at + 46 + names : at + 46 + names + extras], 0
        while at_extra + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, at_extra)
            if kind == 1:
                # Only the fields that are full in the entry are here, in this order.
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, at_extra + 4))
                plain = next(wide) if plain == _FULL32 else plain
                packed = next(wide) if packed == _FULL32 else packed
                offset = next(wide) if offset == _FULL32 else offset
            at_extra += 4 + width
        if method != 0:
            raise ValueError(f"{name} is not stored")
        local = file.read_at(30, offset)
        if local[:4] != _LOCAL:
            raise ValueError("bad local header")
        found[name] = (offset + 30 + sum(struct.unpack_from("<2H", local, 26)), packed)
        at += 46 + names + extras + comments
    return found


class _Ranges:
    """Ranges of a file on whichever file system its address names."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read_at(self, length: int, offset: int) -> bytes:
        return self.file.read_at(length, offset)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows of with_record_type as archives under a shared folder; returns path and records of each.

    The list is staged: the files are written once, and files of attempts that
    did not finish are not in it.
    """
    address = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(frames):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(address)
        data, index, size = [], [], 0

        def close():
            body = io.BytesIO()
            writer = ArchiveWriter(body)
            writer.add(DATA, data)
            writer.add(INDEX, [b"".join(index)])
            writer.close()
            name = f"{uuid.uuid4().hex}.wacz"
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(body.getbuffer())
            made = pd.DataFrame({"path": [f"{address}/{name}"], "records": [len(index)]})
            data.clear()
            index.clear()
            return made

        for frame in frames:
            for row in frame.itertuples(index=False):
                whole = lambda x: None if pd.isna(x) else int(x)
                raw = record(
                    whole(row.page_id), row.url, (row.html or "").encode(), row.payload_digest,
                    row.payload_bytes, row.record_type, whole(row.refers_to),
                )
                packed = gzip.compress(raw, 6, mtime=0)
                index.append(f"{size} {len(packed)}\n".encode())
                data.append(packed)
                size += len(packed)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    size = 0
        if data:
            yield close()

    return common.staged(pages.mapInPandas(run, "path string, records long"), "warc-list")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary"


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Every record of the archives at `path`; intact: its payload has the digest and length it claims (null for revisits)."""

    def run(frames):
        for frame in frames:
            for path in frame["path"]:
                file = _Ranges(path)
                found = members(file, file.size)
                start = found[DATA][0]
                rows = []
                for line in file.read_at(found[INDEX][1], found[INDEX][0]).splitlines():
                    offset, length = map(int, line.split())
                    headers, payload = parse_record(gzip.decompress(file.read_at(length, start + offset)))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size, uri = int(headers["WARC-Payload-Length"]), headers["WARC-Target-URI"]
                    number = lambda name: (lambda x: None if x == "None" else int(x))(headers[name][10:-1])  # noqa: E731,B023
                    intact = (hashlib.sha1(payload).hexdigest(), len(payload)) == (digest, size) if kind == "response" else None
                    rows.append(
                        (number("WARC-Record-ID"), None if uri == "urn:page:none" else uri, size, digest, kind,
                         number("WARC-Refers-To") if "WARC-Refers-To" in headers else None, intact, payload)
                    )
                    if len(rows) == 256:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    # A task per archive, which is bounded by ARCHIVE_BYTES and its last record; beyond
    # MOST_TASKS archives a task reads several. A stated number keeps the few bytes of
    # the list from being merged into one task.
    tasks = min(max(archives.count(), 1), MOST_TASKS)
    return archives.select("path").repartition(tasks).mapInPandas(run, RECORD)


def _frame(rows) -> pd.DataFrame:
    names = [field.split()[0] for field in RECORD.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "intact": "boolean"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    spark = pages.sparkSession
    archives = write(with_record_type(pages), session.work_folder(spark, "llm-warc"))
    return read(spark, archives).drop("payload", "url")
