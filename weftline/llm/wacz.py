"""Web archives packed in ZIP files (WACZ layout), written and read in place.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per record, ``indexes/index.cdxj``, one line
per record with its offset and length, and ``datapackage.json``. The reader never extracts: it reads the end of the file, follows
the end-of-central-directory record (or, by its locator, the ZIP64 one) to the central directory, takes sizes and offsets from
it and from ZIP64 extra fields, skips each local header, and then reads byte ranges: the index as a whole, and records in runs
of neighbouring ranges of bounded size.

Writing: of records with equal payloads of at least ``min_bytes`` bytes, that with the least page_id is a response and the others
are revisits that refer to it and have no payload. Digests are grouped as narrow rows with partial aggregation; page contents are
shuffled once, by page. Tasks write packages under names of their own, and the manifest lists those of the tasks that
were committed, so a lost executor or a repeated task leaves nothing wrong behind.

Cases: null html is an empty payload. A null page_id counts as the largest; rows equal in page_id and payload are
responses alike if they are the first. A null url is written as an empty target. An empty table gives no package and an
empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, stored

MIN_BYTES = 0
ROLL_BYTES = 32 << 20  # of compressed records in one package
RANGE_BYTES = 4 << 20  # of one read
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://")) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- ZIP


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = True) -> Iterator[bytes]:
    """A ZIP file of stored members, piece by piece. ``zip64`` writes ZIP64 records even where the sizes don't need them."""
    at, directory = 0, []
    for name, data in members:
        raw, crc, n = name.encode("utf-8"), zlib.crc32(data), len(data)
        large = zip64 or n >= _MAX32 or at >= _MAX32
        size32 = _MAX32 if large else n
        extra = struct.pack("<HHQQ", 1, 16, n, n) if large else b""
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0800, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra)) + raw + extra
        yield local
        yield data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0800, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if large else at) + raw + extra)
        at += len(local) + n
    listing = b"".join(directory)
    yield listing
    count = len(members)
    large = zip64 or count >= _MAX16 or at >= _MAX32 or len(listing) >= _MAX32
    if large:
        yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(listing), at)
        yield struct.pack("<IIQI", 0x07064B50, 0, at + len(listing), 1)
    small = (_MAX16, _MAX16, _MAX32, _MAX32) if large else (count, count, len(listing), at)
    yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *small, 0)


class ZipMembers:
    """name -> (offset of the data, size) of the stored members; ``file`` has read, seek and size()."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        tail_at = max(0, size - (22 + _MAX16 + 20))
        tail = self.read(tail_at, size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and (len(tail) < k + 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut short")
        count, length, at = struct.unpack_from("<HII", tail, k + 10)
        if (count == _MAX16 or length == _MAX32 or at == _MAX32) and k >= 20 and tail[k - 20 : k - 16] == b"PK\x06\x07":
            (end64,) = struct.unpack_from("<Q", tail, k - 12)
            head = self.read(end64, 56)
            if head[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points at no ZIP64 record")
            count, length, at = struct.unpack_from("<QQQ", head, 32)
        listing, i = self.read(at, length), 0
        self.entries: dict[str, tuple[int, int, int, int]] = {}
        for _ in range(count):
            if listing[i : i + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", listing, i + 8)
            packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", listing, i + 20)
            (start,) = struct.unpack_from("<I", listing, i + 42)
            raw = listing[i + 46 : i + 46 + n_name]
            extra = listing[i + 46 + n_name : i + 46 + n_name + n_extra]
            e = 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # only the fields that overflowed stand here, in this order
                    p = e + 4
                    if plain == _MAX32:
                        (plain,), p = struct.unpack_from("<Q", extra, p), p + 8
                    if packed == _MAX32:
                        (packed,), p = struct.unpack_from("<Q", extra, p), p + 8
                    if start == _MAX32:
                        (start,), p = struct.unpack_from("<Q", extra, p), p + 8
                e += 4 + n
            self.entries[raw.decode("utf-8" if flags & 0x800 else "cp437")] = (start, packed, plain, method)
            i += 46 + n_name + n_extra + n_note

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file is cut short")
        return data

    def names(self) -> list[str]:
        return list(self.entries)

    def locate(self, name: str) -> tuple[int, int]:
        start, packed, plain, method = self.entries[name]
        if method != 0 or packed != plain:
            raise ValueError(f"{name} is compressed: only stored members can be read by range")
        head = self.read(start, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return start + 30 + n_name + n_extra, plain


# ---- WARC records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """(the record as a gzip member, the payload's digest)."""
    d = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{d}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0), d


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record, gzip-compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return headers, rest[:n]


def _urn(value: str | None) -> str | None:
    page = (value or "").strip("<>").removeprefix("urn:page:")
    return page or None


def records_of(path: str) -> Iterator[dict]:
    """Every record of a package, found by its index: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as file:
        members = ZipMembers(file, file.size())
        for index in [x for x in members.names() if x.startswith("indexes/") and x.endswith(".cdxj")]:
            entries = []
            for line in members.read(*members.locate(index)).decode("utf-8").splitlines():
                if line:
                    x = json.loads(line.split(" ", 2)[2])
                    entries.append((x["filename"], int(x["offset"]), int(x["length"])))
            entries.sort()
            i = 0
            while i < len(entries):
                member, start, _ = entries[i]
                base, size = members.locate(f"archive/{member}")
                j, end = i, start
                while j < len(entries) and entries[j][0] == member and (j == i or entries[j][1] + entries[j][2] - start <= RANGE_BYTES):
                    end = max(end, entries[j][1] + entries[j][2])
                    j += 1
                if end > size:
                    raise ValueError("the index points beyond its archive")
                run = members.read(base + start, end - start)
                for _, at, n in entries[i:j]:
                    yield _decoded(run[at - start : at - start + n])
                i = j


def _decoded(data: bytes) -> dict:
    headers, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    if revisit:
        n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    else:
        n = len(payload)
        if digest(payload) != stated:
            raise ValueError("a payload doesn't match its digest")
    return {
        "page_id": _urn(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": headers["warc-type"], "refers_to": _urn(headers.get("warc-refers-to")),
        "payload_bytes": n, "payload_digest": stated, "payload": None if revisit else payload,
    }


# ---- Spark


def assign(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): the role of each page's record."""
    html = F.coalesce(F.col("html"), F.lit(""))
    small = pages.select(F.col("page_id").cast("long").alias("id"), F.sha1(F.encode(html, "UTF-8")).alias("h"), F.octet_length(html).alias("n"))
    large = small.where(F.col("n") >= min_bytes)
    first = large.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1 AND first IS NOT NULL").drop("k")
    # only revisits; narrow rows, so a payload that a third of all pages have is no burden
    later = large.join(first, "h").where("id IS NULL OR id > first").select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("first").alias("refers_to")).distinct()
    j = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").join(later, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1(F.encode(html, "UTF-8")) == F.col("__h")), "left")
    return j.select("page_id", "url", "html", "refers_to", F.col("__h").isNotNull().alias("revisit"))


def write(assigned: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes packages under ``folder`` and returns their manifest (path, records, bytes), which is stored beside them."""

    def pack(batches):
        body, lines, attempt, k = io.BytesIO(), [], uuid.uuid4().hex, 0

        def flush():
            nonlocal body, lines, k
            path = f"{folder}/{attempt}-{k:05d}.wacz"
            fs, name = open_fs(path)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            size = 0
            with fs.open_output_stream(name) as out:
                meta = json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode()
                for piece in zip_bytes([("archive/data.warc.gz", body.getvalue()), ("indexes/index.cdxj", "".join(sorted(lines)).encode("utf-8")), ("datapackage.json", meta)]):
                    out.write(piece)
                    size += len(piece)
            row = pd.DataFrame({"path": [path], "records": [len(lines)], "bytes": [size]})
            body, lines, k = io.BytesIO(), [], k + 1
            return row

        for pdf in batches:
            for page_id, url, html, refers_to, revisit in pdf.itertuples(index=False):
                data, d = record(page_id, url, (html or "").encode("utf-8"), refers_to, revisit)
                about = json.dumps({"url": url or "", "digest": f"sha1:{d}", "mime": "text/html", "offset": str(body.tell()), "length": str(len(data)), "filename": "data.warc.gz"})
                lines.append(f"{'-'.join((url or '-').split()) or '-'} 20240101000000 {about}\n")
                body.write(data)
                if body.tell() >= roll_bytes:
                    yield flush()
        if lines:
            yield flush()

    rows = assigned.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return stored(rows.mapInPandas(pack, "path string, records long, bytes long"))


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages in ``manifest`` (path)."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]

    def scan(batches):
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                for x in records_of(path):
                    rows.append([x[c] for c in names])
                    held += x["payload_bytes"] if payloads else 200
                    if held > RANGE_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    spread = manifest.select("path").repartition(max(1, min(4096, manifest.count())))
    return spread.mapInPandas(scan, schema).withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as packages and reads the records back."""
    return read(write(assign(pages, min_bytes), folder or scratch_path(pages.sparkSession, "wacz")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h),
b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> (3 - (5 * i) % 4)) & 31) + 1 AS INT), 1), '' ORDER BY i) AS b32
  FROM (
    SELECT h, i, (strpos('0123456789abcdef', substr(h, CAST((5 * i) // 4 + 1 AS INT), 1)) - 1) * 16
                 + strpos('0123456789abcdef', substr(h, CAST((5 * i) // 4 + 2 AS INT), 1)) - 1 AS v
    FROM f, range(0, 32) AS r(i)
  ) GROUP BY h
)
SELECT d.page_id, d.payload_bytes, b.b32 AS payload_digest,
       CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM d JOIN f USING (h) JOIN b USING (h)
"""
