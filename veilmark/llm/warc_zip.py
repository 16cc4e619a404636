"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP file with stored (not deflated) members: ``archive/data.warc.gz``, whose
records are gzip members of their own, and ``indexes/index.cdxj``, which has place and length
of every record.  The reader gets the end of the file, follows the ZIP or ZIP64 directory to
the members, reads the index, and then only the byte ranges of the records; ranges that follow
each other are fetched together.  Packages without an index are indexed by walking the archive
member, and so are archive members no index line names.  Indexes may be deflated or gzipped, give
places as text and name archives without their folder; archives may hold plain records.  Records are
dealt out by blocks of the package, so one large package is read by many tasks.

What cannot be read ends no job: a package without a directory, an archive member that is not
stored, an index line without a place and a damaged record each give one row that has ``error``;
all other records are read.

Writing: of records with equal payloads of at least ``least`` bytes, the one with the smallest
page id is a response and the others revisit it.

Defined cases: a null page counts as an empty payload; smaller payloads and rows without a page
id are always responses; several rows of the smallest page id are all responses; an empty table
gives no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import attempt_name, cut, join_groups, open_input, open_output, text_or_empty
from veilmark.llm.exact_dedup import with_possible_repeats

LEAST = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
GZIP = b"\x1f\x8b"
BLOCK = 8 << 20
FETCH = 4 << 20
#: A crawl time is part of every record; tables without one get this.
NO_DATE = "1970-01-01T00:00:00Z"


# -- ZIP directories -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class Package:
    """The directory of one ZIP file; *source* has ``size()`` and ``read_at(n, offset)``."""

    END, END64, LOCATOR, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"

    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and place of the central directory."""
        size = self.source.size()
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self.source.read_at(size - tail_at, tail_at)
        at = tail.rfind(self.END)
        # A comment may hold the mark by chance: its length must reach the end of the file.
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(self.END, 0, at)
        if at < 0:
            raise ValueError("no ZIP directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n != 0xFFFF and length != 0xFFFFFFFF and start != 0xFFFFFFFF:
            return n, length, start
        locator = self.source.read_at(20, tail_at + at - 20)
        if locator[:4] != self.LOCATOR:
            return n, length, start
        end64 = self.source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != self.END64:
            raise ValueError("damaged ZIP64 directory")
        return struct.unpack_from("<QQQ", end64, 32)

    def _directory(self) -> Iterator[Member]:
        n, length, start = self._end()
        raw, at = self.source.read_at(length, start), 0
        for _ in range(n):
            if raw[at : at + 4] != self.ENTRY:
                raise ValueError("damaged ZIP directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name]
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            size, packed, header = _wide(extra, size, packed, header)
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, size, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def read(self, name: str) -> bytes:
        """The bytes of a stored or deflated member, such as an index."""
        m = self.members[name]
        raw = self.source.read_at(m.packed, self._begin(m))
        if m.method not in (0, 8):
            raise ValueError(f"{name} has compression method {m.method}")
        raw = raw if m.method == 0 else zlib.decompress(raw, -15)
        return gzip.decompress(raw) if raw[:2] == GZIP else raw

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of the bytes of a stored member."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored; its records cannot be read by range")
        return self._begin(m), m.packed

    def _begin(self, m: Member) -> int:
        local = self.source.read_at(30, m.header)
        if local[:4] != self.LOCAL:
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + n_name + n_extra


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and place with those that did not fit taken from the ZIP64 field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, k, out = extra[at + 4 : at + 4 + n], 0, []
            for v in values:
                if v == 0xFFFFFFFF and k + 8 <= len(field):
                    v = struct.unpack_from("<Q", field, k)[0]
                    k += 8
                out.append(v)
            return out
        at += 4 + n
    return list(values)


# -- records ---------------------------------------------------------------------------------------


def _urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = NO_DATE) -> bytes:
    """One record; a revisit keeps the HTTP header of its page, which has the payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}", "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: {_urn(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


def parse_record(raw: bytes) -> dict:
    """``headers, http, payload`` of one unpacked record; field names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(head)
    body = rest[: int(headers["content-length"])]
    http: dict[str, str] = {}
    if headers.get("content-type", "").startswith("application/http"):
        http_head, _, body = body.partition(b"\r\n\r\n")
        http = _fields(http_head)
    return {"headers": headers, "http": http, "payload": body}


def walk(source, start: int, length: int) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` of the records of an archive without index, gzip members or plain."""
    if source.read_at(min(2, length), start) != GZIP:
        yield from _walk_plain(source, start, length)
        return
    at, began, end = start, start, start + length
    unpack = zlib.decompressobj(31)
    while at < end:
        data = source.read_at(min(1 << 20, end - at), at)
        at += len(data)
        while data:
            unpack.decompress(data)
            data = b""
            if unpack.eof:
                data = unpack.unused_data
                yield began - start, at - len(data) - began
                began, unpack = at - len(data), zlib.decompressobj(31)
    if began < end:
        raise ValueError(f"the archive ends within the record at {began - start}")


def _walk_plain(source, start: int, length: int) -> Iterator[tuple[int, int]]:
    at, end = start, start + length
    while at < end:
        head, n = b"", 1 << 12
        while b"\r\n\r\n" not in head and len(head) < min(n, end - at):
            head = source.read_at(min(n, end - at), at)
            n *= 4
        head, mark, _ = head.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at - start}")
        size = len(head) + 4 + int(_fields(head)["content-length"]) + 4
        if at + size > end:
            raise ValueError(f"the archive ends within the record at {at - start}")
        yield at - start, size
        at += size


# -- writing ---------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; payloads that can have no equal are not shuffled."""
    payload = text_or_empty(payload_col).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.xxhash64(payload).alias("_h"),
    )
    tagged = with_possible_repeats(rows, 1 << 26).drop("_h")
    open_ = F.col("_again") & (F.octet_length("payload") >= least) & F.col("page_id").isNotNull()
    own = tagged.filter(~open_).drop("_again").withColumn("refers_to", F.lit(None).cast("bigint"))
    repeated = tagged.filter(open_).drop("_again")
    groups = cut(repeated.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")))
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    joined = join_groups(repeated, groups, "digest", "n")
    return own.unionByName(joined.select("page_id", "url", "payload", "digest", refers))


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = LEAST, level: int = 6,
) -> DataFrame:
    """Write one package per task below *folder*; returns the manifest ``path, n_records``.

    A task that runs again writes a package of another name; only those of the manifest count.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = attempt_name(f"{folder}/part", ".wacz")
        out = package = member = None
        lines: list[str] = []
        at = 0
        for batch in parts:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    out = open_output(path)
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = package.open(ARCHIVE, "w", force_zip64=True)
                record = gzip.compress(make_record(page_id, url, payload, digest, refers_to), level, mtime=0)
                member.write(record)
                lines.append(json.dumps({"offset": at, "length": len(record), "filename": ARCHIVE}))
                at += len(record)
        if package is not None:
            member.close()
            package.writestr(INDEX, "\n".join(lines) + "\n")
            package.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(lines)]})

    rows = with_revisits(pages, id_col, url_col, payload_col, least)
    return cut(rows.mapInArrow(run, "path string, n_records bigint"))


# -- reading ---------------------------------------------------------------------------------------


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _archive(package: Package, name: str) -> str:
    """The archive member that an index means; most indexes leave the folder out."""
    for known in (name, f"archive/{name}"):
        if known in package.members:
            return known
    raise ValueError(f"no archive {name}")


def _entries(package: Package, places: dict[str, tuple[int, int]]) -> Iterator[tuple[str | None, int | None, int | None, str | None]]:
    """``archive, offset in the package, length, error`` of the lines of all indexes."""
    for name in package.members:
        # A .idx file only leads to parts of another index.
        if not name.startswith("indexes/") or name.endswith((".idx", "/")):
            continue
        try:
            lines = package.read(name).splitlines()
        except Exception as e:
            yield None, None, None, _reason(e)
            continue
        for line in lines:
            if not line.strip() or line.startswith(b"!") or b"{" not in line:
                continue
            try:
                entry = json.loads(line[line.index(b"{") :])
                archive = _archive(package, entry["filename"])
                offset, length = int(entry["offset"]), int(entry["length"])
                if archive not in places:
                    continue
                start, size = places[archive]
                if not 0 <= offset < offset + length <= size:
                    raise ValueError(f"place {offset}, {length} is outside of {archive}")
                yield archive, start + offset, length, None
            except Exception as e:
                yield None, None, None, _reason(e)


def _records(source) -> Iterator[tuple[int | None, int | None, str | None]]:
    """``offset, length, error`` of all records of one package."""
    package, places = Package(source), {}
    for name in package.members:
        if name.startswith("archive/") and not name.endswith("/"):
            try:
                places[name] = package.place(name)
            except Exception as e:
                yield None, None, _reason(e)
    named = set()
    for archive, offset, length, error in _entries(package, places):
        named.add(archive)
        yield offset, length, error
    for archive, (start, size) in places.items():
        if archive not in named:
            try:
                for offset, length in walk(source, start, size):
                    yield start + offset, length, None
            except Exception as e:
                yield None, None, f"{archive}: {_reason(e)}"


LOCATED = "path string, offset bigint, length bigint, error string"


def locate(packages: DataFrame) -> DataFrame:
    """``path, offset, length`` of every record of the packages in column ``path``, and rows with ``error``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path in batch.column(0).to_pylist():
                found: list[tuple] = []
                try:
                    with open_input(path) as source:
                        found.extend(_records(source))
                except Exception as e:
                    found.append((None, None, _reason(e)))
                columns = list(zip(*found)) or [()] * 3
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), *arrays], names=["path", "offset", "length", "error"]
                )

    spread = packages.select("path").repartition(max(1, packages.count()), "path")
    return spread.mapInArrow(run, LOCATED)


RECORD = (
    "record_id string, record_type string, url string, payload_digest string, refers_to string, "
    "payload_bytes bigint, payload binary, path string, offset bigint, error string"
)
_KINDS = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]


def _agrees(said: str, payload: bytes) -> bool:
    """Whether a digest in hexadecimal or base 32 is the payload's; one of an unknown kind is not judged."""
    kind, _, value = said.partition(":")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(kind, payload).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _row(raw: bytes, with_payload: bool) -> tuple:
    r = parse_record(gzip.decompress(raw) if raw[:2] == GZIP else raw)
    h, error = r["headers"], None
    said = h.get("warc-payload-digest", "")
    if h["warc-type"] == "revisit":
        digest, size = said.removeprefix("sha256:"), int(r["http"].get("content-length", 0))
    else:
        digest, size = hashlib.sha256(r["payload"]).hexdigest(), len(r["payload"])
        if not _agrees(said, r["payload"]):
            error = "the payload does not match its digest"
    payload = r["payload"] if with_payload else None
    return (h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), digest, h.get("warc-refers-to"), size,
            payload, error)


def _rows(path: str, data: bytes, begin: int, places: list[tuple[int, int]], with_payload: bool) -> Iterator[tuple]:
    for offset, length in places:
        try:
            *fields, error = _row(data[offset - begin : offset - begin + length], with_payload)
        except Exception as e:
            fields, error = [None] * 7, _reason(e)
        yield *fields, path, offset, error


def read(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the packages in column ``path``; digests of payloads are checked.

    A record that cannot be read has its place and ``error``; one whose payload differs from its
    digest is returned with ``error``.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at_path = None, None
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in parts:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            k = 0
            while k < len(rows):
                path, start, length, error = rows[k]
                last = k + 1
                if error is not None:
                    out = [(*[None] * 7, path, None, error)]
                else:
                    end = start + length
                    while last < len(rows) and rows[last][:2] == (path, end) and end - start < FETCH:
                        end += rows[last][2]
                        last += 1
                    if path != at_path:
                        if source is not None:
                            source.close()
                        source, at_path = open_input(path), path
                    data = source.read_at(end - start, start)
                    out = list(_rows(path, data, start, [r[1:3] for r in rows[k:last]], with_payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=names)
                k = last
        if source is not None:
            source.close()

    n_parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("offset") / BLOCK)
    dealt = locate(packages).repartition(n_parts, "path", block).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, RECORD)


def page_of(urn):
    """The page id in a record id of :func:`make_record`."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1)
