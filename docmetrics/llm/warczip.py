"""WARC archives packaged in ZIP files: writing, and range-reading records without extraction."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, scratch

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, gzip-compressed as a member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    """A parsed record; ``payload`` is None where the record has none of its own (revisit)."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None

    @property
    def payload_length(self) -> int:
        return len(self.payload) if self.payload is not None else int(self.http.get("content-length", 0))

    @property
    def digest(self) -> str:
        """Of the full payload: computed where it is here, else as the record says."""
        return digest32(self.payload) if self.payload is not None else self.headers.get("warc-payload-digest", "").removeprefix("sha1:")


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(compressed: bytes) -> Record:
    raw = zlib.decompress(compressed, 31)
    top, _, rest = raw.partition(CRLF + CRLF)
    first, *lines = top.split(CRLF)
    if not first.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = _headers(lines)
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("record is cut short")
    http, _, payload = block.partition(CRLF + CRLF)
    return Record(headers, _headers(http.split(CRLF)[1:]), None if headers.get("warc-type") == "revisit" else payload)


# ---------------------------------------------------------------- ZIP


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int
    crc: int


class ZipDirectory:
    """Members of a ZIP file, from its central directory (ZIP64 where present); data is read by ranges."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        tail_at = max(0, size - 65557)
        tail = self._read(tail_at, size - tail_at)
        end = self._end(tail, tail_at)
        if end < 0:
            raise ValueError("no end of a central directory")
        at = end - tail_at
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07" and (0xFFFF == count or 0xFFFFFFFF in (length, start)):
            (place,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            record = self._read(place, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
            count, length, start = struct.unpack("<QQQ", record[32:56])
        self.members = self._entries(self._read(start, length), count)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        got = self.stream.read(n)
        if len(got) != n:
            raise ValueError("ZIP file is cut short")
        return bytes(got)

    @staticmethod
    def _end(tail: bytes, tail_at: int) -> int:
        """Place of the end record whose comment reaches exactly to the end of the file."""
        at = len(tail)
        while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
            if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
                return tail_at + at
        return -1

    @staticmethod
    def _entries(raw: bytes, count: int) -> dict[str, Member]:
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            flags, method, crc, packed, size = struct.unpack("<HH4xIII", raw[at + 8 : at + 28])
            n_name, n_extra, n_comment = struct.unpack("<HHH", raw[at + 28 : at + 34])
            (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[x : x + 4])
                if kind == 1:  # 64-bit values, in this order, of the fields that are all ones
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[x + 4 : x + 4 + n // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                x += 4 + n
            out[name] = Member(name, method, packed, header, crc)
            at += 46 + n_name + n_extra + n_comment
        return out

    def data_at(self, member: Member) -> int:
        """Where a member's data begins: behind its local header, whose extra field may differ from the directory's."""
        local = self._read(member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{member.name}: no local header")
        return member.header + 30 + sum(struct.unpack("<HH", local[26:30]))

    def range(self, member: Member, offset: int, n: int) -> bytes:
        """Bytes of a stored member; nothing else of the file is read."""
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{member.name} is compressed, not stored")
        if offset < 0 or offset + n > member.size:
            raise ValueError(f"{member.name}: range beyond the member")
        return self._read(self.data_at(member) + offset, n)


def index_name(archive: str) -> str:
    return "indexes/" + archive.removeprefix("archive/").removesuffix(".warc.gz") + ".cdxj"


def archive_bytes(members: list[list[tuple[str, bytes]]]) -> bytes:
    """A ZIP of stored members: for each list of (key, record) a WARC and its index of offsets and lengths."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for k, records in enumerate(members):
            name, at, lines = f"archive/data-{k:05d}.warc.gz", 0, []
            for key, raw in records:
                lines.append(json.dumps({"key": key, "filename": name, "offset": at, "length": len(raw)}))
                at += len(raw)
            z.writestr(name, b"".join(raw for _, raw in records))
            z.writestr(index_name(name), "\n".join(lines) + "\n")
    return out.getvalue()


def read_archive(stream, size: int, window: int = 4 << 20) -> Iterator[Record]:
    """Records of an archive: indexes are looked up in the directory, neighbouring ranges are read together."""
    directory = ZipDirectory(stream, size)
    for name, index in directory.members.items():
        if not (name.startswith("indexes/") and name.endswith(".cdxj")):
            continue
        entries = [json.loads(x) for x in directory.range(index, 0, index.size).splitlines() if x.strip()]
        entries.sort(key=lambda e: (e["filename"], e["offset"]))
        at = 0
        while at < len(entries):
            first, last = entries[at], at
            while last + 1 < len(entries) and entries[last + 1]["filename"] == first["filename"] and entries[last + 1]["offset"] + entries[last + 1]["length"] - first["offset"] <= window:
                last += 1
            end = entries[last]["offset"] + entries[last]["length"]
            raw = directory.range(directory.members[first["filename"]], first["offset"], end - first["offset"])
            for e in entries[at : last + 1]:
                start = e["offset"] - first["offset"]
                yield parse_record(raw[start : start + e["length"]])
            at = last + 1


# ---------------------------------------------------------------- Spark


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_size: int, member_size: int) -> Iterator[pa.RecordBatch]:
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    task = TaskContext.get()
    # the attempt is part of the name: a second attempt never overwrites what the first has listed
    stem, number = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
    members: list[list[tuple[str, bytes]]] = [[]]
    filled = in_member = count = 0

    def close() -> pa.RecordBatch:
        nonlocal number
        name = f"{stem}-{number:05d}.zip"
        number += 1
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(archive_bytes(members))
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["archive", "records"])

    for batch in batches:
        for page, url, html, keeper in zip(*(batch.column(i) for i in range(4)), strict=True):
            page, keeper = page.as_py(), keeper.as_py()
            raw = warc_record(page, url.as_py(), html.as_py(), keeper, page != keeper)
            if in_member and in_member + len(raw) > member_size:
                members.append([])
                in_member = 0
            members[-1].append((record_urn(page), raw))
            filled, in_member, count = filled + len(raw), in_member + len(raw), count + 1
            if filled >= archive_size:
                yield close()
                members, filled, in_member, count = [[]], 0, 0, 0
    if count:
        yield close()


READ = "page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            rows, held = [], 0
            with store.open_input_file(path) as stream:
                for r in read_archive(stream, stream.size()):
                    payload = r.payload if with_payload else None
                    rows.append((urn_page(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), payload, r.payload_length, r.digest, r.headers["warc-type"], urn_page(r.headers.get("warc-refers-to"))))
                    held += len(payload or b"")
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_size: int = 32 << 20, member_size: int = 8 << 20) -> DataFrame:
    """Writes one WARC record per page into ZIP archives under ``folder``; returns (archive, records), a written table.

    Of pages with equal payloads (SHA-1 and length) of at least ``least`` bytes, the one with the largest id
    becomes a response with the payload, the others revisits that refer to it; all others are
    responses. Rows that repeat that id are responses too. A null id never wins against another and cannot be
    referred to. Null html counts as empty; a null url leaves out the target. Other columns are ignored; an
    empty table writes no archive. Each task writes archives of about ``archive_size`` bytes through
    the file system of the folder's URI (file, s3, gs, hdfs), named by the task attempt.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("bytes", F.octet_length("html"))
    # written before the join, which can then split a payload that very many pages have
    keepers = materialize(rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper")), "keepers")
    # no broadcast, even where the pages are few: the same plan at every size
    joined = rows.join(keepers.hint("merge"), ["digest", "bytes"])
    keeper = F.when(F.col("bytes") >= least, F.col("keeper")).otherwise(F.col("page_id"))
    written = joined.select("page_id", "url", "html", keeper.alias("keeper")).mapInArrow(lambda it: _write(it, folder, archive_size, member_size), "archive string, records long")
    manifest = materialize(written, "manifest")
    discard(keepers)
    return manifest


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives listed in column ``archive``: one row each, read by ranges of the stored members.

    Returns (page_id, target_uri, payload, payload_bytes, payload_digest, record_type, refers_to); length and
    digest are of the full payload for revisits too, whose ``payload`` is null.
    """
    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInArrow(lambda it: _read(it, with_payload), READ)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` as archives into the shared folder and reads them back, without payloads; the archives are then deleted."""
    folder = scratch(spark, "warc")
    manifest = write_archives(pages, folder, least)
    records = materialize(read_archives(manifest, with_payload=False).drop("target_uri", "payload"), "records")
    discard(manifest)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return records
