"""WARC records in ZIP archives: a writer, and a reader that fetches records by range.

An archive holds two stored (uncompressed) members: WARC records, each a gzip member
of its own, and an index of them. The reader parses the end record, the ZIP64
directory where there is one and the central directory, finds the members in the
archive, reads the index, and then reads each record by offset and length; nothing
is unpacked to disk.

Records with equal payloads (by SHA-1) are written once: the one with the smallest
page_id is the response and the others revisit it. Null html is an empty payload.
Repeated rows of that page_id are all responses. Null ids are kept and come last in
order. Empty tables give no archive and no rows.

Files are written under a temporary name and moved in place, so a task that runs
twice leaves one whole archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, ensure_checkpoint_dir

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_DATE = "2024-01-01T00:00:00Z"  # captures carry no time of their own


def open_store(uri: str):  # noqa: ANN201
    """File system and path of a URI; a path without scheme is local or mounted."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: str | None) -> str:
    """Ids are text here; a null id has no quotes."""
    return f"<urn:page:{quote(json.dumps(page_id), safe='')}>"


def _page_id(record_id: str | None) -> str | None:
    return json.loads(unquote(record_id.removeprefix("<urn:page:").removesuffix(">"))) if record_id else None


def warc_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP headers of the payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (y.partition(":") for y in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def locate_members(file, size: int) -> dict[str, tuple[int, int]]:  # noqa: ANN001
    """(offset of data, length) of the stored members of an archive, from its directories."""

    def at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    tail_at = max(0, size - 65_577)  # the longest comment, the end record and a ZIP64 locator
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # the comment may hold the same four bytes; the record's own comment ends with the file
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end + 3)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
        record = at(end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, found, p = at(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, plain, names, extras, remarks, where = struct.unpack("<10xH8xIIHHH8xI", directory[p : p + 46])
        name = directory[p + 46 : p + 46 + names].decode()
        extra = directory[p + 46 + names : p + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the fields that didn't fit, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                if plain == 0xFFFFFFFF:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if where == 0xFFFFFFFF:
                    where = wide.pop(0)
            extra = extra[4 + n :]
        if method == 0:
            local = at(where, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            found[name] = (where + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        p += 46 + names + extras + remarks
    return found


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes pages (page_id, url, html) as archives of about archive_bytes into folder; gives path and records of each."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    again = base.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    typed = base.join(apart(again.where("c > 1").select("digest", "first")), "digest", "left")
    first = F.when(F.octet_length("html") >= least_bytes, F.col("first")).cast("string")
    typed = typed.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", first.alias("first"))
    if "://" not in folder and not folder.startswith("file:") and not pages.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} has no scheme: on a cluster each executor would write to its own disk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        part, archive, done = TaskContext.get().partitionId(), None, []

        def close() -> None:
            nonlocal archive
            zipped, member, stream, temporary, lines, at = archive
            member.close()
            with zipped.open(zipfile.ZipInfo(INDEX), "w") as index:
                index.write("".join(lines).encode())
            zipped.close()
            stream.close()
            final = f"{root}/part-{part:06d}-{len(done):04d}.zip"
            store.move(temporary, final)
            done.append((final, len(lines)))
            archive = None

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first")), strict=True):
                if archive is None:
                    store.create_dir(root, recursive=True)
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(temporary)
                    zipped = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    archive = [zipped, zipped.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True), stream, temporary, [], 0]
                i, to = page_id.as_py(), first.as_py()
                revisit = to is not None and to != i
                packed = gzip.compress(warc_record(i, url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), to, revisit), 6, mtime=0)
                archive[1].write(packed)
                archive[4].append(json.dumps({"id": i, "offset": archive[5], "length": len(packed)}) + "\n")
                archive[5] += len(packed)
                if archive[5] >= archive_bytes:
                    close()
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return typed.mapInArrow(run, "path string, records long")


def read_archives(spark: SparkSession, folder: str, paths: list[str], run_length: int = 64, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """A row per record of the archives at these paths, with its payload unless payloads is false.

    One task for each archive reads directories and index; runs of records are then
    dealt to tasks that read them by range. Each payload is hashed again and must give the digest in its headers.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    members = locate_members(file, file.size())
                    file.seek(members[INDEX][0])
                    lines = [json.loads(x) for x in file.read(members[INDEX][1]).splitlines()]
                start = members[RECORDS][0]
                for i in range(0, len(lines), run_length):
                    run = lines[i : i + run_length]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([start + run[0]["offset"]], pa.int64()), pa.array([[x["length"] for x in run]], pa.list_(pa.int64()))],
                        ["path", "offset", "lengths"],
                    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, offset, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "lengths")), strict=True):
                rows = []
                with store.open_input_file(path) as file:
                    file.seek(offset)
                    for n in lengths:
                        warc, http, payload = parse_record(gzip.decompress(file.read(n)))
                        full = warc["warc-type"] == "response"
                        if full and base32_sha1(payload) != warc["warc-payload-digest"].removeprefix("sha1:"):
                            raise ValueError("payload does not match its digest")
                        rows.append(
                            (
                                _page_id(warc["warc-record-id"]),
                                int(http["content-length"]),
                                warc["warc-payload-digest"].removeprefix("sha1:"),
                                warc["warc-type"],
                                _page_id(warc.get("warc-refers-to")),
                                payload if full and payloads else None,
                            )
                        )
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    archives = spark.createDataFrame([(p,) for p in paths], "path string")
    runs = archives.repartition(max(1, len(paths))).mapInArrow(index, "path string, offset long, lengths array<long>")
    dealt = runs.repartition(max(1, 2 * spark.sparkContext.defaultParallelism))
    back = dealt.mapInArrow(fetch, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    back = back.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    return back if payloads else back.drop("payload")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages into a new folder of the shared directory and reads them back.

    Only the paths of the archives pass through the driver. Ids may be of any type that text can spell.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    paths = [r.path for r in write_archives(pages, folder, least_bytes).select("path").collect()]
    return read_archives(spark, folder, paths, id_type=pages.schema["page_id"].dataType.simpleString(), payloads=False)
