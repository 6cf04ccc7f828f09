"""WARC archives: written as monolithic gzip, normalised to a member a record with an offset index,
and read back by that index.

A crawl's archives often come as one gzip stream each, which nothing can read from the middle. The
normaliser inflates each stream once, writes every record as a gzip member of its own, and a sidecar
index of their places beside it. Files lie in the shared folder; a file counts only if the task that
wrote it reported it, so tasks may be lost and run again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder, tune

#: Bytes of records in an archive before the next one is begun.
ROLL_BYTES = 128 << 20
LEVEL = 3
#: Tables with more distinct repeated payloads are joined by shuffle instead of broadcast.
BROADCAST_REPEATS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GZIP = 31  # zlib's window bits for the gzip format


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of ``refers_to`` without it."""
    body = HTTP if refers_to is not None else HTTP + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, piece by piece."""
    z, fed = zlib.decompressobj(GZIP), False
    while data := source.read(size):
        while data:
            piece = z.decompress(data)
            fed = True
            if piece:
                yield piece
            data = z.unused_data if z.eof else b""
            if z.eof:
                z, fed = zlib.decompressobj(GZIP), False
    if fed:
        raise ValueError("the gzip stream ends early")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; one record is in memory at a time."""
    held = bytearray()
    need = 0  # bytes of the record at the start of held, 0 if its header is not yet whole
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])
                if not length:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the last record is cut off")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, refers_to) as whole-file gzip archives; (path, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        out, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = store.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                data = record_bytes(page_id, url, payload, refers_to)
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.write(z.flush())
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """From (path, records) of archives: rewrite each with a gzip member for every record, beside an
    index of (id, offset, length); (path, index, records) of each new archive. A file whose number of
    records is not the one reported raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                at, n = 0, 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(name, compression=None) as out, store.open_output_stream(name + ".idx", compression=None) as index:
                    for record in split_records(inflate(source)):
                        head = headers(record[: record.index(b"\r\n\r\n")])
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        index.write(json.dumps([head["warc-record-id"], at, len(member)]).encode() + b"\n")
                        at, n = at + len(member), n + 1
                if n != records:
                    raise ValueError(f"{path}: {n} records, {records} were written")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name + ".idx"]), pa.array([n], pa.int64())], names=["path", "index", "records"])

    return archives.repartition(max(1, archives.count())).mapInArrow(run, "path string, index string, records long")


def page_of(urn: str | None) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(got[1]) if got else None


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, each opened at its place in the index.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).
    The digest of a response is computed again; one that differs from its header raises an error.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as archive, store.open_input_stream(index, compression=None) as places:
                    for line in places.read().splitlines():
                        _, at, length = json.loads(line)
                        archive.seek(at)
                        record = zlib.decompress(archive.read(length), GZIP)
                        end = record.index(b"\r\n\r\n")
                        head = headers(record[:end])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        payload = None
                        if head["warc-type"] == "response":
                            payload = record[record.index(b"\r\n\r\n", end + 4) + 4 : -4]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{path} at {at}: the payload is not what its digest says")
                        size = int(head["warc-payload-length"]) if payload is None else len(payload)
                        rows.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], page_of(head.get("warc-refers-to")), payload))
                        held += len(payload or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.select("path", "index").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write every page as a record, normalise the archives; (path, index, records) of them and their
    folder.

    Of pages with equal payloads of at least ``min_revisit_bytes`` the one with the largest page_id
    is the response, the others revisit it; rows that repeat that page are responses too. A null html
    is an empty payload. A null page_id revisits the page of an equal payload, if there is one. An empty table
    gives no archive; columns other than page_id, url and html are not read.
    """
    tune(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    large = F.length("payload") >= min_revisit_bytes
    repeats = rows.where(large).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    repeats = checkpointed(repeats.where("n > 1").select(F.col("sha").alias("same"), "response"))
    side = F.broadcast(repeats) if repeats.count() <= BROADCAST_REPEATS else repeats
    joined = rows.join(side, (F.col("sha") == F.col("same")) & large, "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    folder = shared_folder(pages.sparkSession, "warc")
    written = checkpointed(write_monolithic(joined.select("page_id", "url", "payload", other.alias("refers_to")), f"{folder}/whole"))
    archives = checkpointed(normalise(written, f"{folder}/records"))
    store, root = opened(folder)
    if store.get_file_info(f"{root}/whole").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/whole")
    return archives, folder


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to as read from the archives; nulls and repeats
    as in ``archive_pages``, an empty table gives an empty table, other columns are not carried."""
    archives, folder = archive_pages(pages)
    read = read_archives(archives.repartition(max(1, archives.count())), folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html, upper(sha1(coalesce(html, ''))) as hex from pages),
g as (select *, max(page_id) over (partition by hex) as response from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = response or response is null then 'response' else 'revisit' end as record_type,
  case when page_id = response then null else response end as refers_to
from g
"""
