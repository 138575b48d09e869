"""WARC archives: a normaliser for monolithic gzip files, with a sidecar offset index.

An archive written as one gzip stream cannot be read at a record. The normaliser inflates the stream once, piece by
piece, finds the records by their lengths, rewrites each one as a gzip member of its own and writes the members'
offsets beside the archive. `write_archives` makes archives of a table of pages; `read_archives` reads members at the
offsets that the sidecars name, and `read_record` any one of them.
Files go through Arrow's file systems to the shared folder; a task names its files by its attempt, so that one that
runs again leaves the others alone.

Defined cases: null html is an empty payload; payloads under 100 bytes are always responses; of equal longer ones the
smallest id is the response; rows that repeat that id and payload are responses as well, rows without an id are
revisits if any id has their payload; a null url is written as an empty one; an empty table makes no archive. Payloads
don't move: only ids and digests are exchanged, and Spark broadcasts the digests that several pages have if their table
is under its own limit (else that join sorts and shuffles).
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder

#: Payload bytes of one archive, and bytes inflated at once.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 20
LEAST = 100


def place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    if folder.startswith("file:"):
        folder = folder[5:]
    return fs.LocalFileSystem(), folder


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """A response record, or a revisit that keeps only headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head[-1:-1] = [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    end = raw.index(b"\r\n\r\n")
    fields = fields_of(raw[:end])
    return fields, raw[end + 4 : end + 4 + int(fields["Content-Length"])]


def split_records(stream) -> Iterator[bytes]:
    """Whole records of an inflated stream of pieces."""
    held = bytearray()
    need = seen = 0
    for piece in stream:
        held += piece
        while True:
            if not need:
                if (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                    seen = len(held)
                    break
                seen = 0
                head = bytes(held[: end + 2]).lower()
                at = head.find(b"\r\ncontent-length:")
                if not head.startswith(b"warc/") or at < 0:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(head[at + 17 : head.find(b"\r\n", at + 17)]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive breaks off in a record")


def inflate(source) -> Iterator[bytes]:
    """The content of a gzip file, in one pass; several members run on."""
    unzip = zlib.decompressobj(31)
    while piece := source.read(PIECE):
        while piece:
            yield unzip.decompress(piece, 4 * PIECE)
            if unzip.eof:
                piece, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                piece = unzip.unconsumed_tail
    yield unzip.flush()


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def normalise(system: fs.FileSystem, source: str, target: str) -> int:
    """Rewrites one archive and writes target.idx, a line of JSON a record: [record id, offset, length]; how many."""
    at = n = 0
    with system.open_input_stream(source, compression=None) as src, system.open_output_stream(target, compression=None) as out, system.open_output_stream(target + ".idx", compression=None) as idx:
        for raw in split_records(inflate(src)):
            z = member(raw)
            out.write(z)
            idx.write((json.dumps([fields_of(raw[: raw.index(b"\r\n\r\n")])["WARC-Record-ID"], at, len(z)]) + "\n").encode())
            at += len(z)
            n += 1
    return n


def read_index(system: fs.FileSystem, archive: str) -> Iterator[tuple[str, int, int]]:
    """(record id, offset, length) of an archive's records, from its sidecar."""
    with system.open_input_stream(archive + ".idx", compression=None) as src:
        for line in io.BufferedReader(src):
            yield tuple(json.loads(line))


def read_record(archive: str, record_id: str) -> tuple[dict[str, str], bytes] | None:
    """(fields, block) of one record, by its offset."""
    system, path = place(archive)
    for name, offset, length in read_index(system, path):
        if name == record_id:
            with system.open_input_file(path) as file:
                file.seek(offset)
                return parse(zlib.decompress(file.read(length), 31))
    return None


def _writer(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        z, out, name, held = None, None, "", 0

        def finish() -> pa.RecordBatch:
            nonlocal z, out
            out.write(z.flush())
            out.close()
            z = out = None
            n = normalise(system, f"{name}.mono.gz", f"{name}.warc.gz")
            system.delete_file(f"{name}.mono.gz")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name[len(path) + 1:]}.warc.gz"]), pa.array([n], pa.int64())], ["path", "records"])

        for rb in batches:
            for page_id, url, payload, digest, size, refers in zip(*(rb.column(c) for c in ("page_id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                if out is None:
                    name, held = f"{path}/{uuid.uuid4().hex}", 0
                    system.create_dir(path, recursive=True)
                    out, z = system.open_output_stream(f"{name}.mono.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                body = (payload.as_py() or "").encode()
                out.write(z.compress(record(page_id.as_py(), url.as_py() or "", body, digest.as_py(), size.as_py(), refers.as_py())))
                held += len(body)
                if held >= ARCHIVE_BYTES:
                    yield finish()
        if out is not None:
            yield finish()

    return rows


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and their sidecars to the shared folder; (path, records) of each."""
    payload = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload").cast("long")})
    firsts = rows.where(f"size >= {LEAST}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    named = rows.join(materialize(firsts, "digests"), "digest", "left").select(
        "page_id", "url", F.when((F.col("first") == F.col("page_id")) | F.col("first").isNull(), F.col("payload")).alias("payload"), "digest", "size",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )
    return materialize(named.mapInArrow(_writer(new_folder(pages.sparkSession, "warc")), "path string, records long"), "warc-archives")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda s: int(n) if (n := s.rsplit(":", 1)[-1].rstrip(">")) else None
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    cols: list = [[] for _ in kinds]

    def full() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for c in cols:
            c.clear()
        return made

    for rb in batches:
        for archive in rb.column(0).to_pylist():
            system, path = place(archive)
            with system.open_input_file(path) as file:
                for name, offset, length in read_index(system, path):
                    file.seek(offset)
                    fields, block = parse(zlib.decompress(file.read(length), 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["WARC-Type"]
                    said = fields["WARC-Payload-Digest"].split(":")[1]
                    size = int(http.decode().lower().split("content-length: ")[1].split("\r\n")[0])
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else said
                    if fields["WARC-Record-ID"] != name or kind == "response" and (digest != said or size != len(payload)):
                        raise ValueError(f"record at {offset} of {path} is not the one that its index names")
                    for c, v in zip(cols, (number(name), fields["WARC-Target-URI"], size, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None), strict=True):
                        c.append(v)
                    if len(cols[0]) >= 10_000:
                        yield full()
    yield full()


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records of archives(path), by their sidecars."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return archives.select("path").repartition(n, "path").mapInArrow(_reader, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
