"""WARC files: writing pages, and normalising archives that are one gzip stream.

A monolithic archive is one gzip stream over all records, which nobody can enter in the middle.  The normaliser inflates each
file once, as a stream, writes every record as its own gzip member and a sidecar index of their offsets.  Files are written
through Arrow's file systems under a temporary name and then moved, so a repeated task leaves no half file; only finished
files are listed in the table that the next step reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.session import broadcast_if_small, cut_lineage, scratch_dir

#: Inflated bytes of one archive.
ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 20
LISTED = "archive string, records long"


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind)]
    if page is not None:
        fields.append(("WARC-Record-ID", f"<urn:page:{page}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers}>"))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Out:
    """A file that appears under its name only when finished."""

    def __init__(self, folder: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root)
        self.name = uuid.uuid4().hex
        self.path = f"{root}/{self.name}.warc.gz"
        self.file = self.store.open_output_stream(f"{self.path}.part", compression=None)

    def done(self) -> str:
        self.file.close()
        self.store.move(f"{self.path}.part", self.path)
        return f"{self.name}.warc.gz"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as monolithic archives; their table (archive, records).

    Of equal payloads of at least ``least_bytes`` the smallest page_id is a response, the others revisit it.  Null html is an
    empty payload.  Rows that repeat that smallest id are all responses; so is a page without an id.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = cut_lineage(pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")))
    same = keys.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("m"))
    same = cut_lineage(same.filter("m > 1").select("digest", "refers"))
    later = keys.filter(F.col("n") >= least_bytes).join(same, "digest").filter("page_id > refers").select("page_id", "digest", "refers").distinct()
    later = cut_lineage(later.withColumnsRenamed({"page_id": "_page", "digest": "_digest"}))
    marked = pages.join(
        broadcast_if_small(later),
        (F.col("page_id") == F.col("_page")) & (F.sha1(html.cast("binary")) == F.col("_digest")),
        "left",
    ).select("page_id", "url", "html", "refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, records = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                kind = "response" if row["refers"] is None else "revisit"
                raw = record(kind, row["page_id"], row["url"], payload, digest_of(payload), len(payload), row["refers"])
                if out is None:
                    out, squeeze, size, records = _Out(folder), zlib.compressobj(1, wbits=31), 0, 0
                out.file.write(squeeze.compress(raw))
                size, records = size + len(raw), records + 1
                if size >= archive_bytes:
                    out.file.write(squeeze.flush())
                    yield pa.record_batch([[out.done()], [records]], ["archive", "records"])
                    out = None
        if out is not None:
            out.file.write(squeeze.flush())
            yield pa.record_batch([[out.done()], [records]], ["archive", "records"])

    return cut_lineage(marked.mapInArrow(write, LISTED))


def inflated(file) -> Iterator[bytes]:
    """The file's content piece by piece, whether it is one gzip stream or several in a row."""
    squeeze, fed = zlib.decompressobj(31), False
    while piece := file.read(PIECE):
        while piece:
            fed = True
            yield squeeze.decompress(piece)
            piece = squeeze.unused_data
            if squeeze.eof:
                squeeze, fed = zlib.decompressobj(31), False
    if fed:
        raise ValueError("the gzip stream ends in the middle")


def records_of(file) -> Iterator[bytes]:
    """Raw records, one at a time."""
    held, at = bytearray(), 0
    need = None
    for piece in inflated(file):
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = held[at:end].decode().split("\r\n")
                length = next(int(x.split(":", 1)[1]) for x in fields if x.lower().startswith("content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[at:need])
            at, need = need, None
        del held[:at]
        need, at = (None if need is None else need - at), 0
    if held:
        raise ValueError("the last record is cut off")


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite the listed archives of ``folder`` under ``target``: a member for each record, and ``<archive>.index`` with a
    JSON line (offset, length, id, type, digest) for each.  Returns (archive, records); a broken archive stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                out, lines, offset = _Out(target), [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for raw in records_of(file):
                        member = gzip.compress(raw, 1, mtime=0)
                        fields = parse(raw)[0]
                        entry = {"offset": offset, "length": len(member), "id": fields.get("WARC-Record-ID"), "type": fields["WARC-Type"], "digest": fields.get("WARC-Payload-Digest")}
                        lines.append(json.dumps(entry))
                        out.file.write(member)
                        offset += len(member)
                with out.store.open_output_stream(f"{out.path}.index", compression=None) as index:
                    index.write("".join(f"{x}\n" for x in lines).encode())
                yield pa.record_batch([[out.done()], [len(lines)]], ["archive", "records"])

    return cut_lineage(_spread(archives).mapInArrow(run, LISTED))


def _spread(archives: DataFrame) -> DataFrame:
    return archives.repartition(max(1, archives.count()))


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Each record, read as its own member at the offset that the index names; a response's digest is checked."""

    def number(x: str | None) -> int | None:
        return None if x is None else int(x[len("<urn:page:") : -1])

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{name}.index", compression=None) as file:
                    index = [json.loads(x) for x in file.read().splitlines()]
                with store.open_input_file(f"{root}/{name}") as file:
                    rows, held = [], 0
                    for entry in index:
                        fields, block = parse(gzip.decompress(file.read_at(entry["length"], entry["offset"])))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if entry["type"] == "response" and digest_of(payload) != digest:
                            raise ValueError(f"{name}: payload at {entry['offset']} does not have its digest")
                        rows.append((number(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), payload.decode() if entry["type"] == "response" else None, size, digest, entry["type"], number(fields.get("WARC-Refers-To"))))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _spread(archives).mapInArrow(run, schema)


def pages_through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to monolithic archives, normalised, and read back from the normalised ones; all under the shared folder."""
    base = scratch_dir(pages.sparkSession)
    base = base if "://" in base else f"file://{base}"
    whole = write_archives(pages, f"{base}/whole", least_bytes)
    members = normalise(whole, f"{base}/whole", f"{base}/members")
    return read_records(members, f"{base}/members")
