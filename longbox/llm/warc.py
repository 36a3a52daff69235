"""Fetched catalogue pages as WARC archives, written and read back.

A record is one gzip member, so that an archive can be entered at any record.
Pages of equal content are stored once; the others are revisit records.
Archives are read from front to back in small pieces: each member is inflated
as it comes, its block cut out by its content length, and its digests checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.storage import one_task_each, open_input, open_output, stored, task_name
from longbox.sources.tables import shared_folder

# Shorter payloads are always stored; a revisit record would save little.
LEAST_REVISITED = 1000
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id BIGINT, url STRING, record_type STRING, payload_bytes BIGINT, payload_digest STRING, refers_to BIGINT, payload BINARY"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters and % as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unfield(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(page: dict, captured: str) -> bytes:
    """One record, compressed as a gzip member of its own.

    ``page``: page_id, url, payload (null for a revisit), its length n and digest
    (SHA-1, hex), refers_to.
    """
    revisit = page["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['n']}\r\n\r\n"
    block = http.encode() + (page["payload"] or b"")
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page['page_id']}>",
        "WARC-Date": captured,
        "WARC-Target-URI": None if page["url"] is None else _field(page["url"]),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<urn:page:{page['refers_to']}>" if revisit else None,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(page["digest"])).decode(),
        "WARC-Block-Digest": _sha1(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


class Reader:
    """Records of an archive, from ``read(n)``; holds one record at a time."""

    def __init__(self, read: Callable[[int], bytes]):
        self.source, self.packed, self.plain = read, b"", bytearray()

    def _more(self) -> bool:
        """Inflate a further piece of the member at hand; False at its end."""
        if self.inflate.eof:
            return False
        if not self.packed:
            self.packed = self.source(PIECE)
            if not self.packed:
                raise EOFError("the archive ends inside a record")
        self.plain += self.inflate.decompress(self.packed, PIECE)
        self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def _take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise EOFError("a record is shorter than its length says")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def _head(self) -> dict[str, str]:
        start = 0
        while (end := self.plain.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(self.plain) - 3)
            if not self._more():
                raise EOFError("a record without end of header")
        version, *lines = self._take(end + 4)[:-4].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]}")
        return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(header fields in lower case, block) of each record."""
        while self.packed or (piece := self.source(PIECE)):
            self.packed = self.packed or piece
            self.inflate, self.plain = zlib.decompressobj(31), bytearray()
            fields = self._head()
            block = self._take(int(fields["content-length"]))
            end = self._take(4)
            while self._more():
                pass
            if end != b"\r\n\r\n" or self.plain:
                raise ValueError("a record does not end where its length says")
            if _sha1(block) != fields["warc-block-digest"]:
                raise ValueError(f"block digest of {fields['warc-record-id']} differs")
            yield fields, block


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "None") else None


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """A row of ``RECORDS`` from one record; a stored payload must have its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and _sha1(payload) != fields["warc-payload-digest"]:
        raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": None if url is None else _unfield(url),
        "record_type": fields["warc-type"],
        "payload_bytes": int(re.search(rb"(?i)content-length: *(\d+)", http)[1]),
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, captured: str) -> DataFrame:
    """(path, records) of the archives that hold ``pages``: page_id, url, html.

    ``captured`` is the date of all records (2024-01-31T00:00:00Z). Payloads are
    the html in UTF-8, null as empty. Of pages with equal payloads of at least
    1000 bytes, the one with the largest page_id is stored and the others refer
    to it; rows that share that id are all stored. Pages without an id refer to
    others but are never referred to. No pages give no archives. Other columns
    are ignored. Archives lie in the shared folder and are full at 64 MB.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("payload")).withColumn("digest", F.sha1("payload"))
    kept = (
        rows.filter(F.octet_length("payload") >= LEAST_REVISITED)
        .groupBy("digest")
        .agg(F.max("page_id").alias("stored"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    other = F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    marked = rows.join(kept, "digest", "left").select(
        "page_id", "url", "digest", F.when(other.isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("n"), other.alias("refers_to")
    )
    folder = shared_folder(pages.sparkSession, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, count, written = None, 0, 0, 0
        for batch in batches:
            for page in batch.to_pylist():
                if out is None:
                    name = task_name(f"{written}.warc.gz")
                    out, size, count = open_output(folder, name), 0, 0
                packed = record(page, captured)
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})
                    out, written = None, written + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})

    return stored(marked.mapInArrow(write, "path STRING, records BIGINT"), "archive-list")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_input(path) as archive:
                rows, size = [], 0
                for fields, block in Reader(archive.read):
                    rows.append(page_of(fields, block))
                    size += len(block)
                    if size >= PIECE * 64:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """``RECORDS`` of ``archives`` (path): all records, one task per archive.

    ``payload_bytes`` and ``payload_digest`` (hex) are those of the full
    payload, for revisit records too, whose ``payload`` is null. A damaged
    archive or a wrong digest is an error.
    """
    return one_task_each(archives.select("path")).mapInArrow(_read, RECORDS)
