"""WARC archives: writing pages with revisit records, and a sequential reader.

Writing: pages with equal payloads (SHA-256 and length) keep one response, that of the
largest page id; the others become revisit records that refer to it.  Each task writes
archives in which every record is a gzip member of its own, and rolls over to a new one at
``archive_bytes``.  A task returns the names of its archives; that manifest is stored once,
so archives of lost or repeated attempts are never read.

Reading: an archive is read front to back in small chunks.  Members are decompressed
incrementally, blocks are framed by Content-Length, digests are computed while bytes pass.
Nothing but the current record is held, and not even its payload unless it is asked for.

Scale: duplicates are found on digests alone; page bodies are not shuffled while the table
of repeated payloads is measured small, and join in salted pieces otherwise.  Archives go to
the shared folder (any store that Arrow's file systems reach).

Defined results for odd input: a NULL body is an empty payload; a NULL url leaves the
target out, control characters in it are percent-encoded; a NULL page id counts as the
smallest and is read back as NULL; repeated rows of the largest page id are all responses;
an empty table gives no records; extra columns are ignored.  Headers and bodies of any
length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import narrowed, small_batches
from soundrows.operators.keyed import DEFAULT_LIMITS, attach, fits_broadcast, most_frequent
from soundrows.session import stored

ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
ID = "urn:soundrows:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def sha1(data: bytes) -> str:
    return base32_sha1(hashlib.sha1(data))


def printable(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", *[f"{k}: {printable(v)}" for k, v in headers], f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines) + "\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or (with the id of its response) a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{page}>")]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return record(headers, block)


class Archives:
    """Writes records to archives of a bounded size and lists them."""

    def __init__(self, folder: str, archive_bytes: int, date: str):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.archive_bytes, self.date = folder, archive_bytes, date
        self.stream = None
        self.written: list[dict] = []

    def add(self, member: bytes) -> None:
        if self.stream is None or self.written[-1]["n_bytes"] >= self.archive_bytes:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.store.create_dir(self.path, recursive=True)
            self.stream = self.store.open_output_stream(f"{self.path}/{name}", compression=None)
            self.written.append({"archive": f"{self.folder}/{name}", "n_records": 0, "n_bytes": 0})
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                    ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
            self.put(record(info, b"format: WARC File Format 1.1\r\n"))
        self.put(member)
        self.written[-1]["n_records"] += 1

    def put(self, member: bytes) -> None:
        self.stream.write(member)
        self.written[-1]["n_bytes"] += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


MANIFEST = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def write_task(batches, folder: str, archive_bytes: int, date: str):
    """Write a task's pages; the rows of the manifest are its finished archives."""
    archives = Archives(folder, archive_bytes, date)
    try:
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, revisits, refers_to = (c[i].as_py() for c in batch.columns)
                payload = (html or "").encode()
                refers_to = (refers_to or "") if revisits else None
                archives.add(page_record(page or "", url, payload, refers_to, date))
    finally:
        archives.close()
    yield pa.RecordBatch.from_pylist(archives.written, MANIFEST)


def with_responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages (page_id, url, html) with ``revisits`` and ``refers_to``."""
    body = F.coalesce("html", F.lit(""))
    key = F.concat_ws(":", F.sha2(body.cast("binary"), 256), F.octet_length(body))
    groups = (
        pages.filter(F.octet_length(body) >= least_bytes)
        .groupBy(key.alias("payload"))
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1")
    )
    groups = stored(groups, "payloads")
    small = fits_broadcast(groups, "payload", DEFAULT_LIMITS)
    hot = None if small else most_frequent(groups, "payload", DEFAULT_LIMITS)
    joined = attach(
        pages.withColumn("payload", key), "payload", groups, [F.col("page_id"), F.col("url")], hot, small
    )
    revisits = F.col("_rows").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", revisits.alias("revisits"), F.col("last").alias("refers_to"))


def write(
    pages: DataFrame,
    folder: str,
    least_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = UNKNOWN_DATE,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Write all pages as archives under ``folder`` (a URI); returns the stored manifest."""
    small_batches(pages.sparkSession)
    linked = with_responses(narrowed(pages, page_id=page_id, url=url, html=html), least_revisit_bytes)
    texts = linked.select(
        F.col("page_id").cast("string"), "url", "html", "revisits", F.col("refers_to").cast("string")
    )
    manifest = texts.mapInArrow(
        lambda b: write_task(b, folder, archive_bytes, date), "archive string, n_records long, n_bytes long"
    )
    return stored(manifest, "manifest")


class Broken(ValueError):
    """An archive that cannot be read on."""


class Member:
    """One gzip member, decompressed as far as it is read."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest = stream, rest
        self.inflate = zlib.decompressobj(31)
        self.ready = b""

    def more(self) -> bool:
        """Decompress another chunk; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.stream.read(CHUNK)
        if not self.inflate.unconsumed_tail:
            self.rest = b""
        if not data:
            raise Broken("truncated member")
        try:
            self.ready += self.inflate.decompress(data, CHUNK)
        except zlib.error as error:
            raise Broken(f"bad member: {error}") from None
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        """Everything up to and with the mark, however long (a header holds a whole URL)."""
        searched = 0
        while (place := self.ready.find(mark, searched)) < 0:
            searched = max(0, len(self.ready) - len(mark))
            if not self.more():
                raise Broken("no end of the header")
        out, self.ready = self.ready[: place + len(mark)], self.ready[place + len(mark) :]
        return out

    def exactly(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in chunks."""
        while size:
            if not self.ready and not self.more():
                raise Broken("block shorter than its Content-Length")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            if part:
                yield part

    def finish(self) -> bytes:
        """Check the end of the record; returns the bytes of the next member."""
        if b"".join(self.exactly(4)) != b"\r\n\r\n":
            raise Broken("no end of the record")
        while not self.ready and self.more():
            pass
        if self.ready:
            raise Broken("block longer than its Content-Length")
        return self.rest


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_record(member: Member, with_payload: bool) -> dict:
    """The record of a member, with its digests computed while it is read."""
    head = fields(member.until(b"\r\n\r\n"))
    if not head[""].startswith("WARC/") or not head.get("content-length", "").isdigit():
        raise Broken("not a WARC record")
    block, payload = hashlib.sha1(), hashlib.sha1()
    http, size, kept = None, 0, []
    pending = b""
    is_http = head.get("content-type", "").startswith("application/http")
    for part in member.exactly(int(head["content-length"])):
        block.update(part)
        if is_http and http is None:
            pending += part
            if b"\r\n\r\n" not in pending:
                continue
            raw, _, part = pending.partition(b"\r\n\r\n")
            http = fields(raw)
        payload.update(part)
        size += len(part)
        if with_payload:
            kept.append(part)
    kind = head.get("warc-type")
    own = f"sha1:{base32_sha1(payload)}"
    stated = (http or {}).get("content-length", "")
    whole = kind != "revisit"
    problem = None
    if head.get("warc-block-digest", f"sha1:{base32_sha1(block)}") != f"sha1:{base32_sha1(block)}":
        problem = "block digest differs"
    elif whole and head.get("warc-payload-digest", own) != own:
        problem = "payload digest differs"
    elif whole and stated.isdigit() and int(stated) != size:
        problem = "payload length differs"
    strip = lambda v: v[1:-1] if v and v[0] == "<" else v
    return {
        "record_type": kind,
        "record_id": strip(head.get("warc-record-id")),
        "target_uri": head.get("warc-target-uri"),
        "refers_to": strip(head.get("warc-refers-to")),
        "payload_bytes": int(stated) if stated.isdigit() else size,
        "payload_digest": (own if whole else head.get("warc-payload-digest", own)).removeprefix("sha1:"),
        "problem": problem,
        "payload": b"".join(kept) if with_payload and whole else None,
    }


def read_archive(stream, with_payload: bool = False) -> Iterator[dict]:
    """All records of an archive, front to back.

    Damage to a record is told in ``problem``; when the framing is lost a last row
    without a type tells why, and reading ends.
    """
    rest = stream.read(CHUNK)
    while rest:
        member = Member(stream, rest)
        try:
            found = read_record(member, with_payload)
            rest = member.finish() or stream.read(CHUNK)
        except Broken as error:
            yield {"problem": str(error)}
            return
        yield found


RECORDS = pa.schema(
    [("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
     ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("problem", pa.string()), ("payload", pa.binary())]
)
ROWS_AT_ONCE, BYTES_AT_ONCE = 500, 8 << 20


def read_task(batches, with_payload: bool):
    """The records of a task's archives."""
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            store, path = fs.FileSystem.from_uri(archive)
            rows, size = [], 0
            with store.open_input_stream(path, compression=None) as stream:
                for row in read_archive(stream, with_payload):
                    rows.append(row | {"archive": archive})
                    size += len(row.get("payload") or b"")
                    if len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, RECORDS)


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of all archives (a frame with a column ``archive`` of URIs), one task each."""
    n = max(1, archives.count())
    return (
        archives.select("archive")
        .repartition(n)
        .mapInArrow(
            lambda b: read_task(b, with_payload),
            "archive string, record_type string, record_id string, target_uri string, refers_to string, "
            "payload_bytes long, payload_digest string, problem string, payload binary",
        )
    )


def shared_folder(frame: DataFrame, name: str) -> str:
    """A fresh folder beside a stored frame, as a URI with the store's own scheme."""
    return f"{frame.inputFiles()[0].rsplit('/', 2)[0]}/soundrows-{name}-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, least_revisit_bytes: int = 0, page_id: str = "page_id", **columns) -> DataFrame:
    """Write the pages, read the archives back: what each record says about its page."""
    spark = pages.sparkSession
    anchor = stored(spark.range(1), "anchor")
    manifest = write(pages, shared_folder(anchor, "warc"), least_revisit_bytes, page_id=page_id, **columns)
    kind = pages.schema[page_id].dataType
    number = lambda c: F.nullif(F.substring_index(c, ID, -1), F.lit("")).cast(kind)
    records = read(manifest).filter("record_type is null or record_type != 'warcinfo'")
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(
        F.raise_error(F.concat_ws(": ", "archive", "problem"))
    )
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        sound.alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
