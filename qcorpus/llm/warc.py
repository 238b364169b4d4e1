"""WARC archives: a writer with revisit records and a splittable reader.

The writer puts every record into a gzip member of its own, one file per task,
in a shared folder.  The reader cuts each file into byte ranges.  The task of a
range scans it for the gzip magic; a candidate counts as a member if the bytes
behind it inflate to the start of a WARC header.  From there on members follow
one another, and a record belongs to the range in which its member starts, so
every record is read exactly once whatever the ranges are.

Files are opened through ``pyarrow.fs`` by URI, on the executors; a task keeps
one record in memory.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder, stored

MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 16
MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def open_store(uri: str):
    """(file system, path) of a URI, a path, or Hadoop's form file:/path."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The records of ``pages``: page_id, url, payload (the html, null as
    empty), payload_bytes, payload_digest (SHA-256 in hex), record_type and
    refers_to.

    Of pages with equal payloads of at least ``min_bytes`` bytes those with the
    smallest page_id are responses and the others revisit it (rows that repeat
    that page_id are all responses; null ids come last).  Shorter payloads are
    always responses.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    repeated = stored(base.where(F.col("payload_bytes") >= min_bytes).groupBy(digest.alias("payload_digest"))
                      .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select("payload_digest", "first_id"), "digests")
    first = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    return (base.withColumn("payload_digest", digest).join(repeated, "payload_digest", "left")
            .select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                    F.when(first, "response").otherwise("revisit").alias("record_type"),
                    F.when(~first, F.col("first_id")).alias("refers_to")))


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block + b"\r\n\r\n") + deflate.flush()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def write_warc(rows: DataFrame, path: str) -> DataFrame:
    """Write ``rows`` (see ``records``) as WARC files below ``path``; returns
    the written manifest (path, bytes, n_records).  A file has a name of its
    own for every attempt of a task, and only files of finished attempts
    are in the manifest."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def written(batches):
        store, place = open_store(path)
        store.create_dir(place, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        with store.open_output_stream(f"{place}/{name}", compression=None) as out:
            def put(data: bytes) -> None:
                nonlocal size
                out.write(data)
                size += len(data)
            put(_member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Filename", name),
                         ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n"))
            for batch in batches:
                payloads = batch.column("payload")
                for k, row in enumerate(batch.select(["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                                      "refers_to"]).to_pylist()):
                    headers = [("WARC-Type", row["record_type"]), ("WARC-Date", date),
                               ("WARC-Record-ID", _record_id(row["page_id"], row["payload_digest"])),
                               ("Content-Type", "application/http; msgtype=response"),
                               ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
                               ("X-Payload-Length", str(row["payload_bytes"]))]
                    if row["url"] is not None:
                        headers.append(("WARC-Target-URI", _clean(row["url"])))
                    if row["page_id"] is not None:
                        headers.append(("X-Page-Id", str(row["page_id"])))
                    block = _HTTP
                    if row["record_type"] == "revisit":
                        headers += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(row["refers_to"])),
                                    ("WARC-Refers-To", _record_id(row["refers_to"], row["payload_digest"]))]
                    else:
                        block = _HTTP + payloads[k].as_buffer().to_pybytes()
                    put(_member(headers, block))
                    count += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "bytes": [size], "n_records": [count]})
    return stored(rows.mapInArrow(written, "path string, bytes long, n_records long"), "manifest")


class _File:
    """Random reads of one archive file."""

    def __init__(self, uri: str):
        store, place = open_store(uri)
        self.file = store.open_input_file(place)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(self.size - at, 0)))

    def close(self) -> None:
        self.file.close()


def _is_member(data: bytes) -> bool:
    """Do these bytes begin a gzip member that holds a WARC record?"""
    try:
        return data[:3] == MAGIC and zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(file: _File, start: int, end: int):
    """The inflated members that start in [start, end)."""
    at, window, base = start, b"", start  # window holds the bytes from base on
    while at < end:
        if at + 3 > base + len(window):
            window, base = file.read(at, READ_BYTES), at
        k = window.find(MAGIC, at - base)
        if k < 0:
            if base + len(window) >= file.size:
                return
            at = base + len(window) - 2  # the magic may be cut in two here
            window = b""
            continue
        at = base + k
        if at >= end:
            return
        if not _is_member(window[k:k + 4096] if k + 4096 <= len(window) else file.read(at, 4096)):
            at += 1
            continue
        inflate, pieces, data, next_at = zlib.decompressobj(31), [], window[k:], base + len(window)
        while True:
            pieces.append(inflate.decompress(data))
            if inflate.eof:
                break
            window, base = file.read(next_at, READ_BYTES), next_at
            data, next_at = window, next_at + len(window)
            if not data:
                raise ValueError(f"archive ends inside the member at byte {at}")
        at = next_at - len(inflate.unused_data)
        yield b"".join(pieces)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of an inflated member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[:int(headers.get("content-length", 0))]


def _number(value: str | None) -> int | None:
    return int(value) if value is not None else None


def read_warc(spark: SparkSession, manifest: DataFrame, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records of the files of ``manifest`` (path,
    bytes): page_id, url, record_type, payload_bytes, payload_digest, refers_to
    and, if asked for, payload (null for revisits).

    The digest of every response is computed anew and must equal its header.
    Other record types are passed over.  An empty manifest gives an empty
    result.  A member that is cut off raises.
    """
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(
        F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    n = ranges.count()
    fields = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    names = [f.split()[0] for f in fields.split(", ")]
    schema = fields + (", payload string" if payload else "")

    def read(batches):
        rows: dict[str, list] = {}
        held = 0

        def batch_of():
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()})
        for batch in batches:
            for place in batch.to_pylist():
                file = _File(place["path"])
                rows, held = {c: [] for c in names + ["payload"] * payload}, 0
                for data in members(file, place["start"], min(place["start"] + split_bytes, place["bytes"])):
                    headers, block = parse_record(data)
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:").lower()
                    body, size = None, _number(headers.get("x-payload-length"))
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        own = hashlib.sha256(body).hexdigest()
                        if digest and own != digest:
                            raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
                        digest, size = own, len(body)
                    for c, v in zip(names, (_number(headers.get("x-page-id")), headers.get("warc-target-uri"), kind, size,
                                            digest, _number(headers.get("x-refers-to-page-id")))):
                        rows[c].append(v)
                    if payload:
                        rows["payload"].append(body.decode("utf-8", "replace") if body is not None else None)
                        held += len(body or b"")
                    if held > SPLIT_BYTES or len(rows["page_id"]) >= 5000:
                        yield batch_of()
                        rows, held = {c: [] for c in rows}, 0
                file.close()
                if rows["page_id"]:
                    yield batch_of()
    return ranges.repartition(max(1, min(n, 20_000))).mapInArrow(read, schema)


def archive(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write ``pages`` as WARC files in the shared folder and read them back
    (see ``records`` and ``read_warc``)."""
    spark = pages.sparkSession
    manifest = write_warc(records(pages), folder(spark, "warc"))
    return read_warc(spark, manifest, payload)
