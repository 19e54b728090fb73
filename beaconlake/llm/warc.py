"""WARC archives: writing pages as records, reading them back, and assembling transactions.

A page becomes a request, a response (or, where an equal payload is kept elsewhere, a revisit) and a
metadata record; request and metadata name the response in WARC-Concurrent-To. Each record is a gzip
member of its own, as crawlers write them. Reading parses the members of a file one by one. A
transaction joins the three kinds through the concurrent-to identifiers (a metadata record may also
name the request) and gives one nested row per capture; a revisit then takes length and digest from
the response that it refers to.

Of records with equal payloads the one with the largest page_id is the response. Payloads are told
apart by SHA-256 and length; groups of any size are summed map-side.

Defined cases: a null payload is an empty one; a null page_id comes before all others in that order and
comes back as null; rows of equal page_id and payload are each a capture, and the last by locator of
the largest page_id is the response; a null url is written as ``about:blank``; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import discard, located, make_dir, materialize, of, open_shared, remove, scratch, ship

#: A file is closed after so many bytes.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20


def record_id(kind: str, row: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{kind}:{row}'.encode(), digest_size=16).digest())}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in value)


def capture(row: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The three records of a page; refers_to names the row that keeps an equal payload."""
    url = _one_line(url or "about:blank")
    main = record_id("response", row)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = ("Content-Type", "application/http; msgtype=response")
    own = [("WARC-Record-ID", main), *about, ("WARC-Payload-Digest", f"sha1:{digest}"), http]
    if refers_to is None:
        first = record([("WARC-Type", "response"), *own], head + payload)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        of = [("WARC-Profile", profile), ("WARC-Refers-To", record_id("response", refers_to)), ("WARC-Truncated", "length")]
        first = record([("WARC-Type", "revisit"), *own, *of], head)
    request = record(
        [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", row)), *about, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")],
        b"GET / HTTP/1.1\r\nUser-Agent: archiver\r\n\r\n",
    )
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    metadata = record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", row)), *about, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")],
        fields,
    )
    return first + request + metadata


def named(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, payload and row (the page's name)."""
    return located(pages).select(
        of(page_id).cast("long").alias("page_id"), of(url).cast("string").alias("url"),
        F.coalesce(of(payload).cast("binary"), F.lit(b"")).alias("payload"),
        F.concat_ws("-", F.hex("loc.file"), "loc.row").alias("row"),
    )


def write(pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Writes the archives; returns one row a file: path, n_records, n_bytes.

    Files have names of their own, and only those in the manifest count: what a lost or repeated task
    leaves behind is never read.
    """
    spark = pages.sparkSession
    ship(spark)
    make_dir(spark, folder)
    rows = named(pages, payload, page_id, url)
    # Payloads are read twice: once for their digests, once to be written.
    rank = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "row")
    digests = materialize(rows.select(F.sha2("payload", 256).alias("sha256"), rank.alias("rank")), "payload-digests")
    keepers = digests.groupBy("sha256").agg(F.max("rank").alias("keeper"), F.count("*").alias("n"))
    keepers = materialize(keepers.filter("n > 1").select(F.col("sha256").alias("same"), F.col("keeper.row").alias("keeper")), "payload-keepers")
    # Only payloads that occur twice are in the table, so the join moves names, not payloads, where it can.
    names = digests.join(keepers, F.col("sha256") == F.col("same")).filter("rank.row <> keeper")
    names = materialize(names.select(F.col("rank.row").alias("revisit"), "keeper"), "revisits")
    told = rows.join(names, F.col("row") == F.col("revisit"), "left").select("row", "page_id", "url", "payload", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, n, size = None, "", 0, 0
        made: list[tuple[str, int, int]] = []
        for batch in batches:
            for row, pid, at, body, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None:
                    path, n, size = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = open_shared(path, "wb")
                raw = capture(row, pid, at, body, base32_sha1(body), keeper)
                file.write(raw)
                n, size = n + 3, size + len(raw)
                if size >= FILE_BYTES:
                    file.close()
                    file = None
                    made.append((path, n, size))
        if file is not None:
            file.close()
            made.append((path, n, size))
        if made:
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["path", "n_records", "n_bytes"])

    manifest = materialize(told.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")
    discard(digests, keepers, names)
    return manifest


def members(file: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a file, unpacked, one at a time."""
    rest = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = rest or file.read(READ)
            rest = b""
            if not chunk:
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(unpack.decompress(chunk))
        rest = unpack.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


_RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, content_type string, "
    "declared_digest string, size long, sha1 string, page_id long"
)


def records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives; size and sha1 are those of the payload as read, or null for revisits."""
    schema = _RECORD + ", payload binary" * with_payload
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        held: list[dict] = []
        weight = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_shared(path, "rb") as file:
                    for raw in members(file):
                        head, block = parse(raw)
                        kind, body = head["warc-type"], block
                        if "application/http" in head.get("content-type", ""):
                            body = block.partition(b"\r\n\r\n")[2]
                        page = None
                        if kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                            page = int(fields["page-id"]) if fields.get("page-id") else None
                        stored = kind != "revisit"
                        own = dict.fromkeys(names) | {
                            "record_id": head["warc-record-id"], "type": kind, "concurrent_to": head.get("warc-concurrent-to"),
                            "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
                            "content_type": head.get("content-type"), "declared_digest": head.get("warc-payload-digest"),
                            "size": len(body) if stored else None, "sha1": base32_sha1(body) if kind == "response" else None, "page_id": page,
                        }
                        if with_payload:
                            own["payload"] = body if stored else None
                            weight += len(body)
                        held.append(own)
                        if len(held) >= 5000 or weight > READ << 3:
                            yield pa.RecordBatch.from_pylist(held, types)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, types)

    return manifest.select("path").repartitionByRange(files, "path").mapInArrow(run, schema)


def transactions(read: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, uri, request, response, metadata.

    read is joined with itself several times, so it should be a written table.
    """
    body = [c for c in read.columns if c not in ("concurrent_to", "refers_to")]
    nested = lambda kinds, name: read.filter(F.col("type").isin(*kinds)).select(
        F.col("record_id").alias(f"{name}_id"), F.col("concurrent_to").alias(f"{name}_to"), F.col("refers_to").alias(f"{name}_refers"),
        F.struct(*body).alias(name),
    )
    response, request, metadata = nested(["response", "revisit"], "response"), nested(["request"], "request"), nested(["metadata"], "metadata")
    by_request = request.select(F.col("request_id").alias("via"), F.col("request_to").alias("via_to"))
    metadata = metadata.join(by_request, F.col("metadata_to") == F.col("via"), "left").select(
        "metadata", F.coalesce("via_to", "metadata_to").alias("metadata_of")
    )
    out = response.join(request, F.col("response_id") == F.col("request_to"), "left").join(
        metadata, F.col("response_id") == F.col("metadata_of"), "left"
    )
    return out.select(
        F.col("response_id").alias("record_id"), F.col("response.uri").alias("uri"), F.col("response_refers").alias("refers_to"),
        "request", "response", "metadata",
    )


def resolved(captures: DataFrame) -> DataFrame:
    """One row per capture: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), url."""
    kept = captures.filter("response.type = 'response'").select(
        F.col("record_id").alias("kept_id"), F.col("response.size").alias("kept_size"), F.col("response.sha1").alias("kept_sha1"),
        F.col("metadata.page_id").alias("kept_page"),
    )
    told = captures.join(kept, F.col("refers_to") == F.col("kept_id"), "left")
    return told.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.size", "kept_size").alias("payload_bytes"),
        F.coalesce("response.sha1", "kept_sha1").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("kept_page").alias("refers_to"),
        F.col("uri").alias("url"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them, assembles transactions and resolves revisits."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write(pages, folder)
    read = materialize(records(manifest, with_payload=False), "records")
    out = materialize(transactions(read), "transactions")
    discard(manifest, read)
    remove(pages.sparkSession, folder)
    return resolved(out)


SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT body, max(page_id) AS keeper FROM p GROUP BY body),
h AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS hex, keeper FROM p JOIN k USING (body)),
b AS (SELECT *, list_aggregate(list_transform(range(0, 160, 5), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (list_sum(list_transform(range(0, 5), lambda j:
             ((strpos('0123456789abcdef', substr(hex, ((i + j) // 4 + 1)::INT, 1)) - 1)::INT >> (3 - (i + j) % 4)::INT & 1) * (16 >> j::INT))))::INT + 1, 1)), 'string_agg', '') AS digest FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, coalesce(url, 'about:blank') AS url
FROM b
"""
