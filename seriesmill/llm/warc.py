"""WARC archives: a writer with revisit records, and a sequential reader.

Every record is one gzip member. The reader streams a file through incremental zlib decompression, member by member,
never holding more than a chunk of compressed bytes and one record's block; it frames blocks by Content-Length and
verifies block and payload digests.

Of records whose payloads are equal and at least `least_bytes` long, that with the largest page_id holds the payload
(response); the others are revisit records that name it. Defined results: a null html is an empty payload; a null
page_id is below every other id and is written as `null`; rows that repeat the largest page_id of an equal payload all
hold it; with ids all null, each holds it; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ShardFile, materialise, new_path, open_fs, small_batches

CHUNK = 1 << 16
LEAST_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


@dataclass
class Record:
    """One record as read: named fields, block, and for HTTP responses the payload."""

    fields: dict[str, str]
    block: bytes
    offset: int
    http: dict[str, str] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return self.fields.get("WARC-Type", "")

    @property
    def payload(self) -> bytes:
        if self.fields.get("Content-Type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


class WarcError(ValueError):
    """A record that breaks the format, with the offset of its member."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def page_urn(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def urn_page(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return None if text == "null" else int(text)


def encode(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as one gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    url = "".join(c for c in url or "" if c > " ") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, decompressed pieces) of every gzip member; pieces are to be used up before the next member."""
    held, at = b"", 0
    while True:
        if not held:
            held = stream.read(CHUNK)
            if not held:
                return
        start = at
        z = zlib.decompressobj(31)

        def pieces():
            nonlocal held, at
            while not z.eof:
                if not held:
                    held = stream.read(CHUNK)
                    if not held:
                        raise WarcError(f"archive ends inside the member at {start}")
                try:
                    out = z.decompress(held, CHUNK)
                except zlib.error as e:
                    raise WarcError(f"member at {start}: {e}") from e
                rest = z.unused_data if z.eof else z.unconsumed_tail
                at += len(held) - len(rest)
                held = rest
                if out:
                    yield out

        yield start, pieces()


def read_records(stream, verify: bool = True) -> Iterator[Record]:
    """Records of one archive in order; a broken frame or digest raises WarcError."""
    for offset, pieces in members(stream):
        data = bytearray()
        end = -1
        for piece in pieces:
            seen = max(0, len(data) - 3)
            data += piece
            end = data.find(b"\r\n\r\n", seen)
            if end >= 0:
                break
        if end < 0 or not data.startswith(b"WARC/1."):
            raise WarcError(f"no record header in the member at {offset}")
        fields: dict[str, str] = {}
        for line in bytes(data[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name] = value.strip()
        length = int(fields.get("Content-Length", -1))
        block = data[end + 4 :]
        for piece in pieces:
            block += piece
        if length < 0 or len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise WarcError(f"block of the member at {offset} is not framed by its Content-Length")
        record = Record(fields, bytes(block[:length]), offset)
        if fields.get("Content-Type", "").startswith("application/http"):
            for line in record.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                record.http[name] = value.strip()
        if verify:
            if "WARC-Block-Digest" in fields and _digest(record.block) != fields["WARC-Block-Digest"]:
                raise WarcError(f"block digest of the member at {offset} does not hold")
            if record.kind == "response" and "WARC-Payload-Digest" in fields and _digest(record.payload) != fields["WARC-Payload-Digest"]:
                raise WarcError(f"payload digest of the member at {offset} does not hold")
        yield record


# --- Spark -------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): equal long payloads refer to the row with the largest page_id.

    Digests travel without payloads: first a maximum by digest (aggregated before the shuffle), then the few rows that
    revisit another, which join the pages by page_id and digest; so a payload shared by many pages has no hot key.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    sums = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("digest"))
    best = sums.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null").select("digest", "best")
    again = sums.join(best, "digest").where("page_id is null or page_id < best")
    again = again.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "best").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.sha1("payload") == F.col("_d"))
    return rows.join(again, same, "left").select("page_id", "url", "payload", F.col("_d").isNotNull().alias("revisit"), F.col("best").alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> manifest (path, records, bytes) of the archives written below folder.

    A task writes archives of up to about archive_bytes. Archives get their final name when complete and the manifest
    names those of successful tasks only, so repeated attempts add nothing.
    """
    small_batches(pages.sparkSession)

    def work(batches):
        out, n, done = None, 0, []

        def close():
            done.append({"records": n, "bytes": out.size, "path": out.commit()})

        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "revisit", "refers_to"))):
                page_id, url, payload, revisit, refers_to = (x.as_py() for x in row)
                if out is None:
                    out, n = ShardFile(folder, ".warc.gz"), 0
                out.write(encode(page_id, url, payload, refers_to, revisit))
                n += 1
                if out.size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialise(plan_records(pages, least_bytes).mapInArrow(work, "path string, records long, bytes long"), "archives")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def read(manifest: DataFrame) -> DataFrame:
    """Stream the archives that a manifest names: one row a record, digests verified."""
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])

    def row(r: Record, path: str) -> dict:
        f = r.fields
        return {"page_id": urn_page(f["WARC-Record-ID"]), "url": f.get("WARC-Target-URI"), "payload_bytes": int(r.http.get("Content-Length", len(r.payload))), "payload_digest": _hex(f["WARC-Payload-Digest"]), "record_type": r.kind, "refers_to": urn_page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None, "archive": path.rsplit("/", 1)[-1], "offset": r.offset}

    def work(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, local = open_fs(path)
                with fs.open_input_stream(local, compression=None) as stream:
                    rows = []
                    for r in read_records(stream):
                        rows.append(row(r, path))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=types)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(work, READ)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write archives of the pages and read them back."""
    pages = pages.withColumn("page_id", F.col("page_id").cast("long"))
    return read(write(pages, folder or new_path(pages.sparkSession, "warc"), least_bytes))
