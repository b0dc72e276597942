"""WARC archives with an index of their records.

Writing makes gzip-per-record archives, one or more per task, and an index row for each
record: file, offset, length, URL and digest.  Reading selects index rows, sorts them by
file and offset, joins ranges that lie close together and reads each such range once.

Of records with equal payloads the one with the largest page id is a ``response``; the others
are ``revisit`` records that refer to it and keep the HTTP header block, so the full
payload's length and digest can be read from either.  Payloads under ``revisit_min_bytes``
are always responses.

Archives carry the task attempt's own name and only the index names them, so a rerun task
or a doubled one does no harm.  Defined cases: a null payload is empty; a null id can't be
referred to, and its record is a response; rows that tie for the largest id are all
responses; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import filesystem, save, shared_dir

#: Bytes after which a task begins another archive; gap up to which ranges are read as one; most bytes of such a read.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Packed bytes that a reading task reads on average, as long as ``MOST_TASKS`` are enough, and those of the spans that are dealt out to tasks.
TASK_BYTES, SPAN_BYTES, MOST_TASKS = 4 << 20, 1 << 20, 20_000
_DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, record_type string, payload_digest string, file string, offset long, length long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to=None) -> tuple[bytes, str]:
    """A WARC/1.1 record of an HTTP response, or of a revisit to another page's, and the payload's digest."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": warc, "http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str):
    def run(batches):
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data, digest = record(page_id, url, (payload or "").encode(), refers_to)
                packed = _gzip(data)
                out.write(packed)
                rows.append((page_id, url, "response" if refers_to is None else "revisit", digest, name, at, len(packed)))
                at += len(packed)
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [c.split()[0] for c in _INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_min_bytes: int = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write all rows; the folder of archives and their index, which is written too."""
    folder = folder or shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    # one row a payload that occurs more than once; read back, so Spark sees its size and can split a hot payload
    shared = save(rows.where(F.octet_length("payload") >= revisit_min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("shared_sha"), "last"))
    rows = rows.join(shared, (F.col("sha") == F.col("shared_sha")) & (F.octet_length("payload") >= revisit_min_bytes), "left")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    return folder, save(rows.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(_writer(folder), _INDEX))


def _ranges(rows: list[tuple]):
    """(file, start, end, rows) of reads that join neighbouring records."""
    held: list[tuple] = []
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > GAP_BYTES or row[1] + row[2] - held[0][1] > READ_BYTES):
            yield held[0][0], held[0][1], max(r[1] + r[2] for r in held), held
            held = []
        held.append(row)
    if held:
        yield held[0][0], held[0][1], max(r[1] + r[2] for r in held), held


def _reader(folder: str):
    def run(batches):
        files, root = filesystem(folder)
        source, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for name, start, end, records in _ranges(rows):
                out = []
                if name != opened:
                    if source is not None:
                        source.close()
                    source, opened = files.open_input_file(f"{root}/{name}"), name
                data = source.read_at(end - start, start)
                for _, offset, length in records:
                    got = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    warc, kind = got["warc"], got["warc"]["warc-type"]
                    said = warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and _digest(got["payload"]) != said:
                        raise ValueError(f"{name} at {offset}: the payload doesn't have its digest")
                    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
                    refers = warc.get("warc-refers-to")
                    out.append((number(warc["warc-record-id"]), warc["warc-target-uri"], got["payload"].decode() if kind == "response" else None, int(got["http"]["content-length"]), said, kind, number(refers) if refers else None))
                # a batch holds one read, so that long pages don't add up
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows ``selected``: page_id, url, payload (null in a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    # tasks share out spans of files, so what they get follows the bytes to be read and not the few bytes of the index rows;
    # spans are dealt by their hash, for which nothing is sampled and no bounds go through the driver
    tasks = max(1, min(MOST_TASKS, -(-(selected.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)))
    spans = selected.select("file", "offset", "length").withColumn("span", F.floor(F.col("offset") / SPAN_BYTES))
    ordered = spans.repartition(tasks, "file", "span").drop("span").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(folder), "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")
