"""WARC archives (operator 9), index first.

Writing gives an index of offset, length, URL and digest for every record; reading selects index rows, sorts them by
archive and offset, joins near ranges into one read, and parses the records. Of equal payloads only one is stored;
the others are revisit records that name it. Archives are gzip members, one for each record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, shared_dir

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 26
#: Ranges no farther apart than this are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
#: Where there are many records, a task reads about so many bytes.
TASK_BYTES = 1 << 28
#: A table of revisits of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
DATE = "2026-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, digest string, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the payload's length in its HTTP head, but not the payload."""
    ident = lambda p: uuid.UUID(bytes=hashlib.md5(f"{p} {digest}".encode()).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{ident(page)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        head.append(f"Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{ident(refers_to)}>", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of ``RECORD``; a damaged record is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a WARC record of another length")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError("a payload that its digest does not match")
    number = lambda name: int(field[name]) if name in field else None
    return number("Page-ID"), field.get("WARC-Target-URI"), kind, number("Refers-To-Page-ID"), size, digest, payload if kind == "response" else None


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a smaller page_id has.

    Only ids and digests are shuffled; the smallest id of a payload is found by partial aggregation.
    """
    rows = pages.filter(F.col("bytes") >= least_bytes).select("page_id", "digest")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of ``page_id, url, html`` and returns the index, columns ``INDEX``.

    Payload: html in UTF-8, null as empty. Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is the
    response, and rows that repeat that id with that payload are responses too; a null page_id revisits unless no
    id is known. Null URLs are left out of the record. An empty table gives an empty index. Files go to the shared folder
    by default; a task that runs again writes other files, and the index names those of the run that counts.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    again = cut(revisits(rows, least_bytes))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(F.broadcast(again) if few else again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, store, out, n, at = TaskContext.get(), None, None, 0, 0
        for batch in batches:
            made = []
            for page, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                page, url, refers_to = page.as_py(), url.as_py(), refers_to.as_py()
                body = html.as_py().encode("utf-8", "surrogatepass")
                digest = base32_sha1(body)
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    path, at = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page, url, body, digest, refers_to, refers_to is not None)) + squeeze.flush()
                out.write(data)
                made.append((page, url, "response" if refers_to is None else "revisit", digest, path, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out, n = None, n + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()])], names=["page_id", "url", "record_type", "digest", "archive", "offset", "length"])
        if out is not None:
            out.close()

    index = rows.mapInArrow(run, INDEX)
    uri = folder.split("://")[0] + "://" if "://" in folder else ""
    return cut(index).withColumn("archive", F.concat(F.lit(uri), "archive"))


def read_records(index: DataFrame, selected=None) -> DataFrame:
    """The records, columns ``RECORD``, of the index rows for which ``selected`` holds (all without it).

    A revisit has no payload, but its length and digest. Sorted ranges no more than ``GAP_BYTES`` apart are one read of at
    most about ``READ_BYTES``. The payload of a response is checked against its digest. Sections of ``READ_BYTES`` of the
    archives are dealt to as many tasks as the selected records' bytes ask for.
    """
    rows = (index if selected is None else index.filter(selected)).select("archive", "offset", "length")
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + min(total // READ_BYTES, max(4 * index.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES))
    rows = rows.repartition(tasks, "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (x[0] != held[0][0] or x[1] > held[-1][1] + held[-1][2] + GAP_BYTES or x[1] + x[2] - held[0][1] > READ_BYTES):
                    yield held
                    held = []
                held.append(x)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for group in ranges(batches):
            if group[0][0] != path:
                if f:
                    f.close()
                path = group[0][0]
                store, at = fs.FileSystem.from_uri(path)
                f = store.open_input_file(at)
            begin = group[0][1]
            data = f.read_at(group[-1][1] + group[-1][2] - begin, begin)
            rows = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n in group]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])], names=[c.split()[0] for c in RECORD.split(", ")])
        if f:
            f.close()

    return rows.mapInArrow(run, RECORD)
