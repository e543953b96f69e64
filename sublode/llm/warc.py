"""WARC archives: a writer that stores equal payloads once and a sequential reader.

Every record is a gzip member of its own. The reader inflates a stream piece by piece, finds the header's end, frames
the block by its Content-Length, checks the block and payload digests and goes on with the next member, so memory is
bounded by one read buffer and one record. Of the records with equal payloads the one with the largest id is stored
as a response; the others are revisit records that refer to it and keep its HTTP headers.

Defined edge cases: a null payload is empty and equal to every other empty one; a null url becomes an empty target; a
null ``page_id`` is written without an id and never stands as the response of others that have one; rows that repeat
a ``page_id`` and payload give one response and revisits of it; an empty table gives no file and no row; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, read_stream, ship, write_once

#: Compressed bytes after which the writer begins another file.
FILE_BYTES = 32_000_000
MIN_DEDUP_BYTES = 0
_DATE = "2000-01-01T00:00:00Z"
_PRINTABLE = "".join(map(chr, range(33, 127)))


def sha1_b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit has the HTTP headers alone, with the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>",
        f"WARC-Date: {_DATE}", "WARC-Target-URI: " + quote(url, safe=_PRINTABLE, errors="replace"),
        f"WARC-Payload-Digest: sha1:{sha1_b32(payload)}", f"WARC-Block-Digest: sha1:{sha1_b32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class WarcError(ValueError):
    """A record that is cut short, not framed as its header says, or that fails a digest."""


def read_records(stream, chunk: int = 1 << 16):
    """(headers, http headers, payload) of each record of a stream, in order."""
    pending = b""
    while True:
        pending = pending or stream.read(chunk)
        if not pending:
            return
        inflate, data, want, head = zlib.decompressobj(31), bytearray(), None, {}
        while True:
            data += inflate.decompress(pending)
            if want is None and (at := data.find(b"\r\n\r\n")) >= 0:
                first, *rest = bytes(data[:at]).decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise WarcError(f"no WARC version: {first[:40]!r}")
                head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in rest))
                if not head.get("content-length", "").isdigit():
                    raise WarcError("no Content-Length")
                start, want = at + 4, at + 4 + int(head["content-length"])
            if inflate.eof:
                pending = inflate.unused_data
                break
            pending = stream.read(chunk)
            if not pending:
                raise WarcError("the last record is cut short")
        if want is None or len(data) != want + 4 or data[want:] != b"\r\n\r\n":
            raise WarcError("the record's length is not its Content-Length")
        block = bytes(data[start:want])
        if head.get("warc-block-digest", "sha1:" + sha1_b32(block)) != "sha1:" + sha1_b32(block):
            raise WarcError("block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:]))
        if head.get("warc-type") == "response" and head.get("warc-payload-digest", "sha1:" + sha1_b32(payload)) != "sha1:" + sha1_b32(payload):
            raise WarcError("payload digest")
        yield head, fields, payload


def revisits(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """What is to be known of pages whose payload occurs again: _page, _digest of the page, _refers and _one.

    ``_refers`` is the page that has the payload; where several rows have that very page_id, ``_one`` says that one of
    them is the response and the others refer to it.
    """
    keys = materialize(pages.select("page_id", "_digest", "_size"), "payloads").filter(F.col("_size") >= min_bytes)
    times = keys.groupBy("_digest", "page_id").agg(F.count("*").alias("times"))
    best = times.groupBy("_digest").agg(F.max("page_id").alias("_refers"), F.sum("times").alias("n")).filter("n > 1 AND _refers IS NOT NULL").drop("n")
    pairs = times.join(best, "_digest").withColumn("_one", F.col("page_id").eqNullSafe(F.col("_refers"))).filter("NOT _one OR times > 1")
    return pairs.select(F.col("page_id").alias("_page"), F.col("_digest").alias("_of"), "_refers", "_one")


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages, those with _refers as revisits, as archives under ``path``; one row for each file."""

    def run(batches):
        from pyspark import TaskContext

        part, k, held, size, done = TaskContext.get().partitionId(), 0, [], 0, []
        for batch in batches:
            for page_id, url, data, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(make_record(page_id, url or "", data, refers, refers is not None))
                size += len(held[-1])
                if size >= file_bytes:
                    write_once(name := f"{path}/part-{part:06d}-{k:04d}.warc.gz", b"".join(held))
                    done.append(name)
                    held, size, k = [], 0, k + 1
        if held:
            write_once(name := f"{path}/part-{part:06d}-{k:04d}.warc.gz", b"".join(held))
            done.append(name)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.col("url").cast("string"), data.alias("data"), "_refers").mapInArrow(run, "file string")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the archives, each file read from its start to its end."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for head, http, _ in read_records(read_stream(file)):
                    known = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((known("x-page-id"), int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], known("x-refers-to-page-id")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("file").mapInArrow(run, RECORD)


def roundtrip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write all pages as archives, read them back, and return one row per record.

    Which pages are revisits is settled on digests alone; the pages themselves are then joined with the revisits'
    table by page and digest, which Spark broadcasts only where the written table is known to be small.
    """
    spark = pages.sparkSession
    ship(spark)
    path = path or new_path(spark, "warc")
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.sha2(data, 256).alias("_digest"), F.length(data).alias("_size"))
    again = materialize(revisits(rows, min_bytes), "revisits")
    match = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_digest") == F.col("_of"))
    joined = rows.join(again, match, "left")
    if not again.filter("_one").isEmpty():  # rows that repeat the response's page_id are numbered, the first is the response
        first = F.row_number().over(Window.partitionBy("_page", "_digest").orderBy("url")) == 1
        repeated = joined.filter("_one").withColumn("_refers", F.when(~first, F.col("_refers")))
        joined = joined.filter(~F.coalesce("_one", F.lit(False))).unionByName(repeated)
    files = materialize(write_archives(joined, path), "archives")
    return read_archives(files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
