"""WARC archives: a writer with one gzip member per record, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import materialize, new_folder
from meterlake.llm.words import whole_numbers

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of an archive that one reading task scans, and bytes fetched at once beyond them.
SPLIT_BYTES, FETCH_BYTES = 8 << 20, 1 << 20

MANIFEST = "path string, length long, records long"
RECORDS = "path string, offset long, record_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file that Spark knows by uri; its name for S3 is s3a."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member. A revisit has the payload's digest and length, but not the payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = HTTP if revisit else HTTP + payload
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_id(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def decode_record(raw: bytes) -> dict:
    """A record's fields from its decompressed bytes. A response's digest and length are taken from its payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    return {
        "record_type": fields["WARC-Type"],
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "target_uri": fields.get("WARC-Target-URI"),
        "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload": payload,
    }


def deduplicated(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html and keeper: the largest page_id with an equal payload of at least min_revisit_bytes, null where there is no other.

    Only digests that occur twice are joined back. A payload that a third of all rows share is one
    row after partial aggregation; on the other side of the join adaptive execution splits it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = (
        rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    )
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "keeper")


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes one archive per task into folder, and returns the manifest: path, length, records.

    A row becomes a revisit if another row with an equal payload has a larger page_id, else a
    response; null html is an empty payload, rows that repeat a page_id agree. Every attempt of a
    task writes an archive of its own and the manifest names that of the attempt that counted, so a
    lost executor or a speculative copy leaves at most a file that nobody reads. Only page_id, url
    and html are read. An empty table gives no archives or empty ones.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        part = f"{path}.tmp"
        length = records = 0
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in zip(batch.page_id, batch.url, batch.html, batch.keeper):
                    page_id, keeper = (None if pd.isna(x) else int(x) for x in (row[0], row[3]))
                    revisit = keeper is not None and page_id != keeper
                    member = encode_record(page_id, row[1] if isinstance(row[1], str) else None, row[2].encode(), keeper, revisit)
                    out.write(member)
                    length += len(member)
                    records += 1
        store.move(part, path)
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        host = folder.split("://")[1].split("/")[0] if scheme else ""
        yield pd.DataFrame({"path": [f"{scheme}{host}{path}"], "length": [length], "records": [records]})

    rows = deduplicated(pages, min_revisit_bytes).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("keeper").cast("string").alias("keeper"))
    return materialize(rows.mapInPandas(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file from an offset on, fetched as they are asked for."""

    def __init__(self, file, at: int, first: int):
        self.file, self.at, self.data, self.ended = file, at, b"", False
        self.grow(first)

    def grow(self, n: int = FETCH_BYTES) -> bool:
        self.file.seek(self.at + len(self.data))
        more = self.file.read(n)
        self.data += more
        self.ended = len(more) < n
        return bool(more)


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The decompressed member that starts at window.data[start], and its end; None if that is no record."""
    unpacker = zlib.decompressobj(31)
    parts: list[bytes] = []
    at, valid = start, False
    try:
        while not unpacker.eof:
            if at >= len(window.data) and not window.grow():
                return None
            # short first pieces: most candidates inside compressed data fail within them
            piece = window.data[at : at + (FETCH_BYTES if valid else 1024)]
            parts.append(unpacker.decompress(piece))
            at += len(piece)
            if not valid:
                head = b"".join(parts)
                if not head.startswith(b"WARC/1."[: len(head)]):
                    return None
                valid = b"\r\n\r\n" in head
    except zlib.error:
        return None
    raw = b"".join(parts)
    return (raw, at - len(unpacker.unused_data)) if valid else None


def scan_range(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decompressed record) of every record that starts in [start, stop) of an open archive."""
    window = _Window(file, start, stop - start + len(MAGIC) - 1)
    at = window.data.find(MAGIC)
    while 0 <= at < stop - start:
        found = _member(window, at)
        if found:
            yield start + at, found[0]
        at = window.data.find(MAGIC, found[1] if found else at + 1)


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Records as columns; ids stay whole numbers of 64 bits where some of them are null."""
    return pd.DataFrame({c: whole_numbers(r[c] for r in rows) if c in ("page_id", "refers_to") else [r[c] for r in rows] for c in rows[0]})


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives listed in files (path, length); see RECORDS for the columns.

    Each archive is cut into byte ranges and each range is a task: it looks for gzip magic, accepts a
    candidate only if it decompresses to a WARC record, and owns the records that start inside its
    range, reading on past its end for the last one. List a folder with
    spark.read.format("binaryFile").load(folder).select("path", "length").
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, stop in zip(batch.path, batch.start, batch.stop):
                store, local = _store(path)
                with store.open_input_file(local) as file:
                    rows, held = [], 0
                    for offset, raw in scan_range(file, int(start), int(stop)):
                        rows.append({"path": path, "offset": offset} | decode_record(raw))
                        held += len(raw)
                        if held > FETCH_BYTES:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

    ranges = (
        files.where("length > 0")
        .select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
        .select("path", "start", F.least("length", F.col("start") + split_bytes).alias("stop"))
    )
    tasks = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(min(tasks, 100_000)), "path", "start").mapInPandas(scan, RECORDS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder, reads these back and describes each record; see write_warc for null, repeated and missing rows. Ids keep all their 64 bits."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    manifest = write_warc(pages, folder, min_revisit_bytes)
    return read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


#: Digests and revisits of all pages. DuckDB has no base32: its letters are those of five bits each of the hexadecimal digest.
ROUND_TRIP_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, url, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS largest, count(*) OVER (PARTITION BY html) AS same,
         list_aggregate(list_transform(string_split(sha1(html), ''), lambda c: right('000' || bin(instr('0123456789abcdef', c) - 1), 4)), 'string_agg', '') AS bits
  FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: substr(bits, (i * 5 + k + 1)::BIGINT, 1)::INT << (4 - k)::INT))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN same > 1 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN same > 1 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to,
       replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri
FROM d
"""
