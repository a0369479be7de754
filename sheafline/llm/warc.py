"""WARC archives, index first.

Writing: each task appends its records, one gzip member each, to archive files
of its own in the shared folder, and returns one index row per record: file,
offset, length, URL, digest, type. The index is a Parquet table written with
Spark's commit protocol. Files carry a random part in their names, so a repeated
task writes new files and the index names only those of the task that counted.

Reading: selected index rows are sorted by file and offset, cut into runs of
bounded bytes, and each run is read by coalesced byte-range reads through
pyarrow's file systems; no archive is read whole for a few records.

Revisits: the digests are aggregated narrowly (digest -> smallest id, with
map-side combine), never with the payload. The table of revisits goes to the
writing tasks by broadcast while it has at most ``broadcast_bytes`` bytes, else by
a join on the record id. No payload is shuffled in the first case.

Defined cases: a null payload is empty; equal payloads of at least
``revisit_min_bytes`` bytes share one response, that of the smallest page_id;
rows that repeat this page_id are responses too; rows with a null page_id are
responses unless another id holds their payload; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import column, map_batches
from sheafline.session import fresh_path, ship, staged

INDEX_SCHEMA = "page_id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ_SCHEMA_FULL = READ_SCHEMA + ", url string, payload string"
_DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_uri(page_id: int | None, ordinal: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{ordinal}')}>"


def _clean(value: str) -> str:
    """A header value on one line; controls and the percent sign are escaped."""
    return "".join(c if c >= " " and c not in "%\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _unclean(value: str) -> str:
    out, at = bytearray(), 0
    raw = value.encode()
    while at < len(raw):
        if raw[at] == 37:
            out.append(int(raw[at + 1 : at + 3], 16))
            at += 3
        else:
            out.append(raw[at])
            at += 1
    return out.decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC/1.1 record with an HTTP response block; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_uri(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_uri(refers_to, digest)}")
        lines.append(f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers |= {"http-" + k: v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return headers, payload


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, refers_to of the records whose payload an earlier page holds."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("bytes")).filter(F.col("bytes") >= min_bytes)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return narrow.join(first, "digest").filter("page_id is null or page_id > refers_to").select("page_id", "refers_to", "digest").distinct()


def write_archives(pages: DataFrame, folder: str, revisit_min_bytes: int = 0, broadcast_bytes: int = 1 << 26, file_bytes: int = 1 << 28, level: int = 1) -> DataFrame:
    """Write WARC files below ``folder``; the index, staged, one row per record."""
    spark = pages.sparkSession
    ship(spark)
    known = staged(revisits(pages, revisit_min_bytes), "revisits")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    source = source.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # A null id has no key to join on: such rows look their digest up through the same table.
    keyed = known.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.hex("digest"))).select(F.col("key").alias("key_of"), F.col("digest").alias("digest_of"), "refers_to")
    size = keyed.select(F.sum(F.octet_length("key_of") + F.octet_length("digest_of") + 64)).first()[0] or 0  # with a row's own bytes
    if size <= broadcast_bytes:
        keyed = F.broadcast(keyed)
    source = source.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.hex("digest"))).join(keyed, (F.col("key") == F.col("key_of")) & (F.col("digest") == F.col("digest_of")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"records-{uuid.uuid4().hex}.warc.gz", 0
                        out = filesystem.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed one by one
                    data = html.encode()
                    digest = digest_of(data)
                    revisit = refers_to is not None
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, data, digest, refers_to, revisit)) + packer.flush()
                    out.write(member)
                    rows.append((page_id, name, offset, len(member), url, digest, len(data), "revisit" if revisit else "response", refers_to))
                    offset += len(member)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    names = ["page_id", "file", "offset", "length", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return staged(map_batches(source, run, INDEX_SCHEMA, "warc"), "warc-index")


def read_records(index: DataFrame, folder: str, run_bytes: int = 1 << 24, gap_bytes: int = 1 << 16, read_bytes: int = 1 << 23, with_payload: bool = False, most_tasks: int = 10_000) -> DataFrame:
    """The records of the index rows given, by coalesced byte-range reads.

    Rows are dealt by (file, offset div run_bytes): one run of an archive is one
    unit of work of bounded size, whatever the file's size.
    """
    ship(index.sparkSession)

    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        group: list[tuple[str, int, int]] = []
        for row in rows:
            if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + gap_bytes or row[1] + row[2] - group[0][1] > read_bytes):
                yield group
                group = []
            group.append(row)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            wanted = list(zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for group in ranges(wanted):
                if opened != group[0][0]:
                    if source is not None:
                        source.close()
                    opened, source = group[0][0], filesystem.open_input_file(f"{root}/{group[0][0]}")
                begin = group[0][1]
                block = source.read_at(group[-1][1] + group[-1][2] - begin, begin)
                rows = []
                for _, offset, length in group:
                    headers, payload = parse(zlib.decompress(block[offset - begin : offset - begin + length], 31))
                    kind = headers["WARC-Type"]
                    stored = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    digest = digest_of(payload) if kind == "response" else stored
                    if digest != stored:
                        raise ValueError(f"{opened} at {offset}: the payload does not have the digest {stored}")
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                    row = (int(page) if page else None, int(headers["http-Content-Length"]), digest, kind, int(refers) if refers else None)
                    if with_payload:
                        url = headers.get("WARC-Target-URI")
                        row += (None if url is None else _unclean(url), payload.decode() if kind == "response" else None)
                    rows.append(row)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()][: len(rows[0])]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: len(rows[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if source is not None:
            source.close()

    # The number of tasks follows the bytes to read, not those of the index, up to most_tasks; a task reads its runs one after another.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(most_tasks, max(1, -(-total // run_bytes)))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / run_bytes)).sortWithinPartitions("file", "offset")
    return map_batches(dealt, run, READ_SCHEMA_FULL if with_payload else READ_SCHEMA, "warc")


def warc_round_trip(pages: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    """Write all pages, then read every record of the index back."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, revisit_min_bytes)
    return read_records(index, folder)
