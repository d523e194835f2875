"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing gives one gzip member for each record and, for each record, an index row: file,
offset, length, URL and payload digest. Of pages with equal payloads of ``MIN_REVISIT``
bytes or more the one with the largest page_id is stored whole (``response``), the others
as ``revisit`` records that refer to it; smaller payloads are always stored.

Reading starts from index rows alone: they are dealt by file and stretch of the file, so
that tasks get like numbers of archive bytes, sorted by offset, and neighbouring ranges are
fetched in one read. A task that fails leaves a file that no
index row names; the rows of its next attempt name a file of their own.

Defined cases: a very long page is a record, and a read, of its own; a null html is an empty payload, a null URL an empty one; a null page_id
stays null and is a revisit only of a page that has an id; rows that repeat the largest
page_id of a payload are all responses; an empty table gives no files and no rows; other
columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_checked
from corvane.llm.shared_files import opened
from corvane.session import new_path, written

MIN_REVISIT = 1000
#: Compressed bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 32 << 20
#: Unwanted bytes that a read may span, and its size at most (one record may be larger).
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Archive bytes that a reading task takes, about, and at least while cores would idle.
TASK_BYTES, LEAST_TASK_BYTES = 128 << 20, 2 << 20
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit if ``refers_to`` is given."""
    name = lambda i: "<urn:page:none>" if i is None else f"<urn:page:{i}>"
    coded = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: {coded}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """``page_id``, ``url``, ``payload`` (None for a revisit), ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda s: None if s == "<urn:page:none>" else int(s[len("<urn:page:") : -1])
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"]}
    if fields["WARC-Type"] == "revisit":
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        return out | {"payload": None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "refers_to": number(fields["WARC-Refers-To"])}
    payload = block.partition(b"\r\n\r\n")[2]
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None}


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` and return the index, itself written."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    large = rows.where(F.octet_length("html") >= min_revisit)
    keepers = written(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper"), "keepers")
    marked = join_checked(rows, keepers, "digest").withColumn("refers_to", F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = at = out = None
        name = ""
        for batch in batches:
            made: dict[str, list] = {k: [] for k in ("file", "offset", "length", "url", "digest", "record_type", "page_id")}
            for page_id, url, text, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    store, path = opened(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out, at = store.open_output_stream(path, compression=None), 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, text.encode(), digest, refers_to)) + packer.flush()
                out.write(member)
                for k, v in zip(made, (name, at, len(member), url, digest, "response" if refers_to is None else "revisit", page_id), strict=True):
                    made[k].append(v)
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict(made, schema=_INDEX_ARROW)
        if out is not None:
            out.close()

    return written(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")


_INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())])
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Sorted records as (first, end, offset, bytes) of each read: near neighbours share one."""
    first = 0
    for k in range(1, len(offsets) + 1):
        begin, done = offsets[first], offsets[k - 1] + lengths[k - 1]
        if k == len(offsets) or offsets[k] - done > gap or offsets[k] + lengths[k] - begin > most:
            yield first, k, begin, done - begin
            first = k


def read_archives(selected: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the index rows ``selected(file, offset, length)``; ``payload`` bytes only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, ""
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            begin = 0
            for end in range(1, len(files) + 1):
                if end < len(files) and files[end] == files[begin]:
                    continue
                if files[begin] != held:
                    if file is not None:
                        file.close()
                    store, path = opened(files[begin])
                    file, held = store.open_input_file(path), files[begin]
                own, size = offsets[begin:end], lengths[begin:end]
                for first, last, at, n in ranges(own, size):
                    blob = file.read_at(n, at)
                    found = [parsed(zlib.decompress(blob[own[k] - at : own[k] - at + size[k]], 31)) for k in range(first, last)]
                    if not payloads:
                        found = [f | {"payload": None} for f in found]
                    yield pa.RecordBatch.from_pylist(found, schema=_READ_ARROW)
                begin = end
        if file is not None:
            file.close()

    # dealt by archive bytes: an index row is tiny, so its own size says nothing; a number that is given isn't merged again
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    most = max(LEAST_TASK_BYTES, min(TASK_BYTES, size // (3 * selected.sparkSession.sparkContext.defaultParallelism)))
    sorted_rows = selected.select("file", "offset", "length").repartition(max(1, -(-size // most)), "file", F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset")
    out = sorted_rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")
