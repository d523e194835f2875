"""Token counts by a separator scan of flat token files.

Tokens lie as 16-bit little-endian ids in plain files, each document ending with a
separator id; there is no index. A stream is a run of numbered files of ``FILE_BYTES``,
cut without regard to documents. Scanning takes the files in blocks, as Spark tasks: one
vectorised search finds a block's separators; documents that begin and end in the block
are counted there, and the block reports its length, its separators, and its first and
last one. A prefix scan of those reports (running sums and maxima along a stream) gives
each block the number of its first document and the place where that one began, which
stitches the documents that cross blocks and files.

Defined cases: null and empty texts are documents of 0 tokens; tokens after the last
separator of a stream belong to no document; a very long text crosses as many files and
blocks as it needs; repeated rows are documents of their own;
an empty table gives no files and no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared_files import opened
from corvane.session import new_path, written

FILE_BYTES = 8 << 20
#: Tokens of one scanned block.
BLOCK_TOKENS = 1 << 20
#: The public pattern that parts texts before byte-pair merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_pairs(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file (a token in base64 and its rank on each line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, vocabulary: str, separator: int, folder: str) -> DataFrame:
    """Encode every text into flat files below ``folder``; returns ``stream, ordinal, doc_id``, itself written.

    A stream is what one attempt of a task writes, numbered by the attempt, and the rows
    that Spark commits carry that number. So files and ordinals always come from the same
    attempt; files of lost or speculative attempts stay, and no row names them.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        stream = TaskContext.get().taskAttemptId()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        held, n_files, ordinal = bytearray(), 0, 0

        def flush(size: int) -> None:
            nonlocal n_files
            with store.open_output_stream(f"{root}/s{stream:012d}-{n_files:06d}.bin", compression=None) as out:
                out.write(memoryview(held)[:size])
            n_files += 1
            del held[:size]

        end = np.uint16(separator).tobytes()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = coder.encode_ordinary(text or "")
                held += np.array(ids, np.uint16).tobytes() + end
                while len(held) >= FILE_BYTES:
                    flush(FILE_BYTES)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, stream, np.int64)), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], names=["stream", "ordinal", "doc_id"])
            ordinal += n
        if held:
            flush(len(held))

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "stream long, ordinal long, doc_id long"), "token-order")


def scan_tokens(spark: SparkSession, folder: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``stream, ordinal, n_tokens`` of every document in the flat files below ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "s*.bin").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                stream, file = map(int, path.rpartition("/s")[2][:-4].split("-"))
                tokens = np.frombuffer(content.as_buffer(), "<u2")
                for block, at in enumerate(range(0, len(tokens), block_tokens)):
                    part = tokens[at : at + block_tokens]
                    ends = np.flatnonzero(part == separator)
                    n = len(ends)
                    inner = np.diff(ends) - 1
                    yield pa.RecordBatch.from_pydict({"stream": [stream], "file": [file], "block": [block], "size": [len(part)], "n_ends": [n], "first_end": [int(ends[0]) if n else None], "last_end": [int(ends[-1]) if n else None], "inner": [inner]}, schema=_REPORT)

    reports = written(files.select("path", "content").mapInArrow(run, "stream long, file int, block int, size long, n_ends long, first_end long, last_end long, inner array<long>"), "token-blocks")
    along = Window.partitionBy("stream").orderBy("file", "block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summed = reports.drop("inner").withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum("n_ends").over(before), F.lit(0))})
    summed = summed.withColumn("open_at", F.coalesce(F.max(F.col("start") + F.col("last_end")).over(before) + 1, F.lit(0)))
    crossing = summed.where("n_ends > 0").select("stream", "ordinal", (F.col("start") + F.col("first_end") - F.col("open_at")).alias("n_tokens"))
    inside = reports.select("stream", "file", "block", F.posexplode("inner").alias("k", "n_tokens")).join(summed.select("stream", "file", "block", "ordinal"), ["stream", "file", "block"])
    return crossing.unionByName(inside.select("stream", (F.col("ordinal") + 1 + F.col("k")).alias("ordinal"), "n_tokens"))


_REPORT = pa.schema([("stream", pa.int64()), ("file", pa.int32()), ("block", pa.int32()), *((k, pa.int64()) for k in ("size", "n_ends", "first_end", "last_end")), ("inner", pa.list_(pa.int64()))])


def token_counts(docs: DataFrame, vocabulary: str, separator: int) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row of ``docs``, counted from the flat files alone."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    order = write_tokens(docs, vocabulary, separator, folder)
    if order.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    return order.join(scan_tokens(spark, folder, separator), ["stream", "ordinal"]).select("doc_id", "n_tokens")
