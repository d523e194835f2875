"""Nearest vectors: a stated set of queries against all rows, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import top_k
from corvane.session import new_path, opened

#: Vectors of a block of rows at most, queries of a file on average, similarities made at once, rows of a partition on average.
BLOCK, GROUP, TILE, PART_ROWS = 1 << 16, 1024, 1 << 20, 1 << 18


def _unit(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows of length 1, and which of them aren't zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm > 0, norm, 1)[:, None], norm > 0


def nearest(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """``q, <ident>, similarity, rank``: the ``k`` rows of ``vectors`` of the largest cosine to each row of ``queries``, itself left out.

    Rows are dealt evenly and stay there; the queries are files of bounded groups in the
    shared folder, and each task takes group after group against its blocks of rows. What is
    shuffled is each block's own best ``k`` of a query. Ties go to the least ident; a zero
    vector is similar to nothing.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    path = new_path(spark, "asked")
    asked = plain(queries)
    asked.repartition(max(1, -(-asked.count() // GROUP)), "id").write.parquet(path)
    files = sorted(spark.read.schema(asked.schema).parquet(path).inputFiles())
    rows = plain(vectors)
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS)), "id")

    def best(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, (m, held) = table["id"].to_numpy(), _unit(table["v"])
        ids, m = ids[held], m[held]
        step = max(1, TILE // max(len(ids), 1))
        for uri in files if len(ids) else ():
            where, at = opened(uri)
            group = pq.read_table(at, filesystem=where, partitioning=None)
            q, (a, real) = group["id"].to_numpy(), _unit(group["v"])
            q, a = q[real], a[real]
            for start in range(0, len(q), step):
                near = np.round(a[start : start + step] @ m.T, digits)
                who = q[start : start + step]
                near[who[:, None] == ids[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :k]
                found = np.take_along_axis(near, order, 1)
                keep = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, order.shape[1]).reshape(order.shape)[keep]), pa.array(ids[order][keep]), pa.array(found[keep])], names=["q", ident, "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from best(pa.Table.from_batches(held))
                held = []
        if held:
            yield from best(pa.Table.from_batches(held))

    found = rows.mapInArrow(run, f"q long, `{ident}` long, similarity double")
    return top_k(found, ["q"], [F.desc("similarity"), F.asc(ident)], k)
