"""Hard negatives: for each anchor and each of its nearest rows of the same label, near rows of other labels below it.

Scores are inner products of scaled integer vectors, exact. Rows are dealt evenly once and
stay where they lie; anchors, a stated set of queries, are files of bounded groups in the
shared folder, which each task reads group after group against its block of rows. Of a block
every anchor's scores are sorted in full, by score and id (``lexsort``): a first pass takes
the first rows of the anchor's label, its positives; a second finds each positive's upper
limit by binary search among the sorted scores of other labels and reads on from there down
to its lower limit. What blocks return is bounded per anchor, and ranked windows, limited in
each task before their shuffle, merge the blocks. So no task holds an anchor's scores over
all rows, and nothing passes through the driver but the names of the group files.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take
no part; vectors of other lengths count as filled with zeros; scores beyond 64 bits count as
the largest or smallest long; equal scores are ordered by id; of rows that share an id the
one of the least label, then vector, counts; an anchor without another row of its label has
no positives, a positive without a row between its limits no negatives: neither gives rows;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_checked
from corvane.llm.shared_files import opened
from corvane.session import new_path, written

#: A component becomes floor(SCALE * x); positives of an anchor, negatives of a positive, and their score limits in per cent of the positive's.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Components of a block of rows, scores made at once, and anchors of a group file on average.
BLOCK_CELLS, TILE, GROUP = 1 << 22, 1 << 20, 1024
#: Rows of a partition on average, beyond one for each core.
PART_ROWS = 1 << 18

_LONG = np.iinfo(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(size.max(initial=0))
    if len(size) and size.min() == width:
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, as int64 and exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = width * max(int(abs(a).max(initial=0)), 1) * max(int(abs(b).max(initial=0)), 1)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), _LONG.min, _LONG.max).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of a task's rows, a bounded block at a time."""
    held: list[pa.RecordBatch] = []
    cells = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        return t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"])

    for batch in batches:
        at = 0
        ends = batch.column("v").offsets.to_numpy()
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_CELLS - cells, "right")) - 1)
            end = min(end, batch.num_rows)
            held.append(batch.slice(at, end - at))
            cells += int(ends[end] - ends[at])
            at = end
            if cells >= BLOCK_CELLS or at < batch.num_rows:
                yield block()
                held, cells = [], 0
    if held:
        yield block()


def _against(rows: DataFrame, files: list[str], columns: list[str], each: Callable[[dict, int, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """What ``each`` finds for every anchor of the group files in every block of ``rows``.

    ``each`` gets the group's columns, the anchor's place there, and scores, ids and labels of the block; it returns long columns ``names``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in _blocks(batches):
            step = max(1, TILE // len(ids))
            for uri in files:
                where, path = opened(uri)
                group = pq.read_table(path, filesystem=where, columns=[*columns, "v"], partitioning=None)
                asked, held = _matrix(group["v"]), {c: group[c].to_pylist() for c in columns}
                for at in range(0, len(asked), step):
                    scores = exact_scores(asked[at : at + step], vectors)
                    made = [each(held, at + i, s, ids, labels) for i, s in enumerate(scores)]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*made, strict=True)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _sorted(scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the masked rows, higher scores first, ties by smaller id."""
    scores, ids = scores[mask], ids[mask]
    order = np.lexsort((ids, ~scores))  # ~ falls as scores rise, without overflow
    return scores[order], ids[order]


def _grouped(anchors: DataFrame, n: int, label: str) -> list[str]:
    """The files of the anchors, in groups of ``GROUP`` on average."""
    path = new_path(anchors.sparkSession, label)
    anchors.repartition(max(1, -(-n // GROUP)), "id").write.parquet(path)
    return sorted(anchors.sparkSession.read.schema(anchors.schema).parquet(path).inputFiles())


def integer_rows(vectors: DataFrame, ident: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``id, label, v`` of the rows that take part, one an id, dealt evenly and written."""
    spark = vectors.sparkSession
    x = F.col(vector)
    given = vectors.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & x.isNotNull())
    given = given.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = given.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("v"))
    again = written(given.groupBy(F.col(ident).cast("long").alias("id")).count().where("count > 1").select("id"), "vector-repeats")
    if not again.isEmpty():
        once = join_checked(rows, again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("first")).select("id", "first.*")
        rows = join_checked(rows, again, "id", "left_anti").unionByName(once)
    parts = max(spark.sparkContext.defaultParallelism, -(-given.count() // PART_ROWS))
    return written(rows.repartition(parts, "id"), "vectors")


def hard_negatives(vectors: DataFrame, anchors: Column | str, ident: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the first ``negatives`` rows of other labels
    whose score lies between ``low`` and ``high`` per cent of the positive's, for each row where ``anchors`` (of ``ident``) holds
    and each of its first ``positives`` other rows of the same label.
    """
    rows = integer_rows(vectors, ident, vector, label, scale)
    asked = written(rows.withColumn(ident, F.col("id")).where(anchors).select("id", "label", "v"), "anchors")
    n = asked.count()

    def nearest(group: dict, i: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        s, who = _sorted(scores, ids, (labels == group["label"][i]) & (ids != group["id"][i]))
        s, who = s[:positives], who[:positives]
        return [np.full(len(s), group["id"][i]), who, s]

    def below(group: dict, i: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        s, who = _sorted(scores, ids, labels != group["label"][i])
        out = [[np.zeros(0, np.int64)] * 4]
        for p in group["positives"][i]:
            upper, lower = high * p["positive_score"] // 100, -(-low * p["positive_score"] // 100)
            at = int(np.searchsorted(~s, ~np.int64(min(max(upper, _LONG.min), _LONG.max))))
            took = s[at : at + negatives]
            took = took[took >= lower]
            out.append([np.full(len(took), p["positive_id"]), np.full(len(took), p["positive_score"]), who[at : at + len(took)], took])
        made = [np.concatenate(c) for c in zip(*out, strict=True)]
        return [np.full(len(made[0]), group["id"][i]), *made]

    def first(df: DataFrame, keys: list[str], score: str, who: str, k: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(who))
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = _against(rows, _grouped(asked, n, "anchor-groups"), ["id", "label"], nearest, ["id", "positive_id", "positive_score"])
    chosen = first(near, ["id"], "positive_score", "positive_id", positives).groupBy("id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    full = _grouped(asked.join(written(chosen, "positives"), "id"), n, "positive-groups")
    found = _against(rows, full, ["id", "label", "positives"], below, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    ranked = first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
