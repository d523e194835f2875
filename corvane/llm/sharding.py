"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows are written with their input partition and place in it, so retries can't move them.
2. The driver counts the partitions and draws, from one seed, how many rows of each go to
   each shard: row by row of a multivariate hypergeometric law, which is the law that a
   uniform permutation of all rows would give. The matrix has partitions x shards numbers.
3. Each partition permutes its own rows against its matrix row (local permutation).
4. Rows are exchanged, and each shard's rows are ordered by a keyed hash of where they came
   from (second permutation): in buckets of the hash's leading bits, whose counts give
   each bucket's first slot, so no task ever holds a whole shard.

Shard sizes differ by one row at most, slots are gapless from 0.

Defined cases: repeated rows and null ids are rows like any other, since only place
decides; very long texts move like any value; equal keys of the second permutation
are ordered by partition and place; an empty table gives no rows; all columns of the table
are kept, its own ``shard`` and ``slot`` as ``table_shard`` and ``table_slot``; names starting
``__corvane_`` are the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_checked
from corvane.session import written

SEED = 90210
#: Rows of one ordering bucket, about, and tasks that order buckets at most (each then orders several, one after the other).
BUCKET_ROWS, MOST_PARTS = 8192, 1 << 16
_P, _I, _K, _B, _O = (f"__corvane_{x}" for x in ("partition", "place", "key", "bucket", "offset"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One draw; beyond numpy's range of 10**9 by rejection from a ratio-of-uniforms hat."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mean = drawn * good / total
    spread = math.sqrt(mean * (bad / total) * (total - drawn) / (total - 1) + 0.5)
    log_p = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    top = log_p(mode)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows of each partition go to each shard; the columns sum to sizes one apart at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        rest = sum(left)
        for s in range(shards):
            out[p, s] = hypergeometric(rng, left[s], rest - left[s], n) if n and rest else 0
            rest, n = rest - left[s], n - int(out[p, s])
            left[s] -= int(out[p, s])
    return out


def sharded(rows: DataFrame, shards: int, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard)."""
    spark = rows.sparkSession
    own = [c for c in rows.columns if c in ("shard", "slot")]
    rows = rows.withColumnsRenamed({c: f"table_{c}" for c in own})
    placed = written(rows.withColumn(_P, F.spark_partition_id()).withColumn(_I, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    counts = {r[0]: r[1] for r in placed.groupBy(_P).count().collect()}  # one row a partition
    order = sorted(counts)
    plan = dict(zip(order, matrix([counts[p] for p in order], shards, seed), strict=True))
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("int")
    def shard_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        deals: dict[int, np.ndarray] = {}
        for partition, place in batches:
            source, at = partition.to_numpy(), place.to_numpy()
            needed = np.unique(source).tolist()
            deals = {p: deals[p] for p in needed if p in deals}
            out = np.zeros(len(place), np.int32)
            for p in needed:
                if p not in deals:
                    deal = np.repeat(np.arange(shards, dtype=np.int32), shared.value[p])
                    deals[p] = np.random.default_rng([seed, p]).permutation(deal)
                out[source == p] = deals[p][at[source == p]]
            yield pd.Series(out)

    bits = max(0, math.ceil(math.log2(max(1, sum(counts.values()) / shards / bucket_rows))))
    keyed = placed.withColumn("shard", shard_of(_P, _I)).withColumn(_K, F.xxhash64(F.lit(seed), F.col(_P), F.col(_I)))
    keyed = keyed.withColumn(_B, F.expr(f"shiftrightunsigned({_K}, {64 - bits})") if bits else F.lit(0).cast("long"))  # follows from written columns and the seed, so it is worked out again, not stored
    sizes = keyed.groupBy("shard", _B).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", _B, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_O))
    rank = F.row_number().over(Window.partitionBy("shard", _B).orderBy(_K, _P, _I))
    parts = min(shards << bits, max(spark.sparkContext.defaultParallelism, 2 * -(-sum(counts.values()) // bucket_rows)), MOST_PARTS)
    keyed = keyed.repartition(parts, "shard", _B)  # by the rows counted, whatever the session's number of partitions
    return join_checked(keyed.withColumn("slot", rank.cast("long") - 1), offsets, ["shard", _B], "inner").withColumn("slot", F.col("slot") + F.col(_O)).drop(_P, _I, _K, _B, _O)
