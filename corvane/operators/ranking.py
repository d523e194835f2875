"""Top-k, fallbacks, batches and re-indexing as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written


def globally_ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its global 1-based rank by ``order``, found in ranges of rows, never in one task.

    Rows are parted into ranges of the order and written, so that retries can't move
    them; each range is ranked alone, and the ranges' counts (one row each) give offsets.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order)).cast("long")
    return parts.withColumn(name, inner).join(F.broadcast(offsets), "__range").withColumn(name, F.col(name) + F.col("__offset")).drop("__range", "__offset")


def ranked_in(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", count: str = "count") -> DataFrame:
    """``df`` with its 1-based rank in its group and the group's row count; a hot group is ranked in ranges like any other.

    Groups are summed to a row each, whose running counts turn global ranks into ranks of
    the group; a null in the group is a group of its own.
    """
    ranked = globally_ranked(df, [*(F.col(c).asc_nulls_first() for c in group), *order], "__at")
    if not group:
        return ranked.withColumnRenamed("__at", name).crossJoin(F.broadcast(df.agg(F.count("*").alias(count))))
    seen = ranked.groupBy(*group).agg(F.min("__at").alias("__first"), F.count("*").alias(count))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    out = ranked.alias("r").join(seen.alias("s"), same).select(*(F.col(f"r.{c}").alias(c) for c in df.columns), "__at", "__first", count)
    return out.withColumn(name, F.col("__at") - F.col("__first") + 1).drop("__at", "__first")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def first_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return top_k(df, group, order, 1, "__r").drop("__r")


def passing_or_first(df: DataFrame, group: list[str], order: list[Column], passes: Column) -> DataFrame:
    """The rows of each group that pass; its first row where none does."""
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"__ok": passes, "__r": F.row_number().over(w.orderBy(*order))}).withColumn("__any", F.max("__ok").over(w))
    return ranked.where(F.col("__ok") | (~F.col("__any") & (F.col("__r") == 1))).drop("__ok", "__r", "__any")


def flat_top_k(df: DataFrame, image: str, scores: str, n_classes: int, k: int) -> DataFrame:
    """The ``k`` best of a flattened (query x class) score array: ``query, label, score``."""
    flat = df.select(image, F.posexplode(scores).alias("at", "score"))
    best = top_k(flat, [image], [F.desc("score"), F.asc("at")], k)
    return best.select(image, F.floor(F.col("at") / n_classes).alias("query"), (F.col("at") % n_classes).alias("label"), "score", "rank")


def top_per_truth(df: DataFrame, truth: str, order: list[Column], k: int, assigned: str) -> DataFrame:
    """Of each truth its best matches, as many as it had assigned, ``k`` at most."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(truth).orderBy(*order)))
    quota = F.least(F.lit(k), F.sum(F.col(assigned).cast("int")).over(Window.partitionBy(truth)))
    return ranked.withColumn("__q", quota).where(F.col("__r") <= F.col("__q")).drop("__r", "__q")


def batches(df: DataFrame, group: list[str], order: list[Column], size: int, keep_last: bool = True) -> DataFrame:
    """``df`` with ``batch``: runs of ``size`` rows of each group in order; short last runs may be left out."""
    out = ranked_in(df, group, order, "__r", "__n").withColumn("batch", F.floor((F.col("__r") - 1) / size))
    return (out if keep_last else out.where((F.col("batch") + 1) * size <= F.col("__n"))).drop("__r", "__n")


def chunk_of(place: Column, count: Column, n: int) -> Column:
    """The chunk (0-based) of a 0-based place when ``count`` rows go into ``n`` chunks of equal, rounded-up size."""
    return F.floor(place / F.ceil(count / float(n)))


def merged_tail_chunk(place: Column, count: Column, size: int) -> Column:
    """The chunk of a place in runs of ``size``, a last run below half a run joined to the one before."""
    chunk = F.floor(place / size)
    last = F.floor((count - 1) / size)
    return F.when((chunk == last) & (last > 0) & (count - last * size < size / 2.0), last - 1).otherwise(chunk)


def dense_index(df: DataFrame, name: str, out: str = "index") -> DataFrame:
    """``df`` with the 0-based place of each distinct ``name`` in sorted order."""
    names = globally_ranked(df.select(name).distinct(), [F.col(name)], out).withColumn(out, F.col(out) - 1)
    return df.join(names, name)


def trailing_median(df: DataFrame, group: list[str], order: list[Column], value: str, n: int, out: str = "median") -> DataFrame:
    """``df`` with the median of the last ``n`` values of each group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(n - 1), 0)
    seen = F.array_sort(F.collect_list(value).over(w))
    size = F.size("__seen")
    middle = (F.element_at("__seen", F.floor((size + 1) / 2).cast("int")) + F.element_at("__seen", F.floor((size + 2) / 2).cast("int"))) / 2
    return df.withColumn("__seen", seen).withColumn(out, middle).drop("__seen")


def nearest_rank(df: DataFrame, group: list[str], value: str, q: float, out: str = "quantile") -> DataFrame:
    """The value at rank max(1, q x n rounded half to even) of each group, without interpolation."""
    ranked = ranked_in(df.select(*group, value), group, [F.col(value)], "__r", "__n")
    at = F.greatest(F.rint(F.col("__n") * q), F.lit(1.0)).cast("long")
    return ranked.where(F.col("__r") == at).select(*group, F.col(value).alias(out))


def smoothed(values: Column, decay: float) -> Column:
    """The exponential moving average of an ordered array, begun at its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.element_at(values, 1), lambda acc, x: acc * decay + x * (1 - decay))
