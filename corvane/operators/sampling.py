"""Seeded sampling as keyed hash order: the same seed and key always give the same choice.

md5 orders rows, so another engine can reproduce every draw. Ranks over a whole table are
found in two levels: by the hash's leading byte pair, then inside it, so that no task
sorts the table alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ranking import globally_ranked, ranked_in


def draw(seed: int | str, *keys: Column) -> Column:
    """The hex md5 of ``seed|key|key...``; null keys are empty."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the draw."""
    return F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("double") / float(1 << 52)


def toss(p: float, seed: int | str, *keys: Column) -> Column:
    """True with probability ``p``."""
    return uniform(seed, *keys) < p


def choice(options: Column, seed: int | str, *keys: Column) -> Column:
    """One element of an array; null of an empty one."""
    at = F.floor(uniform(seed, *keys) * F.size(options)).cast("int") + 1
    return F.try_element_at(options, at)


def ranked(df: DataFrame, order: list[Column], name: str = "rank", bucket: Column | None = None) -> DataFrame:
    """``df`` with its global 1-based rank by ``order``; ``bucket`` must be monotone in the order.

    Rows are ranked inside buckets, and bucket counts (one row each) give the offsets;
    without a bucket, ranges of the order serve as such.
    """
    if bucket is None:
        return globally_ranked(df, order, name)
    keyed = df.withColumn("__bucket", bucket)
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return keyed.withColumn(name, inner.cast("long")).join(F.broadcast(offsets), "__bucket").withColumn(name, F.col(name) + F.col("__offset")).drop("__bucket", "__offset")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``rank``, its place in a seeded shuffle; at most 65,536 buckets of equal share."""
    h = df.withColumn("__h", draw(seed, F.col(key)))
    return ranked(h, [F.col("__h"), F.col(key)], "rank", F.substring("__h", 1, 4)).drop("__h")


def holdout(df: DataFrame, key: str, seed: int, n: int | None = None, share: float | None = None) -> DataFrame:
    """``df`` with ``split``: the last ``n`` of a seeded shuffle, or all beyond floor(share x count), are ``validate``."""
    total = df.agg(F.count("*").alias("__total"))
    limit = F.col("__total") - n if n is not None else F.floor(F.col("__total") * share)
    return shuffled(df, key, seed).crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("rank") > limit, "validate").otherwise("train")).drop("rank", "__total")


def first_shuffled(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` of a seeded shuffle; all for a negative ``n``."""
    return df if n < 0 else df.orderBy(draw(seed, F.col(key)), key).limit(n)


def refilled(df: DataFrame, key: str, seed: int, n: int, passes: Column) -> DataFrame:
    """``n`` places of a seeded order, each with a row that ``passes``: ``place, asked, key`` and the row's other columns.

    The first ``n`` rows of the order are ``asked`` for. One that doesn't pass gives its place
    to the next row beyond the ``n`` that passes and that no place before it took; when those
    run out, passing rows are taken again from the order's start. So the k-th place that
    failed gets the k-th row of that list: both are numbered by ranges of the order, and
    nothing is retried. Null counts as not passing; without a passing row no place is filled.
    """
    order = shuffled(df.withColumn("__ok", F.coalesce(passes, F.lit(False))), key, seed)
    first = order.where(F.col("rank") <= n)
    kept = first.where("__ok").withColumn("place", F.col("rank")).withColumn("asked", F.col(key))
    failed = globally_ranked(first.where("not __ok").select(F.col("rank").alias("place"), F.col(key).alias("asked")), [F.col("place")], "__k")
    spare = order.where("__ok").withColumn("__late", (F.col("rank") <= n).cast("int"))
    spare = globally_ranked(spare, [F.col("__late"), F.col("rank")], "__k")
    total = spare.agg(F.count("*").alias("__total"))
    turned = failed.crossJoin(F.broadcast(total)).where("__total > 0").withColumn("__k", F.pmod(F.col("__k") - 1, F.col("__total")) + 1).drop("__total")
    filled = turned.join(spare.drop("__late"), "__k").drop("__k")
    return kept.unionByName(filled).drop("rank", "__ok").select("place", "asked", *df.columns)


def capped(df: DataFrame, group: list[str], key: str, seed: int, limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, chosen by seeded order."""
    w = Window.partitionBy(*group).orderBy(draw(seed, F.col(key)), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def positives_first(df: DataFrame, group: str, positive: str, key: str, seed: int, most: int, ratio: float) -> DataFrame:
    """Of each group all positives up to ``most``, and of its negatives at most min(most - taken, int(ratio x positives taken)).

    A group without a positive gives up to ``most`` of its rows.
    """
    w = Window.partitionBy(group, positive).orderBy(draw(seed, F.col(key)), key)
    counted = df.withColumn("__r", F.row_number().over(w)).withColumn("__p", F.least(F.sum(F.col(positive).cast("long")).over(Window.partitionBy(group)), F.lit(most)))
    negatives = F.when(F.col("__p") == 0, most).otherwise(F.least(most - F.col("__p"), F.floor(ratio * F.col("__p"))))
    return counted.where(F.col("__r") <= F.when(F.col(positive), F.lit(most)).otherwise(negatives)).drop("__r", "__p")


def rebalanced(df: DataFrame, negative: str, share: float) -> DataFrame:
    """``df`` with ``weight`` so that negatives carry ``share`` of the total weight."""
    counts = df.agg(F.count("*").alias("__n"), F.sum(F.col(negative).cast("long")).alias("__neg"))
    weight = F.when(F.col(negative), F.try_divide(share * (F.col("__n") - F.col("__neg")), (1 - share) * F.col("__neg"))).otherwise(1.0)
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", weight).drop("__n", "__neg")


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, with ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1)))


def mixture(spec: DataFrame, datasets: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """``draw_id, dataset, epoch, key`` of a weighted mixture.

    ``spec(dataset, weight)`` is small; ``datasets(dataset, key)`` may not be. A draw picks
    a dataset with chance weight x size; a dataset's k-th draw takes the next row of its
    current random order, and a new order begins when one is used up.
    """
    spark = spec.sparkSession
    sizes = datasets.groupBy("dataset").agg(F.count("*").alias("size"))
    bounds = spec.join(sizes, "dataset").withColumn("mass", F.col("weight") * F.col("size"))
    along = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)
    bounds = bounds.withColumns({"high": F.sum("mass").over(along), "total": F.sum("mass").over(Window.partitionBy())}).withColumn("low", F.col("high") - F.col("mass"))
    picks = spark.range(n_draws).withColumnRenamed("id", "draw_id").withColumn("u", uniform(seed, F.col("draw_id")))
    picked = picks.join(F.broadcast(bounds), F.expr("u * total >= low and u * total < high")).select("draw_id", "dataset", "size")
    visits = ranked_in(picked, ["dataset"], [F.col("draw_id")], "visit", "__n").withColumn("visit", F.col("visit") - 1).select("draw_id", "dataset", F.floor(F.col("visit") / F.col("size")).alias("epoch"), (F.col("visit") % F.col("size")).alias("place"))
    epochs = visits.select("dataset", "epoch").distinct()
    drawn = datasets.join(epochs, "dataset").withColumn("__h", draw(seed, F.col("epoch"), F.col("key")))
    orders = ranked_in(drawn, ["dataset", "epoch"], [F.col("__h"), F.col("key")], "place", "__n").withColumn("place", F.col("place") - 1).select("dataset", "epoch", "place", "key")
    return visits.join(orders, ["dataset", "epoch", "place"]).select("draw_id", "dataset", "epoch", "key")


def repeat_ratios(visits: DataFrame, dataset: str) -> DataFrame:
    """Of each dataset's draws: how many, how many different rows, and the ratio."""
    return visits.groupBy(dataset).agg(F.count("*").alias("draws"), F.countDistinct("key").alias("rows")).withColumn("ratio", F.col("draws") / F.col("rows"))


def split_by_table(df: DataFrame, key: str, table: DataFrame, split: str = "split") -> DataFrame:
    """``df`` with the split that ``table`` gives each key; fails if a key is in two splits or in none."""
    if not table.groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"a {key} is in two splits")
    if not df.join(table, key, "left_anti").isEmpty():
        raise ValueError(f"a {key} has no split")
    return df.join(table.select(key, split).distinct(), key)


def of_rank(df: DataFrame, place: str, rank: int, world: int) -> DataFrame:
    """The rows of one worker of ``world``: places that leave ``rank``."""
    return df.where(F.pmod(F.col(place), F.lit(world)) == rank)


def clip_frames(frame: Column, last: Column, rate: int, n: int) -> Column:
    """The ``n`` frames of a clip at a stride; frames past the end repeat the last but one step."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: frame + F.least(i * rate, last - frame - 1))
