"""Grouping into nested records, ordered lookups, strict joins and set assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested(df: DataFrame, key: list[str], order: list[str], fields: list[str], out: str) -> DataFrame:
    """One row a key with ``out``, its (order..., fields...) structs in order; a key without rows has none."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("__items")).select(*key, F.transform("__items", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(out))


def nested_by(df: DataFrame, key: list[str], order: list[str], fields: list[str], cases: dict[str, Column]) -> DataFrame:
    """As ``nested``, once for each named condition; a row counts where its condition holds."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    return df.groupBy(*key).agg(*(F.array_sort(F.collect_list(F.when(test, item))).alias(name) for name, test in cases.items()))


def looked_up_in_order(df: DataFrame, key: str, array: str, table: DataFrame, table_key: str, value: str, out: str, default: str | None = None) -> DataFrame:
    """``df`` with ``out``: for each element of ``array`` its value in ``table``, in order, null (or ``default``) on a miss.

    ``key`` identifies a row of ``df``.
    """
    parts = df.select(key, F.posexplode_outer(array).alias("__at", "__element"))
    found = parts.join(table.select(F.col(table_key).alias("__element"), F.col(value).alias("__value")), "__element", "left")
    shown = F.col("__value") if default is None else F.coalesce("__value", F.lit(default))
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("__at").isNotNull(), F.struct("__at", shown.alias("v"))))).alias("__l"))
    return df.join(lists.select(key, F.transform("__l", lambda x: x["v"]).alias(out)), key, "left")


def prefixed_join(df: DataFrame, table: DataFrame, on: dict[str, str], prefix: int = 1) -> DataFrame:
    """``df`` joined to ``table`` where its keys, without their first ``prefix`` characters, are the table's: ``on`` maps key to table key."""
    cut = {f"__k{i}": F.substring(F.col(k).cast("string"), F.lit(prefix + 1), F.length(F.col(k).cast("string"))) for i, k in enumerate(on)}
    right = table.withColumns({f"__k{i}": F.col(t).cast("string") for i, t in enumerate(on.values())}).drop(*on.values())
    return df.withColumns(cut).join(right, list(cut)).drop(*cut)


def zipped(left: DataFrame, right: DataFrame, group: list[str], order: str) -> DataFrame:
    """The k-th row of ``left`` beside the k-th of ``right`` within each group, by ``order``; fails if one side is longer.

    ``order`` is the line number or another stable key of both files.
    """
    place = lambda df: df.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(order))).drop(order)
    a, b = place(left), place(right)
    odd = a.select(*group, "__at").join(b.select(*group, F.col("__at"), F.lit(True).alias("__b")), [*group, "__at"], "full_outer").join(a.select(*group, "__at", F.lit(True).alias("__a")), [*group, "__at"], "left").where("__a is null or __b is null")
    if not odd.isEmpty():
        raise ValueError("the sides differ in length")
    return a.join(b, [*group, "__at"]).withColumnRenamed("__at", order)


def scattered(df: DataFrame, key: str, done: DataFrame, value: str) -> DataFrame:
    """``df`` with the rows that ``done(key, value)`` holds rewritten, each in its place."""
    new = done.select(key, F.col(value).alias("__new"), F.lit(True).alias("__has"))
    return df.join(new, key, "left").withColumn(value, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__has")


def in_list_order(names: DataFrame, position: str, key: str, table: DataFrame) -> DataFrame:
    """The table's row of each listed key, repeats too, with its position; fails on a key without one."""
    return strict_join(names.select(position, key), table, [key])


def grouped_lookup(df: DataFrame, key: str, items: DataFrame, order: list[str], fields: list[str], out: str) -> DataFrame:
    """``df`` with its key's items as an ordered array, empty where it has none."""
    found = nested(items, [key], order, fields, out)
    joined = df.join(found, key, "left")
    return joined.withColumn(out, F.coalesce(out, F.from_json(F.lit("[]"), joined.schema[out].dataType)))


def with_proposals(df: DataFrame, key: str, proposals: DataFrame, proposal_key: str, score: str, fields: list[str], out: str = "proposals") -> DataFrame:
    """``df`` with its proposals, best score first; ids are compared as strings, and a row without proposals fails."""
    item = F.struct((-F.col(score)).alias("__s"), *fields)
    lists = proposals.groupBy(F.col(proposal_key).cast("string").alias("__key")).agg(F.array_sort(F.collect_list(item)).alias("__l"))
    rows = strict_join(df.withColumn("__key", F.col(key).cast("string")), lists, ["__key"])
    return rows.withColumn(out, F.transform("__l", lambda x: F.struct(*(x[f].alias(f) for f in fields)))).drop("__key", "__l")


def present_targets(tags: Column, available: Column) -> Column:
    """Of an array of tags those whose target is among the available ones, with its place there."""
    return F.filter(F.transform(tags, lambda t: F.struct(t.alias("tag"), (F.array_position(available, t["target"]) - 1).alias("place"))), lambda x: x["place"] >= 0)


def renamed_targets(targets: Column, negatives: Column, name: str) -> tuple[Column, Column]:
    """Maps of target arrays with every target's name overwritten, and negative lists of one name set to it."""
    positive = F.transform_values(targets, lambda k, v: F.transform(v, lambda t: t.withField("name", F.lit(name))))
    return positive, F.transform_values(negatives, lambda k, v: F.when(F.size(v) == 1, F.array(F.lit(name))).otherwise(v))


def enough_keypoints(annotations: Column, least: int) -> Column:
    """Whether the visible keypoints (every third value above 0) of all annotations reach ``least``."""
    seen = lambda a: F.size(F.filter(a["keypoints"], lambda v, i: (i % 3 == 2) & (v > 0)))
    return F.aggregate(annotations, F.lit(0), lambda s, a: s + seen(a)) >= least


def existing(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """The rows whose path is among the listed ``files(path)``."""
    return df.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def strict_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that fails when a row of ``df`` has no partner."""
    missing = df.join(table, on, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"no partner on {on}")
    return df.join(table, on)


def consistent(df: DataFrame, key: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys whose rows agree in all ``fields`` (nulls equal), with those; and the keys that don't."""
    seen = df.groupBy(*key).agg(F.min(F.struct(*fields)).alias("__a"), F.max(F.struct(*fields)).alias("__b"))
    agree = F.col("__a").eqNullSafe(F.col("__b"))
    return seen.where(agree).select(*key, *(F.col(f"__a.{f}").alias(f) for f in fields)), seen.where(~agree).select(*key)


def sequence_verdicts(df: DataFrame, key: str, number: str, shape: str) -> DataFrame:
    """``key`` and ``whole``: whether its numbers run from 1 to n without gap and its shapes are one.

    Repeats of a number meet first, so a row is shuffled once and a distinct number once more, never a copy of a row for each count.
    """
    apart = df.groupBy(key, number).agg(F.count("*").alias("n"), F.min(shape).alias("low"), F.max(shape).alias("high"))
    seen = apart.groupBy(key).agg(F.min(number).alias("a"), F.max(number).alias("b"), F.sum("n").alias("n"), F.count(number).alias("d"), F.min("low").alias("low"), F.max("high").alias("high"))
    good = (F.col("a") == 1) & (F.col("b") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("low") == F.col("high"))
    return seen.select(key, F.coalesce(good, F.lit(False)).alias("whole"))


def whole_sequences(df: DataFrame, key: str, number: str, shape: str) -> tuple[DataFrame, DataFrame]:
    """Keys whose numbers run from 1 to n without gap and whose shapes are one; and the others."""
    seen = sequence_verdicts(df, key, number, shape)
    return seen.where("whole").select(key), seen.where("not whole").select(key)


def pending(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't done yet."""
    return df.join(done.select(*key).distinct(), key, "left_anti")


def unique_or_fail(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, after a check that no key occurs twice."""
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} isn't unique")
    return df


def document_frequency(df: DataFrame, terms: Column, out: str = "term") -> DataFrame:
    """In how many rows each distinct term occurs, most frequent first; null terms count."""
    return df.select(F.explode(F.array_distinct(terms)).alias(out)).groupBy(out).agg(F.count("*").alias("n")).orderBy(F.desc("n"), out)


def group_offsets(df: DataFrame, key: list[str], group: str, order: str, size: str) -> DataFrame:
    """Per (key, group): first place, total size, and the running offset of groups in order of first place."""
    sums = df.groupBy(*key, group).agg(F.min(order).alias("first_at"), F.sum(size).alias("size"))
    before = Window.partitionBy(*key).orderBy("first_at").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def histogram(df: DataFrame, value: str, n_classes: int) -> DataFrame:
    """Rows of every class 0 to ``n_classes`` - 1, zeros too; fails on another value."""
    spark = df.sparkSession
    if not df.where((F.col(value) < 0) | (F.col(value) >= n_classes)).isEmpty():
        raise ValueError(f"{value} outside 0 to {n_classes - 1}")
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return spark.range(n_classes).select(F.col("id").alias(value)).join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def two_level_mean(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """The mean, by ``outer``, of the means by ``outer`` and ``inner``."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("__m")).groupBy(*outer).agg(F.avg("__m").alias(value))


def closure(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """``child, ancestor, depth`` of a taxonomy's ``edges(child, parent)``; the least depth of each pair."""
    spark = edges.sparkSession
    from corvane.session import written

    step = edges.select("child", "parent").distinct()
    found = frontier = written(step.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "closure")
    for depth in range(2, max_rounds + 2):
        reached = frontier.join(step.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        frontier = written(reached.join(found, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier), "closure")
    raise RuntimeError(f"deeper than {max_rounds} levels or a cycle of new pairs")


def longest_suffix(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """For each ``key`` the longest ``table_key`` that is a dotted suffix of it, as an equi-join on every suffix."""
    parts = F.split(key, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probes = df.select(key, F.posexplode(suffixes).alias("__at", table_key))
    hit = probes.join(table.select(table_key).distinct(), table_key)
    return hit.groupBy(key).agg(F.min_by(table_key, "__at").alias(table_key))
