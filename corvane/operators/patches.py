"""Patches of volumes: windows merged under a Gaussian weight, and seeded plans of size, scale and place."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.geometry import fitting_side, patch_start, window_starts
from corvane.operators.sampling import toss, uniform
from corvane.session import dealt

#: Width of the Gaussian as a share of a tile's side, its height, and the least weight (the smallest half-precision number).
SIGMA, HEIGHT, LEAST = 1 / 8, 10.0, 2.0**-24


def gaussian_weight(places: list[Column], tile: list[int], sigma: float = SIGMA, height: float = HEIGHT) -> Column:
    """The weight of a cell at 0-based ``places`` in a tile: a separable Gaussian round the middle cell, never below ``LEAST``."""
    power = sum((F.pow((x - n // 2) / F.lit(sigma * n), F.lit(2.0)) for x, n in zip(places, tile, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(height) * F.exp(power * -0.5), F.lit(LEAST))


def spread_volumes(volumes: DataFrame, key: list[str], sizes: list[str]) -> DataFrame:
    """``volumes`` by key in as many tasks as their cells ask for; what is grouped by key and cell from there on stays where it is.

    A small table of volumes is one file and so one task, however many cells it holds.
    """
    cells = volumes.agg(F.sum(reduce(lambda a, b: a * b, (F.col(s).cast("long") for s in sizes)))).first()[0]
    return dealt(volumes, cells or 0, *key)


def window_cells(volumes: DataFrame, sizes: list[str], tile: list[int], axes: list[str]) -> DataFrame:
    """``volumes`` with a row for each cell of each half-overlapping window: ``window`` (in order), ``axes`` (places in the volume) and ``in_<axis>`` (in the window); cells beyond a small volume's edge are left out."""
    out = volumes
    for size, crop, axis in zip(sizes, tile, axes, strict=True):
        out = out.withColumn(f"__{axis}", F.explode(window_starts(F.col(size), crop) if crop > 1 else F.sequence(F.lit(0), F.col(size).cast("int") - 1)))
    out = out.withColumn("window", F.struct(*(F.col(f"__{a}").alias(a) for a in axes)))
    for size, crop, axis in zip(sizes, tile, axes, strict=True):
        out = out.withColumn(f"in_{axis}", F.explode(F.sequence(F.lit(0), F.least(F.lit(crop), F.col(size).cast("int")) - 1))).withColumn(axis, F.col(f"__{axis}") + F.col(f"in_{axis}"))
    return out.drop(*(f"__{a}" for a in axes))


def merged(cells: DataFrame, key: list[str], axes: list[str], value: Column, weight: Column, threshold: float = 0.5) -> DataFrame:
    """``key, axes``, the weighted mean ``value`` of each cell over the windows that hold it, and whether it is ``set``: one shuffle of partial sums."""
    sums = cells.groupBy(*key, *axes).agg(F.sum(value * weight).alias("__v"), F.sum(weight).alias("__w"))
    mean = F.try_divide(F.col("__v"), F.col("__w"))
    return sums.select(*key, *axes, mean.alias("value"), (mean > threshold).alias("set"))


def normal(seed: int | str, *keys: Column) -> Column:
    """A standard normal draw from two keyed uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(f"{seed}-a", *keys))) * F.cos(2 * math.pi * uniform(f"{seed}-b", *keys))


def between(low: Column, high: Column, seed: int | str, *keys: Column) -> Column:
    """A keyed draw between two bounds."""
    return low + (high - low) * uniform(seed, *keys)


def patch_plan(
    volumes: DataFrame, key: Column, size: tuple[str, str, str], spacing: tuple[str, str, str], seed: int, most_tokens: int = 36, most_tokens_flat: int = 49, most_depth: int = 4, side: int = 16, depth_bits: int = 4,
    full: float = 0.2, scale_xy: tuple[float, float] = (0.8, 1.6), scale_xy_p: float = 0.5, scale_z: tuple[float, float] = (0.8, 1.6), scale_z_p: float = 0.5, ratio: tuple[float, float] = (0.5, 3.0), spread: float = 0.3,
) -> DataFrame:
    """``volumes`` with the plan of one patch each: ``depth_patch`` (slices of a token), ``patch_z, patch_y, patch_x`` (cells of the input) and ``scale_z, scale_xy``.

    A flat volume, and by a toss of ``full`` any other, is taken whole: scaled to the token
    budget. Else the plane's scale is drawn from its range as far as the volume allows (1
    without a toss of ``scale_xy_p``, the volume's own bound where that is below the range),
    the slices' spacing is held in ``ratio`` of the plane's and drawn inside that, and a
    token's depth is a power of two drawn round the ratio of both. Draws follow from seed and key.
    """
    z, y, x = (F.col(s).cast("double") for s in size)
    dz, dy, dx = (F.col(s).cast("double") for s in spacing)
    one = F.lit(1.0)
    flat = z == 1
    whole = flat | toss(full, f"{seed}-full", key)
    deep = z > most_depth
    power = lambda mean, name: F.least(F.greatest(F.rint(mean + spread * normal(f"{seed}-{name}", key)), F.lit(0.0)), F.lit(float(depth_bits)))
    step = F.when(deep, F.pow(F.lit(2.0), power(F.log2(z / most_depth), "deep"))).otherwise(one)
    tokens_z = F.when(whole & deep, F.least(F.ceil(z / step), F.lit(most_depth))).otherwise(F.least(z, F.lit(float(most_depth)))).cast("long")
    budget = F.when(flat, F.lit(most_tokens_flat)).otherwise(F.floor(F.lit(most_tokens) / tokens_z)).cast("long")
    out = volumes.withColumns({"__whole": whole, "__step": step, "__tz": tokens_z, "__budget": budget})
    budget, tokens_z, whole = F.col("__budget"), F.col("__tz"), F.col("__whole")
    short, long = F.least(y, x), F.greatest(y, x)
    fit = fitting_side(budget, long / short)  # tokens along the shorter side when the whole plane is to fit
    bound = short / (F.greatest(fit, F.lit(1)) * side)
    low = F.lit(scale_xy[0])
    high = F.least(bound, F.lit(scale_xy[1]))
    drawn = F.when(high <= low, high).when(toss(scale_xy_p, f"{seed}-xy?", key), between(low, high, f"{seed}-xy", key)).otherwise(one)
    out = out.withColumn("scale_xy", F.when(whole, bound).otherwise(drawn))
    plane = F.least(dy, dx) * F.col("scale_xy")
    held = F.greatest(dz, ratio[0] * plane)
    turned = between(F.greatest(F.lit(scale_z[0]), ratio[0] * plane / held), F.least(F.lit(scale_z[1]), ratio[1] * plane / held), f"{seed}-z", key)
    space = F.when((held < ratio[1] * plane) & toss(scale_z_p, f"{seed}-z?", key), held * turned).otherwise(held)
    out = out.withColumn("__space", space)
    thick = F.pow(F.lit(2.0), power(F.log2(F.pow(F.lit(2.0), F.lit(float(depth_bits))) * plane / F.col("__space")), "thick"))
    out = out.withColumn("depth_patch", F.when(whole, F.col("__step")).otherwise(thick).cast("int"))
    out = out.withColumn("patch_z", (tokens_z * F.col("depth_patch")).cast("int"))
    out = out.withColumn("scale_z", F.when(whole, z / F.col("patch_z")).otherwise(F.col("__space") / dz))
    tokens = lambda n: F.greatest(F.ceil(n / F.col("scale_xy") / side - 1e-9), F.lit(1))
    most = F.floor(F.sqrt(budget.cast("double")))
    small = F.least(tokens(short), most)
    large = F.when(tokens(short) > most, most).otherwise(F.least(F.floor(budget / small), tokens(long)))
    sides = {"patch_y": F.when(y <= x, small).otherwise(large), "patch_x": F.when(y <= x, large).otherwise(small)}
    return out.withColumns({n: (c * side).cast("int") for n, c in sides.items()}).drop("__whole", "__step", "__tz", "__budget", "__space")


def drawn_centres(plans: DataFrame, cells: DataFrame, key: str, axes: list[str], size: list[str], patch: list[str], seed: int, forced: float = 0.5, weight: Column | None = None) -> DataFrame:
    """``plans`` with ``on_cell`` and ``start_<axis>``: where each patch begins, kept inside the volume.

    By a toss of ``forced`` the centre is one of the volume's foreground ``cells``, drawn
    in proportion to ``weight`` (all alike without one) as the least of their keyed
    exponential draws, a grouped minimum that no task need hold the cells for; else, and
    without such cells, it is drawn from the whole volume.
    """
    clock = -F.log(1 - uniform(f"{seed}-cell", F.col(key), *(F.col(a) for a in axes))) / (F.lit(1.0) if weight is None else weight)
    found = cells.groupBy(key).agg(F.min(F.struct(clock.alias("clock"), *(F.col(a).cast("int").alias(a) for a in axes))).alias("__cell"))
    out = plans.join(found, key, "left").withColumn("on_cell", F.col("__cell").isNotNull() & toss(forced, f"{seed}-forced", F.col(key)))
    for a, n, p in zip(axes, size, patch, strict=True):
        anywhere = F.floor(F.col(n) * uniform(f"{seed}-{a}", F.col(key))).cast("int")
        centre = F.when(F.col("on_cell"), F.col("__cell")[a]).otherwise(anywhere)
        out = out.withColumn(f"start_{a}", patch_start(centre, F.least(F.col(p), F.col(n)), F.col(n)))
    return out.drop("__cell")
