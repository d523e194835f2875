"""Contours to cells: polygons filled by the even-odd rule, slice by slice, in expressions, or as runs of cells where raters vote."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import first_of


def cells_of(contours: DataFrame, key: list[str], points: str) -> DataFrame:
    """``key, x, y``: the cells inside an odd number of the polygons (arrays of ``x, y``) of each key, so a contour inside another is a hole.

    A cell is inside if a ray from its centre to the left crosses the polygon an odd number
    of times; an edge crosses a row if just one of its ends lies above it, so a corner on a
    row counts once and level edges never. A cell centre on a left edge is inside, on a
    right one not. A polygon becomes rows, a row its crossings, a pair of those a run of
    cells, each step a row generator of its own.
    """
    corner = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    rings = contours.where(F.size(points) > 2).select(*key, F.transform(points, corner).alias("__p"))
    ys = F.transform("__p", lambda p: p["y"])
    rows = rings.select(*key, "__p", F.explode(F.sequence(F.ceil(F.array_min(ys)).cast("int"), F.greatest(F.ceil(F.array_max(ys)).cast("int"), F.ceil(F.array_min(ys)).cast("int")))).alias("y"))
    y = F.col("y")
    edges = F.arrays_zip(F.col("__p").alias("a"), F.concat(F.slice("__p", 2, F.size("__p")), F.slice("__p", 1, 1)).alias("b"))
    crossed = F.filter(edges, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    cuts = F.array_sort(F.transform(crossed, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    cut = rows.select(*key, "y", cuts.alias("__c")).where("size(__c) > 0")
    at = lambda k: F.ceil(F.element_at("__c", k)).cast("int")
    runs = cut.select(*key, "y", F.explode(F.transform(F.sequence(F.lit(1), F.size("__c"), F.lit(2)), lambda k: F.struct(at(k).alias("first"), (at(k + 1) - 1).alias("last")))).alias("__r")).where("__r.first <= __r.last")
    spread = runs.select(*key, "y", F.explode(F.sequence("__r.first", "__r.last")).alias("x"))
    return spread.groupBy(*key, "x", "y").agg(F.count("*").alias("__n")).where("__n % 2 = 1").drop("__n")


def slices_once(slices: DataFrame, scan: str, z: str, number: str) -> DataFrame:
    """One slice for each place of a scan: of several at one ``z`` the one of the least ``number``."""
    return first_of(slices, [scan, z], [F.col(number)])


def _marks(g: np.ndarray, y: np.ndarray, x: np.ndarray, *within: np.ndarray) -> np.ndarray:
    """The order of marks by group, ``within`` and row, then place."""
    return np.lexsort((x, y, *within, g))


def _shared_runs(of: np.ndarray, rater: np.ndarray, xs: np.ndarray, ys: np.ndarray, ends: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, row, first and last place, and votes of each run of cells that at least ``needed[group]`` raters drew; a ring is a run of points, ``of`` and ``rater`` its group and rater.

    A row is crossed where a ring's edge passes it, and a cell is inside behind an odd
    number of its rater's crossings, so those in order are runs' beginnings and ends. Runs
    of all raters in order, up at a beginning and down behind an end, count the votes.
    """
    sizes = np.diff(ends)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(1, len(xs) + 1)
    after[ends[1:] - 1] = ends[:-1]
    bx, by = xs[after], ys[after]
    low, high = np.minimum(ys, by), np.maximum(ys, by)
    with np.errstate(invalid="ignore"):
        real = np.isfinite(low + high + xs + bx)
        first = np.where(real, np.ceil(low), 0).astype(np.int64)
        rows = np.where(real, np.ceil(high), 0).astype(np.int64) - first
    e = np.repeat(np.arange(len(rows)), rows)
    y = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(rows) - rows, rows)
    x = np.ceil(xs[e] + (y - ys[e]) * (bx[e] - xs[e]) / (by[e] - ys[e])).astype(np.int64)
    g, r = of[ring[e]], rater[ring[e]]
    order = _marks(g, y, x, r)  # a ring crosses a row an even number of times, so a rater's crossings of a row pair up
    g, y, x = g[order], y[order], x[order]
    up = np.where(np.arange(len(x)) % 2 == 0, 1, -1)
    order = _marks(g, y, x)
    g, y, x, votes = g[order], y[order], x[order], np.cumsum(up[order])
    n = len(x)
    follows = np.zeros(n, bool)
    follows[:-1] = (g[1:] == g[:-1]) & (y[1:] == y[:-1]) & (x[1:] > x[:-1])
    keep = np.flatnonzero(follows & (votes > 0))
    keep = keep[votes[keep] >= needed[g[keep]]]
    return g[keep], y[keep], x[keep], x[keep + 1] - 1, votes[keep]


def consensus_runs(contours: DataFrame, lesion: list[str], rater: str, z: str, points: str, most_raters: int = 4, share: float = 0.5) -> DataFrame:
    """``lesion, z, y, first, last, share``: the cells of ``consensus_of`` as runs along x.

    A lesion's contours of one slice come together, as points; their cells are never rows.
    """
    raters = contours.groupBy(*lesion).agg(F.countDistinct(rater).alias("__raters")).where(F.col("__raters") <= most_raters)
    ring = F.struct(F.col(rater).alias("r"), F.transform(points, lambda p: p["x"].cast("double")).alias("x"), F.transform(points, lambda p: p["y"].cast("double")).alias("y"))
    drawn = contours.where(F.size(points) > 2).select(*lesion, z, ring.alias("__c"))
    held = drawn.join(raters, lesion).groupBy(*lesion, z).agg(F.max("__raters").alias("__raters"), F.collect_list("__c").alias("__c"))
    types = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__c")
            flat, offsets = column.values, column.offsets.to_numpy()
            if not len(flat):
                continue
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            who = flat.field("r").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            xs, ys = (flat.field(f).values.to_numpy(zero_copy_only=False) for f in ("x", "y"))
            n = batch.column("__raters").to_numpy()
            needed = np.array([next(k for k in range(1, most + 2) if k / max(most, 1) >= share or k > most) for most in range(most_raters + 1)])[n]
            g, y, first, last, votes = _shared_runs(of, who.astype(np.int64), xs, ys, flat.field("x").offsets.to_numpy(), needed)
            names = [*lesion, z]
            made = [pa.array(y.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(votes / np.maximum(n[g], 1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(g)) for k in names), *made], names=[*names, "y", "first", "last", "share"])

    return held.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in (*lesion, z)), "y int, first int, last int, share double"]))


def consensus_of(contours: DataFrame, lesion: list[str], rater: str, z: str, points: str, most_raters: int = 4, share: float = 0.5) -> DataFrame:
    """``lesion, z, x, y`` of the cells that at least ``share`` of a lesion's raters drew; lesions of more than ``most_raters`` are left out.

    ``rater`` counts where it drew any contour, even one that holds no cell.
    """
    runs = consensus_runs(contours, lesion, rater, z, points, most_raters, share)
    return runs.select(*lesion, z, F.explode(F.sequence("first", "last")).alias("x"), "y", "share")
