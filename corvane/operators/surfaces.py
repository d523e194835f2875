"""Surface distances of masks: surface cells and their areas by expressions, distances by an exact transform.

A mask is rows of cells. Each corner point of the grid has eight cells round it; which of
them are set is its code. Cells meet in blocks of ``BLOCK`` corners a side, each with the
layer of cells before it, so codes of masks of any size come from groups of bounded size. A
corner whose code is neither empty nor full lies on the surface; the area that the surface
has there follows from the code by geometry. Of each case only surface corners, some power
2/3 of its cells, come together in one task, where an exact Euclidean distance transform of
their box gives each the distance to the other surface; small boxes of one shape go at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corners along a block's side, places of the boxes whose codes are set at once, and of a box that is scored with others of its shape.
BLOCK, PLACES_AT_ONCE, SMALL_BOX = 32, 1 << 22, 1 << 13
#: How far a share of the area may stay below the one asked for, by rounding.
SLACK = 1e-12

_CORNERS = list(product((0, 1), repeat=3))


def _loops(code: int) -> list[list[tuple[float, float, float]]]:
    """The polygons that part the set corners of a unit cube from the others, through the middles of its edges.

    On a face with two opposite set corners each of them is cut off by itself.
    """
    on = {c: bool(code >> k & 1) for k, c in enumerate(_CORNERS)}
    links: dict[tuple, list[tuple]] = {}
    for axis, side in product(range(3), (0, 1)):
        a, b = (x for x in range(3) if x != axis)
        at = lambda u, v: tuple({axis: side, a: u, b: v}[k] for k in range(3))  # noqa: B023, E731
        ring = [at(0, 0), at(0, 1), at(1, 1), at(1, 0)]
        cut = [tuple((p + q) / 2 for p, q in zip(x, y, strict=True)) if on[x] != on[y] else None for x, y in zip(ring, ring[1:] + ring[:1], strict=True)]
        ends = [c for c in cut if c is not None]
        pairs = [tuple(ends)] if len(ends) == 2 else [(cut[k - 1], cut[k]) for k in range(4) if on[ring[k]]] if ends else []
        for x, y in pairs:
            links.setdefault(x, []).append(y)
            links.setdefault(y, []).append(x)
    out = []
    while links:
        start = at = min(links)
        loop, before = [start], None
        while True:
            step = [x for x in links[at] if x != before]
            before, at = at, step[0] if step else links[at][0]
            if at == start:
                break
            loop.append(at)
        out.append(loop)
        for x in loop:
            del links[x]
    return out


@cache
def surface_areas(spacing: tuple[float, float, float]) -> tuple[float, ...]:
    """The area of the surface at a corner by its code (bit ``4i + 2j + k`` for the cell on side i, j, k of it); polygons are parted into triangles from their first point."""
    out = []
    for code in range(256):
        total = 0.0
        for loop in _loops(code):
            points = np.array(loop) * np.array(spacing)
            total += sum(float(np.linalg.norm(np.cross(p - points[0], q - points[0]))) / 2 for p, q in zip(points[1:], points[2:], strict=False))
        out.append(total)
    return tuple(out)


def _envelope(f: np.ndarray, step: float) -> np.ndarray:
    """Of each line, ``min over j of f[j] + (step * (i - j)) ** 2`` at every place i, by the lower envelope of its parabolas; all lines at once."""
    lines, n = f.shape
    rows = np.arange(lines)
    place = np.zeros((lines, n), np.int64)
    border = np.full((lines, n + 1), np.inf)
    top = np.full(lines, -1)
    for q in range(n):
        live = rows[np.isfinite(f[:, q])]
        cut = np.full(lines, -np.inf)
        open_ = live[top[live] >= 0]
        while len(open_):
            p = place[open_, top[open_]]
            cut[open_] = ((f[open_, q] + (step * q) ** 2) - (f[open_, p] + (step * p) ** 2)) / (2 * step**2 * (q - p))
            out = open_[cut[open_] <= border[open_, top[open_]]]
            top[out] -= 1
            open_ = out[top[out] >= 0]
            cut[out[top[out] < 0]] = -np.inf
        top[live] += 1
        place[live, top[live]] = q
        border[live, top[live]] = cut[live]
        border[live, top[live] + 1] = np.inf
    out = np.full((lines, n), np.inf)
    at, held = np.zeros(lines, np.int64), top >= 0
    for i in range(n):
        while len(move := rows[held & (border[rows, at + 1] < i)]):
            at[move] += 1
        p = place[rows, at]
        out[held, i] = (f[rows, p] + (step * (i - p)) ** 2)[held]
    return out


def distance_transform(points: np.ndarray, spacing: tuple[float, ...]) -> np.ndarray:
    """The distance of every cell to the nearest set one, exact; infinite if none is."""
    f = np.where(points, 0.0, np.inf)
    for axis, step in enumerate(spacing):
        moved = np.moveaxis(f, axis, -1)
        f = np.moveaxis(_envelope(moved.reshape(-1, moved.shape[-1]), step).reshape(moved.shape), -1, axis)
    return np.sqrt(f)


def surface_corners(cells: DataFrame, key: list[str], axes: list[str], masks: list[str]) -> DataFrame:
    """``key, axes`` and a code for each of two boolean ``masks`` of every corner where one of them has a surface; of repeated cells one set mark counts."""
    c = F.explode("corners").alias("c")
    at = lambda k: (F.col(f"__b{k}") * BLOCK + F.shiftright("c", 26 - 5 * k).bitwiseAND(BLOCK - 1)).cast("int")
    code = lambda k: F.shiftright("c", 8 - 8 * k).bitwiseAND(255).cast("int")
    return _block_corners(cells, key, axes, masks).select(*key, "__b0", "__b1", "__b2", c).select(*key, *(at(k).alias(x) for k, x in enumerate(axes)), *(code(k).alias(m) for k, m in enumerate(masks)))


def _block_corners(cells: DataFrame, key: list[str], axes: list[str], masks: list[str]) -> DataFrame:
    """``key, __b0, __b1, __b2, corners``: of each block its surface corners, a corner's three places in the block (five bits each) and two codes (eight bits each) as one number.

    A cell goes to the blocks of the corners on both of its sides, mostly one.
    """
    on = [F.coalesce(F.col(m), F.lit(False)).cast("int") for m in masks]
    rows = cells.select(*key, *(F.col(x).cast("int").alias(f"__a{k}") for k, x in enumerate(axes)), (on[0] * 2 + on[1]).alias("__m")).where("__m > 0")
    for k in range(3):
        rows = rows.withColumn(f"__b{k}", F.explode(F.sequence(F.floor(F.col(f"__a{k}") / BLOCK).cast("int"), F.floor((F.col(f"__a{k}") + 1) / BLOCK).cast("int"))))
    local = [F.col(f"__a{k}") - F.col(f"__b{k}") * BLOCK + 1 for k in range(3)]
    packed = ((local[0] * 64 + local[1]) * 64 + local[2]) * 4 + F.col("__m")
    block = ["__b0", "__b1", "__b2"]
    held = rows.groupBy(*key, *block).agg(F.collect_set(packed).alias("__c"))
    types = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__c")
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            n, out = [], []
            for a, b in _runs(offsets):
                counts, corners = _coded(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n.append(counts)
                out.append(corners)
            ends = np.concatenate([[0], *n]).cumsum().astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*key, *block)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*key, *block, "corners"])

    return held.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in (*key, *block)), "corners array<long>"])).where("size(corners) > 0")


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of groups whose boxes, at most ``BLOCK + 2`` a side, hold some ``PLACES_AT_ONCE`` places together."""
    most = max(1, PLACES_AT_ONCE // (BLOCK + 2) ** 3)
    for a in range(0, len(offsets) - 1, most):
        yield a, min(a + most, len(offsets) - 1)


def _coded(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many surface corners each block has, and these as numbers; a block is a run of packed cells."""
    groups = len(offsets) - 1
    owner = np.repeat(np.arange(groups), np.diff(offsets))
    place = [(values >> s) & 63 for s in (14, 8, 2)]
    low = [np.minimum.reduceat(p, offsets[:-1]) for p in place]
    side = [np.maximum.reduceat(p, offsets[:-1]) - a + 2 for p, a in zip(place, low, strict=True)]
    base = np.concatenate([[0], np.cumsum(side[0] * side[1] * side[2])])
    step = [side[1] * side[2], side[2], np.ones(groups, np.int64)]
    flat = base[owner] + sum((p - a[owner]) * s[owner] for p, a, s in zip(place, low, step, strict=True))
    codes = []
    for bit in (2, 1):
        held = np.zeros(base[-1], bool)
        held[flat[(values & bit) > 0]] = True
        at = np.flatnonzero(held)
        of = np.searchsorted(base, at, "right") - 1
        code = np.zeros(base[-1], np.uint8)
        for k, c in enumerate(_CORNERS):  # a cell on side d of a corner lies at the corner's place - 1 + d
            code[at + sum((1 - d) * s[of] for d, s in zip(c, step, strict=True))] |= np.uint8(1 << k)
        codes.append(code)
    at = np.flatnonzero(((codes[0] > 0) & (codes[0] < 255)) | ((codes[1] > 0) & (codes[1] < 255)))
    of = np.searchsorted(base, at, "right") - 1
    rest, corner = at - base[of], []
    for s, a in zip(step, low, strict=True):
        corner.append(rest // s[of] + a[of] - 1)
        rest = rest % s[of]
    own = np.all([(c >= 0) & (c < BLOCK) for c in corner], axis=0)
    made = (((corner[0] * BLOCK + corner[1]) * BLOCK + corner[2]) << 16) | (codes[0][at].astype(np.int64) << 8) | codes[1][at]
    return np.bincount(of[own], minlength=groups), made[own].astype(np.int64)


def surface_scores(cells: DataFrame, key: list[str], axes: list[str], truth: str, found: str, spacing: tuple[float, float, float], tolerance: float, percent: float = 95.0) -> DataFrame:
    """Of each case with a set cell: ``surface_dice`` (NSD), ``hausdorff`` (the larger of both ways' distances below which ``percent`` of the
    area lies), ``truth_overlap`` and ``found_overlap`` (the share of a surface's area within ``tolerance`` of the other).

    Infinite Hausdorff distance and a zero share where only one mask has a surface; the share of a missing surface is NaN.
    """
    areas = np.array(surface_areas(tuple(map(float, spacing))))
    names = ["surface_dice", "hausdorff", "truth_overlap", "found_overlap"]
    blocks = _block_corners(cells, key, axes, [truth, found])
    types = dict(blocks.dtypes)
    packed = blocks.groupBy(*key).agg(F.collect_list(F.struct("__b0", "__b1", "__b2", "corners")).alias("__g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("__g")
            flat = column.values
            held = flat.field("corners")
            ends, values = held.offsets.to_numpy(), held.values.to_numpy()
            per_block = np.diff(ends)
            of = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy())), per_block)
            at = [np.repeat(flat.field(f"__b{k}").to_numpy().astype(np.int64), per_block) * BLOCK + (values >> (26 - 5 * k)) % BLOCK for k in range(3)]
            scores = _scored(of, at, [(values >> 8) & 255, values & 255], batch.num_rows, areas, spacing, tolerance, percent)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *(pa.array(scores[:, k]) for k in range(4))], names=[*key, *names])

    return packed.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in key), *(f"{n} double" for n in names)]))


def _scored(of: np.ndarray, at: list[np.ndarray], codes: list[np.ndarray], groups: int, areas: np.ndarray, spacing: tuple[float, float, float], tolerance: float, percent: float) -> np.ndarray:
    """The four scores of each group; ``of`` is the group of each corner, in order, ``at`` its places and ``codes`` its two codes. Boxes of like sides, rounded up, make one array."""
    bounds = np.searchsorted(of, np.arange(groups + 1))
    low = [np.minimum.reduceat(a, bounds[:-1]) for a in at]
    side = np.stack([np.maximum.reduceat(a, bounds[:-1]) - b + 1 for a, b in zip(at, low, strict=True)], axis=1)
    shape = np.where(np.prod(side, axis=1, keepdims=True) <= SMALL_BOX, -(-side // 4) * 4, side)
    kinds, kind = np.unique(shape, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    ends = np.searchsorted(kind.ravel()[order], np.arange(len(kinds) + 1))
    out = np.empty((groups, 4))
    local = np.stack([a - b[of] for a, b in zip(at, low, strict=True)])
    for box, a, b in zip(kinds, ends, ends[1:], strict=False):
        volume = int(np.prod(box))
        step = max(1, (PLACES_AT_ONCE >> 4) // volume) if volume <= SMALL_BOX else 1
        for which in (order[k : min(k + step, b)] for k in range(a, b, step)):
            sizes = bounds[which + 1] - bounds[which]
            rows = np.repeat(bounds[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            spot = (np.repeat(np.arange(len(which)), sizes), *local[:, rows])
            out[which] = _box_scores(spot, [c[rows] for c in codes], (len(which), *map(int, box)), areas, spacing, tolerance, percent)
    return out


def _box_scores(spot: tuple[np.ndarray, ...], codes: list[np.ndarray], shape: tuple[int, ...], areas: np.ndarray, spacing: tuple[float, float, float], tolerance: float, percent: float) -> np.ndarray:
    groups = shape[0]
    edges = [(c > 0) & (c < 255) for c in codes]
    near, whole, far = [], [], []
    for own, other, code in ((edges[0], edges[1], codes[0]), (edges[1], edges[0], codes[1])):
        grid = np.zeros(shape, bool)
        grid[tuple(s[other] for s in spot)] = True
        mine = tuple(s[own] for s in spot)
        d, area, of = _distances(grid, spacing)[mine], areas[code[own]], mine[0]
        order = np.lexsort((area, d, of))
        d, area, of = d[order], area[order], of[order]
        first = np.searchsorted(of, np.arange(groups + 1))
        place = np.arange(len(of)) - first[of]
        run = np.zeros((groups, int(np.diff(first).max(initial=0)) + 1))
        run[of, place + 1] = area
        run = np.cumsum(run, axis=1)  # each group by itself, so that no other's rounding enters
        total = run[:, -1]
        reached = np.argmax(run[:, 1:] >= (percent / 100 - SLACK) * total[:, None], axis=1) if run.shape[1] > 1 else np.zeros(groups, np.int64)
        some = np.diff(first) > 0
        way = np.full(groups, np.inf)
        way[some] = d[first[:-1][some] + np.minimum(reached, np.diff(first) - 1)[some]]
        far.append(way)
        whole.append(total)
        near.append(np.bincount(of[d <= tolerance], area[d <= tolerance], groups))
    with np.errstate(invalid="ignore"):
        return np.stack([(near[0] + near[1]) / (whole[0] + whole[1]), np.maximum(*far), near[0] / whole[0], near[1] / whole[1]], axis=1)


def _distances(grid: np.ndarray, spacing: tuple[float, float, float]) -> np.ndarray:
    """The distance of every place to the nearest set one of its box; small boxes try every shift along each axis, which many of them share."""
    if grid[0].size > SMALL_BOX:
        return np.stack([distance_transform(g, spacing) if g.any() else np.full(g.shape, np.inf) for g in grid])
    f = np.where(grid, 0.0, np.inf)
    for axis, step in enumerate(spacing, 1):
        f = np.moveaxis(f, axis, 0)
        low = f.copy()
        for k in range(1, len(f)):
            np.minimum(low[k:], f[:-k] + (step * k) ** 2, out=low[k:])
            np.minimum(low[:-k], f[k:] + (step * k) ** 2, out=low[:-k])
        f = np.moveaxis(low, 0, axis)
    return np.sqrt(f)


def areas_of(code: Column, spacing: tuple[float, float, float]) -> Column:
    """The surface area of a code as an expression."""
    return F.get(F.array(*(F.lit(a) for a in surface_areas(tuple(map(float, spacing))))), code)
