"""Boxes: overlap joins on a grid, clusters of raters, suppression and assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geometry import EPSILON, box, half_even, iou
from corvane.operators.components import components_in_groups
from corvane.session import spread

CORNERS = ["x1", "y1", "x2", "y2"]
#: Rows of a group that is done with others of its size, and pairs of rows that are compared at once.
SMALL_GROUP, PAIRS_AT_ONCE = 32, 1 << 20


def per_group(df: DataFrame, group: list[str], fields: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, single: Callable[[Column], dict[str, Column]] | None = None, many: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]] | None = None) -> DataFrame:
    """``fn`` over each group's fields as numpy arrays, rows sorted by the fields; its arrays (of ``schema``) with the group's key.

    Groups come many to an Arrow batch, so small ones cost little; a group is one image
    and class, whose boxes are few. ``single`` gives the columns of a group of one row;
    ``many`` takes the fields of all groups of a batch and where each begins, and returns
    which groups it has done, with the group of each of its rows and their columns.
    """
    types = dict(df.dtypes)
    packed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__g"))
    alone = None
    if single is not None:  # a group of one needs no Python
        alone = packed.where("size(__g) = 1").select(*group, *(value.alias(n) for n, value in single(F.col("__g")[0]).items()))
        packed = packed.where("size(__g) > 1")
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__g")
            flat, offsets = column.values, column.offsets.to_numpy()
            arrays = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in fields}
            left = np.arange(batch.num_rows)
            if many is not None and len(left):
                done, owner, rows = many(arrays, offsets)
                left = np.flatnonzero(~done)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(owner)) for k in group), *(pa.array(rows[n]) for n in names)], names=[*group, *names])
            made = [fn({f: v[offsets[k] : offsets[k + 1]] for f, v in arrays.items()}) for k in left]
            if made:
                owner = pa.array(np.repeat(left, [len(m[names[0]]) for m in made]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in group), *(pa.array(np.concatenate([m[n] for m in made])) for n in names)], names=[*group, *names])

    made = packed.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in group), schema]))
    return made if alone is None else made.unionByName(alone.select(*(F.col(n).cast(t).alias(n) for n, t in made.dtypes)))


def overlapping(left: DataFrame, right: DataFrame, key: list[str], cell: float, rows: int | None = None) -> DataFrame:
    """Pairs of boxes of one key whose closed boxes meet: columns of both, the right's led by ``o_``.

    Each box goes to the grid cells it touches; cells are an equi-join key, and a pair is
    kept in the one cell where the later of the two least corners lies, so it comes once.
    With ``rows``, the boxes of a side, the number of tasks of the join follows from them.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
    placed = left.withColumn("__gx", F.explode(cells("x1", "x2"))).withColumn("__gy", F.explode(cells("y1", "y2")))
    others = right.select(*key, *(F.col(c).alias(f"o_{c}") for c in right.columns if c not in key))
    placed_o = others.withColumn("__gx", F.explode(cells("o_x1", "o_x2"))).withColumn("__gy", F.explode(cells("o_y1", "o_y2")))
    at = [*key, "__gx", "__gy"]
    pairs = spread(placed, rows, *at).join(spread(placed_o, rows, *at), at)
    meet = (F.col("x1") <= F.col("o_x2")) & (F.col("o_x1") <= F.col("x2")) & (F.col("y1") <= F.col("o_y2")) & (F.col("o_y1") <= F.col("y2"))
    once = (F.floor(F.greatest("x1", "o_x1") / cell) == F.col("__gx")) & (F.floor(F.greatest("y1", "o_y1") / cell) == F.col("__gy"))
    return pairs.where(meet & once).drop("__gx", "__gy")


def agreeing_pairs(boxes: DataFrame, key: list[str], ident: str, rater: str, threshold: float, same_rater: bool = False, cell: float = 32.0, n_rows: int | None = None) -> DataFrame:
    """Pairs of boxes of one key by different raters (or by the same) whose IoU reaches ``threshold``, above 0: ``src, dst, iou``.

    Such boxes meet, so the pairs come from the grid of ``cell``.
    """
    rows = boxes.select(*key, F.col(ident).alias("src"), F.col(rater).alias("rater"), *CORNERS)
    pairs = overlapping(rows, rows, [*key, "rater"] if same_rater else key, cell, n_rows).where("src < o_src")
    if not same_rater:
        pairs = pairs.where("rater <> o_rater")
    return pairs.select(*key, "src", F.col("o_src").alias("dst"), iou(box(), box("o_")).alias("iou")).where(F.col("iou") >= threshold)


def clustered(boxes: DataFrame, key: list[str], ident: str, pairs: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``boxes`` with ``cluster``, the least ident that ``pairs(key, src, dst)`` reach; a box without a pair is its own.

    With ``n_rows``, the number of boxes, they lie by key and cluster in tasks that follow from it.
    """
    labels = components_in_groups(pairs, key).select(F.col("node").alias(ident), F.col("component").alias("__cluster"))
    joined = spread(boxes, n_rows, ident).join(spread(labels, n_rows, ident), ident, "left").withColumn("cluster", F.coalesce("__cluster", ident)).drop("__cluster")
    return spread(joined, n_rows, *key, "cluster")


def mean_boxes(boxes: DataFrame, key: list[str], ident: str, rater: str, threshold: float, n_rows: int | None = None) -> DataFrame:
    """Boxes of agreeing raters merged: the mean box and size of each cluster; with ``n_rows``, the number of boxes, in tasks that follow from it."""
    joined = clustered(boxes, key, ident, agreeing_pairs(boxes, key, ident, rater, threshold, n_rows=n_rows), n_rows)
    return joined.groupBy(*key, "cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in CORNERS))


def without_repeats(boxes: DataFrame, key: list[str], ident: str, rater: str, threshold: float = 0.9, n_rows: int | None = None) -> DataFrame:
    """Boxes of one key and rater that nearly coincide, as one: the first one's ident and rater, the rounded mean box; ``n_rows`` as in ``mean_boxes``."""
    joined = clustered(boxes, key, ident, agreeing_pairs(boxes, key, ident, rater, threshold, same_rater=True, n_rows=n_rows), n_rows)
    return joined.groupBy(*key, F.col("cluster").alias(ident)).agg(F.min(rater).alias(rater), F.count("*").alias("n"), *(half_even(F.avg(c)).alias(c) for c in CORNERS))


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.prod(np.clip(high - low, 0, None), axis=2)
    area = lambda x: np.prod(x[:, 2:] - x[:, :2], axis=1)
    return shared / (area(a)[:, None] + area(b)[None] - shared + EPSILON)


def raters_clusters(boxes: np.ndarray, raters: np.ndarray, start: float = 0.25, step: float = 0.05) -> np.ndarray:
    """Cluster of each box: the IoU needed rises until no cluster has more boxes than there are raters."""
    n_raters, near = len(set(raters.tolist())), _iou_matrix(boxes, boxes)
    differ = raters[:, None] != raters[None]
    threshold = start
    while True:
        label = np.arange(len(boxes))
        linked = (near >= threshold) & differ
        while True:
            new = np.where(linked, label[None], len(boxes)).min(1, initial=len(boxes))
            new = np.minimum(label, new)
            if np.array_equal(new, label):
                break
            label = new
        if threshold >= 1 or np.bincount(label).max(initial=0) <= n_raters:
            return label
        threshold = round(threshold + step, 10)


def consensus_boxes(boxes: DataFrame, key: list[str], rater: str) -> DataFrame:
    """Mean boxes of ``raters_clusters`` by key, with the number of boxes of each."""

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        corners = np.stack([part[c] for c in CORNERS], axis=1).astype(float)
        _, label = np.unique(raters_clusters(corners, part[rater]), return_inverse=True)
        n = np.bincount(label)
        return {"n": n.astype(np.int64)} | {c: np.bincount(label, corners[:, k]) / n for k, c in enumerate(CORNERS)}

    def many(parts: dict[str, np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Groups of one size at a time; the threshold rises for those that still have too large a cluster."""
        sizes = np.diff(offsets)
        corners = np.stack([parts[c] for c in CORNERS], axis=1).astype(float)
        done = sizes <= SMALL_GROUP
        owner, out = [np.zeros(0, np.int64)], [np.zeros((0, 5))]
        for n in np.unique(sizes[done]):
            own = np.flatnonzero(sizes == n)
            step = max(1, PAIRS_AT_ONCE // int(n * n))
            for which in (own[k : k + step] for k in range(0, len(own), step)):
                at = offsets[which][:, None] + np.arange(n)
                label = _rising_labels(corners[at], parts[rater][at])
                flat = (np.arange(len(which))[:, None] * n + label).ravel()
                count = np.bincount(flat, minlength=len(which) * n)
                held = np.flatnonzero(count)
                sums = [np.bincount(flat, corners[at.ravel(), k], len(which) * n)[held] / count[held] for k in range(4)]
                owner.append(which[held // n])
                out.append(np.column_stack([count[held], *sums]))
        rows = np.concatenate(out)
        return done, np.concatenate(owner), {"n": rows[:, 0].astype(np.int64)} | {c: rows[:, k + 1] for k, c in enumerate(CORNERS)}

    one = lambda r: {"n": F.lit(1)} | {c: r[c] for c in CORNERS}
    return per_group(boxes, key, [*CORNERS, rater], run, "n long, " + ", ".join(f"{c} double" for c in CORNERS), one, many)


def _rising_labels(boxes: np.ndarray, raters: np.ndarray, start: float = 0.25, step: float = 0.05) -> np.ndarray:
    """``raters_clusters`` of many groups of one size: ``boxes`` is group x place x corner."""
    groups, n = raters.shape
    ordered = np.sort(raters, axis=1)
    most = 1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1)
    near = _overlaps(boxes)
    differ = raters[:, :, None] != raters[:, None, :]
    out, open_, threshold = np.zeros((groups, n), np.int64), np.arange(groups), start
    while len(open_):
        linked = (near[open_] >= threshold) & differ[open_]
        label = np.broadcast_to(np.arange(n), (len(open_), n))
        while True:
            new = np.minimum(label, np.where(linked, label[:, None, :], n).min(axis=2, initial=n))
            if np.array_equal(new, label):
                break
            label = new
        largest = (label[:, :, None] == label[:, None, :]).sum(axis=2).max(axis=1, initial=0)
        settled = (largest <= most[open_]) | (threshold >= 1)
        out[open_[settled]] = label[settled]
        open_ = open_[~settled]
        threshold = round(threshold + step, 10)
    return out


def _overlaps(b: np.ndarray) -> np.ndarray:
    """The IoU of every two boxes of each group of one size."""
    side = np.minimum(b[:, :, None, 2:], b[:, None, :, 2:]) - np.maximum(b[:, :, None, :2], b[:, None, :, :2])
    shared = np.prod(np.maximum(side, 0), axis=-1)
    area = np.prod(b[..., 2:] - b[..., :2], axis=-1)
    return shared / (area[:, :, None] + area[:, None, :] - shared + EPSILON)


def keep_best(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Places kept by greedy suppression, best first; ties keep the earlier."""
    order, kept = np.argsort(-scores, kind="stable"), []
    while len(order):
        best, rest = order[0], order[1:]
        kept.append(best)
        order = rest[_iou_matrix(boxes[best : best + 1], boxes[rest])[0] <= threshold]
    return np.array(kept, int)


def suppressed(detections: DataFrame, group: list[str], score: str, order: str, threshold: float = 0.7, before: int = 10_000, after: int = 100) -> DataFrame:
    """Detections left by class-aware suppression: of each group the ``before`` best enter, ``after`` at most stay.

    Equal scores are taken by ``order``, which is unique in a group; group, score, order and corners are returned.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(score), order)
    entered = detections.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= before)

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        kept = keep_best(np.stack([part[c] for c in CORNERS], axis=1).astype(float), part[score].astype(float), threshold)[:after]
        return {f: v[kept] for f, v in part.items()}

    def many(parts: dict[str, np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Groups of one size at a time: all their overlaps as one array, then place after place, in order of score."""
        sizes = np.diff(offsets)
        done, rows, owner = sizes <= SMALL_GROUP, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        corners = np.stack([parts[c] for c in CORNERS], axis=1).astype(float)
        for n in np.unique(sizes[done]):
            own = np.flatnonzero(sizes == n)
            for begin in range(0, len(own), max(1, PAIRS_AT_ONCE // int(n * n))):
                which = own[begin : begin + max(1, PAIRS_AT_ONCE // int(n * n))]
                at = offsets[which][:, None] + np.arange(n)
                near = _overlaps(corners[at]) > threshold
                kept = np.ones(at.shape, bool)
                for k in range(n - 1):
                    kept[:, k + 1 :] &= ~(kept[:, k : k + 1] & near[:, k, k + 1 :])
                kept &= np.cumsum(kept, axis=1) <= after
                rows.append(at[kept])
                owner.append(np.broadcast_to(which[:, None], at.shape)[kept])
        chosen = np.concatenate(rows)
        return done, np.concatenate(owner), {f: v[chosen] for f, v in parts.items()}

    types = dict(detections.dtypes)
    fields = ["__r", score, order, *CORNERS]
    return per_group(entered, group, fields, run, ", ".join(f"{f} {'int' if f == '__r' else types[f]}" for f in fields), lambda r: {f: r[f] for f in fields}, many).drop("__r")


def threshold_matches(pairs: DataFrame, query: str, truth: str, value: str, low: float, high: float) -> DataFrame:
    """Each query's best truth and its label: 1 from ``high`` up, 0 below ``low``, -1 between.

    A query that is the best of some truth is 1 too, however low its value.
    """
    best = pairs.groupBy(query).agg(F.max_by(truth, F.struct(F.col(value), -F.col(truth))).alias(truth), F.max(value).alias(value))
    rank = pairs.withColumn("__top", F.max(value).over(Window.partitionBy(truth))).where((F.col(value) == F.col("__top")) & (F.col(value) > 0))
    forced = rank.select(query).distinct().withColumn("__forced", F.lit(True))
    label = F.when(F.col("__forced").isNotNull() | (F.col(value) >= high), 1).when(F.col(value) < low, 0).otherwise(-1)
    return best.join(forced, query, "left").withColumn("label", label).drop("__forced")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        slack, came, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, col = row, -1
        while True:
            gain = cost[at] - row_price[at] - col_price
            better = ~used & (gain < slack)
            slack[better], came[better] = gain[better], col
            free = np.where(used, np.inf, slack)
            nxt = int(free.argmin())
            delta = free[nxt]
            row_price[row] += delta
            row_price[owner[used]] += delta
            col_price[used] -= delta
            slack[~used] -= delta
            used[nxt], col = True, nxt
            if owner[nxt] < 0:
                break
            at = owner[nxt]
        while col >= 0:
            before = came[col]
            owner[col] = owner[before] if before >= 0 else row
            col = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assignments(cost: np.ndarray) -> np.ndarray:
    """``assignment`` of many groups of one size, step by step in all of them: ``cost`` is group x row x column, the result group x row."""
    groups, n, m = cost.shape
    row_price, col_price, owner = np.zeros((groups, n)), np.zeros((groups, m)), np.full((groups, m), -1)
    for row in range(n):
        slack, came, used = np.full((groups, m), np.inf), np.full((groups, m), -1), np.zeros((groups, m), bool)
        at, col, open_ = np.full(groups, row), np.full(groups, -1), np.arange(groups)
        while len(open_):
            gain = cost[open_, at[open_]] - row_price[open_, at[open_]][:, None] - col_price[open_]
            shut, low = used[open_], slack[open_]
            better = ~shut & (gain < low)
            low = np.where(better, gain, low)
            came[open_] = np.where(better, col[open_][:, None], came[open_])
            free = np.where(shut, np.inf, low)
            nxt = free.argmin(axis=1)
            delta = free[np.arange(len(open_)), nxt]
            row_price[open_, row] += delta
            which, taken = np.nonzero(shut)
            row_price[open_[which], owner[open_[which], taken]] += delta[which]
            col_price[open_] -= np.where(shut, delta[:, None], 0)
            slack[open_] = np.where(shut, low, low - delta[:, None])
            used[open_, nxt] = True
            col[open_] = nxt
            held = owner[open_, nxt]
            at[open_] = held
            open_ = open_[held >= 0]
        open_ = np.arange(groups)
        while len(open_):
            before = came[open_, col[open_]]
            owner[open_, col[open_]] = np.where(before >= 0, owner[open_, before], row)
            col[open_] = before
            open_ = open_[before >= 0]
    out = np.full((groups, n), -1)
    which, column = np.nonzero(owner >= 0)
    out[which, owner[which, column]] = column
    return out


def assigned(costs: DataFrame, group: list[str], query: str, truth: str, cost: str) -> DataFrame:
    """The one-to-one pairs of least total cost in each group of ``costs``; a missing pair can't be chosen unless nothing else can."""

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        queries, q = np.unique(part[query], return_inverse=True)
        truths, t = np.unique(part[truth], return_inverse=True)
        grid = np.full((len(truths), len(queries)), 1e9)
        np.minimum.at(grid, (t, q), part[cost].astype(float))
        if len(truths) <= len(queries):
            rows, cols = np.arange(len(truths)), assignment(grid)
        else:
            rows, cols = assignment(grid.T), np.arange(len(queries))
        real = grid[rows, cols] < 1e9
        return {query: queries[cols[real]], truth: truths[rows[real]], cost: grid[rows, cols][real]}

    def many(parts: dict[str, np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Groups of one query or one truth: the cheapest row."""
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        same = [np.minimum.reduceat(parts[c], offsets[:-1]) == np.maximum.reduceat(parts[c], offsets[:-1]) for c in (query, truth)]
        done = same[0] | same[1]
        value = parts[cost].astype(float)
        first = np.lexsort((value, owner))[offsets[:-1] - offsets[0]] + offsets[0]
        chosen = first[done & (value[first - offsets[0]] < 1e9)]
        return done, owner[chosen - offsets[0]], {query: parts[query][chosen], truth: parts[truth][chosen], cost: value[chosen]}

    types = dict(costs.dtypes)
    return per_group(costs, group, [query, truth, cost], run, f"{query} {types[query]}, {truth} {types[truth]}, {cost} double", many=many)


def best_pairs(scores: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """The one-to-one pairs of the largest total score in each group of ``scores``; pairs without a row, or a score of 0, aren't chosen.

    A pair whose two ends have no other row needs no assignment; only those that contend
    go through one.
    """
    rivals = lambda end: F.count("*").over(Window.partitionBy(*group, end))
    marked = scores.where(F.col(score) > 0).select(*group, left, right, F.col(score).cast("double").alias(score), ((rivals(left) == 1) & (rivals(right) == 1)).alias("__alone"))

    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        lefts, a = np.unique(part[left], return_inverse=True)
        rights, b = np.unique(part[right], return_inverse=True)
        grid = np.zeros((len(lefts), len(rights)))
        np.minimum.at(grid, (a, b), -part[score])
        if len(lefts) <= len(rights):
            rows, cols = np.arange(len(lefts)), assignment(grid)
        else:
            rows, cols = assignment(grid.T), np.arange(len(rights))
        real = grid[rows, cols] < 0
        return {left: lefts[rows[real]], right: rights[cols[real]], score: -grid[rows, cols][real]}

    types = dict(scores.dtypes)
    contended = per_group(marked.where("not __alone").drop("__alone"), group, [left, right, score], run, f"{left} {types[left]}, {right} {types[right]}, {score} double")
    return marked.where("__alone").drop("__alone").unionByName(contended)


NEGATIVE, UNCERTAIN = -1, -2


def slots(cost: np.ndarray, positive: np.ndarray, negative: np.ndarray, n_uncertain: int) -> np.ndarray:
    """Of each query its truth, ``NEGATIVE`` or ``UNCERTAIN``, in the cheapest assignment.

    ``cost`` is query x truth; a query costs its ``positive`` on top of a truth, its
    ``negative`` in a negative slot, nothing in an uncertain one. Truths are served first,
    then uncertain slots, and what is left of the queries is negative.
    """
    n, m = cost.shape
    n_uncertain = min(max(n - m, 0), n_uncertain)
    n_negative = max(n - m - n_uncertain, 0)
    if n_negative == n:
        return np.full(n, NEGATIVE)
    whole = np.concatenate([cost + positive[:, None], np.repeat(negative[:, None], n_negative, 1), np.zeros((n, n_uncertain))], axis=1)
    if whole.shape[0] <= whole.shape[1]:
        column = assignment(whole)
    else:
        column = np.full(n, m)
        column[assignment(whole.T)] = np.arange(whole.shape[1])
    return np.where(column < m, column, np.where(column < m + n_negative, NEGATIVE, UNCERTAIN))


def slot_matches(pairs: DataFrame, group: list[str], query: str, truth: str, cost: str, probability: str, uncertain: str) -> DataFrame:
    """``query, match`` of each group of ``pairs``: a row for every query and truth, and one with a null truth for a group without any.

    ``probability`` is the query's, 1 less it is the cost of a hit, itself that of a miss;
    ``uncertain`` is the group's number of uncertain slots.
    """
    def run(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        queries, first, q = np.unique(part[query], return_index=True, return_inverse=True)
        real = ~np.isnan(part[truth].astype(float))
        truths, t = np.unique(part[truth][real].astype(np.int64), return_inverse=True)
        grid = np.zeros((len(queries), len(truths)))
        grid[q[real], t] = part[cost][real].astype(float)
        p = part[probability].astype(float)[first]
        found = slots(grid, 1 - p, p, int(part[uncertain][0]))
        return {query: queries, "match": np.where(found >= 0, truths[np.maximum(found, 0)], found) if len(truths) else found}

    def many(parts: dict[str, np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Groups with as many queries, truths and uncertain slots at a time; rows come by query, then truth."""
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(of)) - (offsets[:-1] - offsets[0])[of]
        q, t = parts[query][offsets[0] : offsets[-1]], parts[truth][offsets[0] : offsets[-1]].astype(float)
        start = offsets[:-1] - offsets[0]
        bare = np.isnan(t[start])
        across = np.where(bare, 1, np.bincount(of[q == q[start][of]], minlength=len(sizes)))
        begin = start[of] + place // across[of] * across[of]
        fits = (q == q[begin]) & np.where(bare[of], np.isnan(t), t == t[start[of] + place % across[of]])
        fits &= (place % across[of] > 0) | (place == 0) | (q != q[np.maximum(np.arange(len(q)) - 1, 0)])
        done = (sizes <= SMALL_GROUP) & (sizes % across == 0) & (np.bincount(of[~fits], minlength=len(sizes)) == 0)
        kinds = np.stack([sizes // across, np.where(bare, 0, across), parts[uncertain][offsets[:-1]].astype(np.int64)], axis=1)
        owner, queries, matches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, m, free in np.unique(kinds[done], axis=0):
            which = np.flatnonzero(done & (kinds == (n, m, free)).all(axis=1))
            at = offsets[which][:, None] + np.arange(n) * max(m, 1)
            p = parts[probability].astype(float)[at]
            n_uncertain = int(min(max(n - m, 0), free))
            n_negative = int(max(n - m - n_uncertain, 0))
            whole = np.zeros((len(which), n, m + n_negative + n_uncertain))
            if m:
                whole[:, :, :m] = parts[cost].astype(float)[at[:, :, None] + np.arange(m)] + (1 - p)[:, :, None]
            whole[:, :, m : m + n_negative] = p[:, :, None]
            column = np.zeros((len(which), n), np.int64) if n_negative == n else assignments(whole)
            found = np.where(column < m + n_negative, NEGATIVE, UNCERTAIN)
            if m:
                found = np.where(column < m, parts[truth][offsets[which][:, None] + np.minimum(column, m - 1)], found)
            owner.append(np.repeat(which, n))
            queries.append(at.ravel())
            matches.append(found.ravel().astype(np.int64))
        return done, np.concatenate(owner), {query: parts[query][np.concatenate(queries)], "match": np.concatenate(matches)}

    types = dict(pairs.dtypes)
    return per_group(pairs, group, [query, truth, cost, probability, uncertain], run, f"{query} {types[query]}, match long", many=many)


def distinct_boxes(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Boxes without exact repeats of one key."""
    return boxes.dropDuplicates([*key, *CORNERS])


def boxes_of_cells(cells: DataFrame, key: list[str], axes: list[str]) -> DataFrame:
    """The box of each key's set cells: least and largest place on every axis."""
    return cells.groupBy(*key).agg(*(F.min(a).alias(f"{a}_min") for a in axes), *(F.max(a).alias(f"{a}_max") for a in axes))


def consensus_cells(votes: DataFrame, key: list[str], cell: list[str], rater: str, n_raters: Column, share: float = 0.5) -> DataFrame:
    """The cells that at least ``share`` of a key's raters set."""
    return votes.groupBy(*key, *cell).agg((F.countDistinct(rater) / F.max(n_raters)).alias("share")).where(F.col("share") >= share)
