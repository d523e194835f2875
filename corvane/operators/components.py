"""Connected components of an undirected graph, as alternating star joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import new_path, remove, spread, written


#: Edges of a round beyond which hubs are looked for (fewer fit in any task), and the share of them that makes a node a hub.
MANY_EDGES, HUB_SHARE = 10_000, 0.001


def connected_components(edges: DataFrame, max_rounds: int = 60, many_edges: int = MANY_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component = least node reachable.

    Large-star and small-star steps alternate: each node hangs its neighbours on the
    least node it knows, which keeps the edge count at most what it was and needs about
    log(n) rounds, whatever the diameter. A round is two grouped minima, pre-aggregated
    before their shuffle, and two equi-joins; each round's edges are written to the
    shared folder, so lineage stays one round long and a lost executor costs one round.
    A node that holds a thousandth of a large round's edges is a hub: there are at most two
    thousand of those, so their minima are broadcast and their edges stay where they are.
    Self-loops keep isolated nodes in the result; null ends are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    given = new_path(spark, "cc-given")
    edges.select("src", "dst").where("src is not null and dst is not null").distinct().write.parquet(given)
    whole = spark.read.parquet(given)
    nodes = whole.select(F.col("src").alias("node")).union(whole.select(F.col("dst").alias("node"))).distinct()
    node_path = new_path(spark, "cc-nodes")
    nodes.write.parquet(node_path)
    nodes = spark.read.parquet(node_path)
    current, path = whole.where("src <> dst"), given
    state = None
    n_edges = current.count()
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        up = both.where("dst > src")
        if n_edges > many_edges:
            hubs = both.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")).where(F.col("n") > 2 * n_edges * HUB_SHARE).select("src", F.least("src", "m").alias("hub_m"))
            marked = up.join(F.broadcast(hubs), "src", "left")
            large = marked.where("hub_m is not null").select(F.col("dst").alias("src"), F.col("hub_m").alias("dst")).union(marked.where("hub_m is null").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        else:
            large = up.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        down = large.where("src <> dst").distinct()
        lower = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(lower, "src").select(F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.src", "e.dst")
        nxt = new_path(spark, "cc-edges")
        small.where("src <> dst").distinct().write.parquet(nxt)
        current = spark.read.parquet(nxt)
        remove(spark, path)
        path = nxt
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.hash("src", "dst").cast("long"))).first()
        if tuple(seen) == state:
            break
        state, n_edges = tuple(seen), seen[0]
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return nodes.join(current.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Edges of a group beyond which its components are found by distributed rounds.
LARGE_GROUP = 100_000


def least_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` nodes the least one that the edges reach, by minima passed along edges and shortcuts until none changes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[src], label[dst])
        new = label.copy()
        np.minimum.at(new, src, low)
        np.minimum.at(new, dst, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components_in_groups(edges: DataFrame, group: list[str], large: int = LARGE_GROUP) -> DataFrame:
    """``group, node, component`` of the nodes of ``edges(group, src, dst)``, whose edges never leave their group.

    Groups come many to an Arrow batch, whose components are found at once; a group of more
    than ``large`` edges is left to ``connected_components``, so no task holds one; the number
    of tasks follows from that of the edges. Node ids
    are unique over all groups. Null ends are dropped; no edges give no rows.
    """
    types = dict(edges.dtypes)
    whole = written(edges.select(*group, "src", "dst").where("src is not null and dst is not null"), "group-edges")
    n_edges = whole.count()  # of the files
    sizes = written(spread(whole, n_edges, *group).groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > large).drop("__n"), "group-large")
    none = sizes.isEmpty()
    small = whole if none else whole.join(sizes, group, "left_anti")
    packed = spread(small, n_edges, *group).groupBy(*group).agg(F.collect_list(F.struct("src", "dst")).alias("__e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__e")
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            ends = [flat.field(f).to_numpy() for f in ("src", "dst")]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            nodes, first, place = np.unique(np.concatenate(ends), return_index=True, return_inverse=True)
            label = least_labels(place[: len(owner)], place[len(owner) :], len(nodes))
            of = pa.array(np.concatenate([owner, owner])[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in group), pa.array(nodes), pa.array(nodes[label])], names=[*group, "node", "component"])

    found = packed.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in group), f"node {types['src']}, component {types['src']}"]))
    if none:
        return found
    many = whole.join(sizes, group)
    named = many.select(*group, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return found.unionByName(named.join(connected_components(many), "node").select(*group, "node", "component"))
