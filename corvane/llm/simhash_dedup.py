"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are 64-bit SimHashes of word shingles. Distinct fingerprints are dealt to
tiles by the set-bit counts of their blocks: two fingerprints within ``radius`` bits have
block counts that differ by ``radius`` in sum at most, so all other tile pairs are
skipped, and the tile pairs left are compared in full with numpy exclusive-or and bit
counts. No link is missed and none is guessed. A tile pair returns its links as stars
(each linked fingerprint and the least one it reaches there), never as all pairs, and
``connected_components`` joins the stars.

``near_groups`` takes the fingerprints' distance for similarity, at a small radius.
``without_similar`` takes the Jaccard similarity of shingle sets, 0.8 unless told: tiles are
parted by the sets' sizes too (similar sets have like sizes), two fingerprints of 128 bits
in all are compared at a wide radius, and what is within it in a chain is a pool. In each
pool the first document is kept, those similar to it go, and so on with what is left, a few
documents at a time; after a few rounds what is left is parted again by its rare shingles, so
that rows that are near but not similar cost no further rounds; similarity is exact, on the
whole sets. So every document that goes is
similar to one that stays, and no two that stay are similar, unless the radius lost them:
at similarity 0.8 it loses one pair in a thousand (three for texts of about 15 shingles), above
that fewer.

Defined cases: a text without words (null and empty too) has fingerprint zero and links
like any other; repeated rows share a group; very long texts are hashed whole; a group's id
is its least doc_id, nulls left aside (null if it has no other); an empty table gives no
rows; other columns aren't read, or are carried by name. ``without_similar`` tells rows
apart by doc_id and text: of rows that are equal in both one stays, rows of one doc_id with
different texts are rows of their own, and a null doc_id comes after all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, Scan, chunks, join_checked, mix, texts_of
from corvane.llm.decontaminate import doc_key
from corvane.operators.components import connected_components
from corvane.session import new_path, remove, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Blocks whose set bits are counted for the tiles.
BLOCKS = 4
#: Fingerprints of one tile chunk at most, on average; a tile pair compares chunk by chunk.
CHUNK = 1024
#: Chunks of a tile that lie under one join key, and rows of a chunk that are compared at once.
WAYS, STRIP = 16, 128
#: Candidates of a pool that one round takes at most; they are judged in one task.
MOST_HEADS = 1024
#: Rounds of a pool after which what is left of it is parted again by its rare shingles.
WIDE_ROUNDS = 3
#: Rows of a pool that are compared with its candidates under one join key, on average.
POOL_PART = 1024
#: Bits of the buckets whose counts order a pool's shingles, and shingles that one numpy pass takes.
ORDER_BITS, STRIP_SHINGLES = 20, 1 << 17
#: Shingles and Jaccard similarity of ``without_similar``.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Bits that two documents at the similarity may differ by, in the first 64 and in all 128: beyond it lie one in ten thousand and one in a thousand.
FIRST_RADIUS, WIDE_RADIUS = 20, 32



def shingle_hashes(data: np.ndarray, scan: Scan, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle (its words parted by one space), and the text of each.

    A text of fewer words than a shingle has its whole word sequence as its one shingle.
    """
    width = scan.ends - scan.starts + 1
    place = np.concatenate([[0], np.cumsum(width)])
    spaced = np.full(place[-1] + 1, 0x20, np.uint8)
    mask = np.ones(place[-1], bool)
    mask[place[1:] - 1] = False
    spaced[:-1][mask] = data[scan.inside]
    whole = spaced.tobytes()
    last = np.minimum(np.arange(len(width)) + shingle, scan.first[scan.doc + 1])
    full = np.arange(len(width)) + shingle <= scan.first[scan.doc + 1]
    full |= (scan.n_words[scan.doc] < shingle) & (np.arange(len(width)) == scan.first[scan.doc])
    start, end = place[:-1][full].tolist(), (place[last[full]] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(start, end, strict=True)), np.uint64, len(start)), scan.doc[full]


def majority(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of ``n`` texts: a bit is set if over half its hashes set it."""
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    out = np.zeros(n, np.uint64)
    held = np.flatnonzero(count)
    if not len(held):
        return out
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        bits = np.unpackbits(octets[:, byte : byte + 1], axis=1, bitorder="little")
        sums = np.add.reduceat(bits, first[held], axis=0, dtype=np.int64)
        part = np.packbits(2 * sums > count[held, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)
        out[held] |= part << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            data = LOWER[data]
            made = [np.zeros(0, np.uint64)]
            for a, b, part, cut in chunks(data, bounds):
                made.append(majority(*shingle_hashes(part, Scan(part, cut), shingle, seed), b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(made).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _within(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints of two chunks within ``radius`` bits of each other, a strip of rows at a time; of one chunk each pair once."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), STRIP):
        near = np.bitwise_count(left[at : at + STRIP, None] ^ right[None, :]) <= radius
        if same:
            near = np.triu(near, at + 1)
        i, j = np.nonzero(near)
        a.append(i + at)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between keys: every linked key but the least of its group, and that least one."""
    if not len(a):
        return a, b
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def tile_stars(keyed: DataFrame, fields: list[str], ahead: list[int], near: Callable[[dict[str, np.ndarray], dict[str, np.ndarray], bool], tuple[np.ndarray, np.ndarray]], chunk: int) -> DataFrame:
    """Star edges ``(src, dst)`` of the links that ``near`` finds among ``keyed(tile, fields...)``; the first field is the key.

    A tile goes to its own key and to those of the half of the near tiles above it
    (``ahead``, as differences of tile numbers, 0 and up first); it meets the tile that lies
    there by an equi-join on that key, chunk by chunk, so no row holds more than two chunks
    however full a tile is, and a full tile's chunks lie under several keys.
    """
    sizes = written(keyed.groupBy("tile").agg(F.ceil(F.count("*") / chunk).alias("parts")), "tile-sizes")
    dealt = keyed.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64(fields[0]), "parts"))
    tiles = written(dealt.groupBy("tile", "part").agg(F.collect_list(F.struct(*fields)).alias("rows")), "tiles")
    ways = F.floor(F.col("part") / WAYS)
    probes = tiles.select(F.explode(F.array(*(F.col("tile") + d for d in ahead))).alias("meets"), F.col("tile").alias("from_tile"), F.col("part").alias("from_part"), F.col("rows").alias("left"))
    probes = probes.join(sizes.select(F.col("tile").alias("meets"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("parts") - 1) / WAYS))).alias("way")), "meets")
    pairs = probes.join(tiles.select(F.col("tile").alias("meets"), ways.alias("way"), "part", F.col("rows").alias("right")), ["meets", "way"]).where("meets <> from_tile or part >= from_part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("left", "right"):
                column = batch.column(name)
                sides.append(({f: column.values.field(f).to_numpy(zero_copy_only=False) for f in fields}, column.offsets.to_numpy()))
            same = batch.column("same").to_numpy(zero_copy_only=False)
            found = []
            for i in range(batch.num_rows):
                left, right = ({f: v[at[i] : at[i + 1]] for f, v in values.items()} for values, at in sides)
                a, b = near(left, right, bool(same[i]))
                found.append(_stars(left[fields[0]][a], right[fields[0]][b]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["src", "dst"])

    same = (F.col("meets") == F.col("from_tile")) & (F.col("part") == F.col("from_part"))
    return pairs.select("left", "right", same.alias("same")).mapInArrow(compare, "src long, dst long")


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Star edges ``(src, dst)`` among distinct fingerprints ``fp`` that reach all links within ``radius``."""
    base = 64 // blocks
    counts = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {base * k}) & {(1 << base) - 1}L")) for k in range(blocks)]
    radix = 2 * (base + radius) + 1
    key = sum((c.cast("long") * radix**k for k, c in enumerate(counts)), F.lit(0).cast("long"))
    steps = [o for o in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, o)) <= radius]
    ahead = sorted({d for o in steps if (d := sum(x * radix**k for k, x in enumerate(o))) >= 0})
    near = lambda left, right, same: _within(left["fp"].view(np.uint64), right["fp"].view(np.uint64), radius, same)
    return tile_stars(distinct.select("fp", key.alias("tile")), ["fp"], ahead, near, chunk)


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``."""
    prints = written(fingerprints(docs, shingle, seed), "simhash")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    labels = connected_components(links(groups.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = groups.join(labels, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _set_rows(batch: pa.RecordBatch, shingle: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of a batch: first, end, and the distinct shingle hashes with their texts, sorted by text and hash."""
    data, bounds = texts_of(batch.column("text"))
    for a, b, part, cut in chunks(data, bounds):
        part = LOWER[part]
        hashes, doc = shingle_hashes(part, Scan(part, cut), shingle, seed)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        first = np.ones(len(doc), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        yield a, b, hashes[first], doc[first]


def set_prints(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, seed: int = SEED) -> DataFrame:
    """``key, doc_id, node, n, fp, fp2`` of every row: its own key, a hash of its shingle set, the set's size, and 128 SimHash bits of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, doc in _set_rows(batch, shingle, seed):
                n = np.bincount(doc, minlength=b - a)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
                node = mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64))
                made = [batch.column("key").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32))]
                made += [pa.array(majority(x, doc, b - a).view(np.int64)) for x in (h, mix(h))]
                yield pa.RecordBatch.from_arrays(made, names=["key", "doc_id", "node", "n", "fp", "fp2"])

    return docs.select(doc_key().alias("key"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc_id long, node long, n int, fp long, fp2 long")


def shingle_sets(docs: DataFrame, keys: DataFrame, shingle: int = SIMILAR_SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and ``set`` (distinct shingle hashes) of the rows of ``docs`` that ``keys(key)`` names, as often as they repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, doc in _set_rows(batch, shingle, seed):
                made = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), made], names=["key", "set"])

    wanted = join_checked(docs.select(doc_key().alias("key"), "text"), keys, "key", "left_semi")
    return wanted.mapInArrow(run, "key long, set array<long>")


def pools(nodes: DataFrame, similarity: float = SIMILARITY, chunk: int = 2 * CHUNK) -> DataFrame:
    """``node, pool`` of every one of ``nodes(node, n, fp, fp2)`` that lies within the wide radius of another; a pool is a chain of such."""
    step = 8  # set-bit counts of a tile, so that tiles aren't many and small
    size = F.floor(F.log(F.greatest("n", F.lit(1)) * 1.0) / -math.log(similarity) + 1e-9)
    tile = size * 64 + F.floor(F.bit_count("fp") / step)
    reach = -(-FIRST_RADIUS // step)
    ahead = [*range(reach + 1), *(64 + d for d in range(-reach, reach + 1))]

    def near(left: dict[str, np.ndarray], right: dict[str, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
        u = lambda side, name: side[name].view(np.uint64)
        a, b = _within(u(left, "fp"), u(right, "fp"), FIRST_RADIUS, same)
        bits = np.bitwise_count(u(left, "fp")[a] ^ u(right, "fp")[b]) + np.bitwise_count(u(left, "fp2")[a] ^ u(right, "fp2")[b])
        n, m = left["n"][a], right["n"][b]
        keep = (bits <= WIDE_RADIUS) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
        return a[keep], b[keep]

    found = connected_components(tile_stars(nodes.select("node", "n", "fp", "fp2", tile.cast("long").alias("tile")), ["node", "n", "fp", "fp2"], ahead, near, chunk))
    return found.select("node", F.col("component").alias("pool"))


def _first_apart(rows: pa.Table) -> pa.Table:
    """Of a pool's candidates in order, those that no kept one before them is similar to; ``near`` lists the places of similar ones."""
    places = rows["place"].to_pylist()
    kept: set[int] = set()
    for place, near in sorted(zip(places, rows["near"].to_pylist(), strict=True)):
        if not kept.intersection(near):
            kept.add(place)
    return rows.select(["pool", "node"]).filter(pa.array([place in kept for place in places], pa.bool_()))


def _set_strips(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch of ``pool, set``: first, end, the row of each shingle (from 0), the shingles, and the bucket of each."""
    pool = batch.column("pool").to_numpy(zero_copy_only=False).view(np.uint64)
    column = batch.column("set")
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    a = 0
    while a < len(pool):
        b = max(a + 1, int(np.searchsorted(at, at[a] + STRIP_SHINGLES, "right")) - 1)
        row, h = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), values[at[a] : at[b]]
        yield a, b, row, h, (mix(h.view(np.uint64) ^ mix(pool[a:b])[row]) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)
        a = b


def order_counts(members: DataFrame) -> np.ndarray:
    """How many of the shingles of ``members(pool, set)`` each bucket of pool and shingle holds; tasks return sums, so no shingle is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for *_, bucket in _set_strips(batch):
                np.add.at(total, bucket, 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "rows"])

    sums = members.select("pool", "set").mapInArrow(run, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[sums["bucket"].to_numpy()] = sums["rows"].to_numpy()
    return counts


def rare_prefixes(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``pool, h, node, fewer`` of the first shingles, from rare to common, of each row of ``members(pool, node, set)``, as many as ``finer_pools`` joins.

    How rare a shingle is, its bucket tells; any one order of a pool's shingles gives right
    prefixes, so shingles that share a bucket cost work at most. One that is alone in its
    bucket takes its place in the prefix, but is in no other row and is left out.
    """
    shared = members.sparkSession.sparkContext.broadcast(order_counts(members))  # as large as the buckets are many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, h, bucket in _set_strips(batch):
                rows = shared.value[bucket]
                order = np.lexsort((h, rows, row))
                row, h, rows = row[order], h[order], rows[order]
                n = np.bincount(row, minlength=b - a)
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                within = lambda t: place <= (n - np.ceil(t * n - 1e-9))[row]  # noqa: B023, E731
                take = within(similarity) & (rows > 1)
                of = pa.array(row[take] + a)
                fewer = within(2 * similarity / (1 + similarity))[take]
                yield pa.RecordBatch.from_arrays([batch.column("pool").take(of), pa.array(h[take]), batch.column("node").take(of), pa.array(fewer)], names=["pool", "h", "node", "fewer"])

    return members.select("pool", "node", "set").mapInArrow(run, "pool long, h long, node long, fewer boolean")


def finer_pools(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``members(pool, node, rank, set)`` in finer pools, without the rows that are similar to no other.

    With a pool's shingles in order from rare to common, two sets at similarity ``t`` share one
    of the first ``n - ceil(t * n) + 1`` shingles of the larger and the first
    ``n - ceil(2 * t / (1 + t) * n) + 1`` of the smaller. Rows are joined by those, as stars
    to the least row that has the shingle among its fewer first ones, and a new pool is a
    chain of them. Pages of one template that are less than similar differ in more than their
    first shingles, so they fall apart here, however many they are. Shingles of one row alone
    come first, so only common ones are joined; prefixes are cut where the sets lie, so no
    other shingle becomes a row.
    """
    first = written(rare_prefixes(members, similarity), "pool-prefixes")
    edges = first.join(first.where("fewer").groupBy("pool", "h").agg(F.min("node").alias("dst")), ["pool", "h"]).select(F.col("node").alias("src"), "dst")
    chains = written(connected_components(edges.where("src <> dst")).select("node", F.col("component").alias("pool")), "pool-chains")
    return join_checked(members.drop("pool"), chains, "node", "inner").select("pool", "node", "rank", "set")


def removed_nodes(members: DataFrame, similarity: float = SIMILARITY, first: int = 4) -> DataFrame:
    """The nodes of ``members(pool, node, rank, set)`` that are similar to a kept one before them.

    A round takes the first candidates of every pool (``first`` of them, four times as many
    in each further round up to ``MOST_HEADS``), compares them with all that is left of the
    pool, keeps those that no kept one is similar to, and drops what is similar to them.
    Pools without rows left are done; each round is written, and the round before it deleted.
    What is left after ``WIDE_ROUNDS`` rounds lies in ``finer_pools`` from then on, so rounds
    aren't spent on rows that are only near. Candidates that nothing before
    them is similar to are kept, and what is similar to those goes, as joins; only what then
    is undecided is judged in order, ``MOST_HEADS`` rows a pool at most. A large pool's rows
    lie under several keys, its candidates under each of them, so no task holds a pool, and
    of the rows only each task's first candidates are ranked.
    """
    spark = members.sparkSession
    paths: list[str] = []  # of the round

    def put(df: DataFrame, label: str) -> DataFrame:
        paths.append(new_path(spark, label))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    left, gone, take, turn = put(members, "pool-members"), None, first, 0
    while not left.isEmpty():
        turn += 1
        if turn == WIDE_ROUNDS + 1:
            left, take = put(finer_pools(left, similarity), "pool-members"), first
        superseded, paths = paths, []
        w = Window.partitionBy("pool").orderBy("rank")
        sizes = left.groupBy("pool").agg(F.max("rank").alias("end"), F.ceil(F.count("*") / POOL_PART).alias("ways"))
        firsts = left.select("pool", "node", "rank", F.row_number().over(w).alias("place")).where(F.col("place") <= take)
        own = firsts.join(sizes, "pool").select("pool", "node", "place", "ways", (F.col("rank.key") == F.col("end.key")).alias("last"))
        own = put(own, "pool-heads")
        heads = join_checked(left, own.where(~F.col("last")).select("node", "place", "ways"), "node", "inner")
        heads = heads.select("pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("way"), F.col("node").alias("head"), "place", F.col("rank").alias("head_rank"), F.col("set").alias("head_set"))
        others = join_checked(left, own.where("place = 1").select("node"), "node", "left_anti")  # nothing lies before the first
        others = join_checked(others, own.where("place = 1 and ways > 1").select("pool", "ways"), "pool", "left")
        others = others.withColumn("way", F.pmod(F.xxhash64("node"), F.coalesce("ways", F.lit(1).cast("long")))).drop("ways")
        shared = F.size(F.array_intersect("set", "head_set"))
        like = shared >= similarity * (F.size("set") + F.size("head_set") - shared) - 1e-9
        sized = F.least(F.size("set"), F.size("head_set")) >= similarity * F.greatest(F.size("set"), F.size("head_set")) - 1e-9
        close = others.join(heads.hint("merge"), ["pool", "way"]).where((F.col("rank") > F.col("head_rank")) & sized & like).select("pool", "node", "head", "place")
        close = put(close, "pool-links")
        free = own.join(close.select("node").distinct(), "node", "left_anti").select("pool", "node")
        beaten = close.join(free.select(F.col("node").alias("head")), "head", "left_semi").select("node").distinct()
        near = close.withColumnRenamed("place", "near").join(own.select("node", "place"), "node").join(beaten, "node", "left_anti").join(beaten.withColumnRenamed("node", "head"), "head", "left_anti")
        judged = near.groupBy("pool", "node", "place").agg(F.collect_list("near").alias("near"))
        open_ones = own.join(free, ["pool", "node"], "left_anti").join(beaten, "node", "left_anti").select("pool", "node", "place")
        judged = open_ones.join(judged.select("node", "near"), "node", "left").select("pool", "node", "place", F.coalesce("near", F.expr("cast(array() as array<int>)")).alias("near"))
        kept = put(free.union(judged.groupBy("pool").applyInArrow(_first_apart, "pool long, node long")), "pool-kept")
        dropped = written(close.join(kept.select(F.col("node").alias("head")), "head", "left_semi").select("node").distinct(), "pool-dropped")
        gone = dropped if gone is None else gone.union(dropped)
        left = put(join_checked(left, put(dropped.union(own.select("node")).distinct(), "pool-done"), "node", "left_anti"), "pool-members")
        for path in superseded:
            remove(spark, path)
        take = min(4 * take, MOST_HEADS)
    return gone if gone is not None else spark.createDataFrame([], "node long")


def without_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """The rows of ``docs`` without those whose shingle set is similar to that of a row that stays; all columns kept."""
    prints = written(set_prints(docs, shingle), "set-prints")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    nodes = written(prints.groupBy("node").agg(lead.alias("lead"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2")), "set-nodes")
    pooled = written(pools(nodes, similarity).join(nodes.select("node", "lead"), "node"), "set-pools")
    name = "__corvane_key"
    again = written(prints.groupBy("key").count().where("count > 1").select(F.col("key").alias(name)), "set-repeats")
    repeats = not again.isEmpty()
    named = pooled.select(F.col("lead.key").alias("key"), "pool", "node", F.col("lead").alias("rank"))
    members = join_checked(shingle_sets(docs, named.select("key"), shingle), named, "key", "inner").drop("key")
    gone = removed_nodes(members.dropDuplicates(["node"]) if repeats else members, similarity)
    stay = nodes.join(gone.distinct(), "node", "left_anti").select("lead.key")
    others = written(prints.join(stay, "key", "left_anti").select("key").distinct(), "set-removed")
    kept = join_checked(docs.withColumn(name, doc_key()), others.select(F.col("key").alias(name)), name, "left_anti")
    if not repeats:
        return kept.drop(name)
    once = join_checked(kept, again, name, "left_semi").dropDuplicates([name])
    return join_checked(kept, again, name, "left_anti").unionByName(once).drop(name)


def as_hex(fp: str = "fp"):
    """A fingerprint's 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
