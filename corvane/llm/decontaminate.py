"""Benchmark decontamination in DataFrame expressions alone.

1. Both sides become lower-cased word sequences (letters, digits, anything beyond ASCII).
2. A window is as many words of a document as an item has. Windows are laid where they
   could matter: a window that shares no shingle with any item has similarity 0, so each
   place where a document has a shingle of an item lays a window that aligns with it, and
   so does every start between two such places at most two items apart. A window that
   would overrun an edge of the text is moved inside it; a text shorter than the item is
   one window as a whole.
3. Windows and items get 64-bit SimHashes of their shingles, weighted as in step 5. A
   multi-index finds every pair of equal size within ``RADIUS`` bits: of five blocks one
   differs by at most a fifth of the radius, so an item is listed under each value that
   close to its own, block by block, and a window asks for its five values.
4. A pair at the threshold can lie beyond the radius (at similarity 0.8 about a quarter do),
   so the search is completed: such a pair shares at least t / (2 - t) of the item's mass.
   With the item's shingles in a fixed order, heaviest first, it shares one of the first
   ones, up to where the rest alone would weigh less than that. A join on those finds the
   pairs that the radius leaves out; nothing that meets the threshold is lost. This join
   alone would find every pair, those within the radius too: the index guarantees its radius
   but not the threshold. ``complete=False`` leaves the join out and returns what the index
   alone finds.
5. Each candidate is verified with the exact weighted Dice similarity of the two bags of
   ``shingle`` words; a shingle weighs one over the number of items that hold it, so
   text that all items share counts little.

The corpus is scanned twice and its text is never shuffled unless the laid windows outgrow
the broadcast bounds. Only the distinct shingles of the benchmark are broadcast, below
bounds of rows and bytes.

Defined cases: null and empty texts have no words and no windows; a very long text lays
windows like any other; of equally similar windows of a document the first is reported; an
item shorter than a shingle is one shingle of all its words; an item without words matches
nothing; repeated rows give equal results, once; rows of one doc_id with different texts are
told apart by ``doc_key``; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_checked
from corvane.session import written

SHINGLE = 5
THRESHOLD = 0.8
#: Bits within which the multi-index finds every pair, and the bits of its blocks.
RADIUS, BLOCKS = 14, (13, 13, 13, 13, 12)
#: A shingle of weight 1 counts this often in a SimHash; sums hold windows of four million shingles.
MASS_UNIT = 1024
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str = "text") -> Column:
    """The lower-cased words of a text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _BREAK), "")


def shingles_of(words: str, size: int) -> Column:
    """The hash of every run of ``size`` words, in order."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"if(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts})), cast(array() as array<bigint>))")


def doc_key() -> Column:
    """What tells rows apart: a hash of doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))


def simhash(h: str = "h", mass: str = "mass") -> Column:
    """An aggregate: the SimHash of a group's hashes, each counted ``mass`` times; two bit counts in each 64-bit sum."""
    lanes = [F.sum(F.expr(f"(shiftrightunsigned({h}, {b}) & {0x0000000100000001}L) * {mass}")) for b in range(32)]
    bit = lambda s, shift, b: F.when((F.shiftrightunsigned(s, shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) * 2 > F.sum(mass), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    out = F.lit(0).cast("long")
    for b, s in enumerate(lanes):
        out = out.bitwiseOR(bit(s, 0, b)).bitwiseOR(bit(s, 32, b + 32))
    return out


def _block_values(fp: str) -> list[str]:
    """The expression of each block of a fingerprint."""
    out, at = [], 0
    for bits in BLOCKS:
        out.append(f"shiftrightunsigned({fp}, {at}) & {(1 << bits) - 1}L")
        at += bits
    return out


def within_radius(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every pair of ``windows(..., n, fp)`` and ``items(item_key, n, item_fp)`` of equal ``n`` within ``radius`` bits."""
    flips = radius // len(BLOCKS)
    listed, asked = [], []
    for block, (bits, own, item) in enumerate(zip(BLOCKS, _block_values("fp"), _block_values("item_fp"), strict=True)):
        masks = [sum(1 << b for b in picked) for size in range(flips + 1) for picked in combinations(range(bits), size)]
        listed.append(F.expr(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> named_struct('block', {block}, 'value', ({item}) ^ m))"))
        asked.append(F.struct(F.lit(block).alias("block"), F.expr(own).alias("value")))
    index = items.select("item_key", "n", "item_fp", F.explode(F.concat(*listed)).alias("at")).select("item_key", "n", "item_fp", "at.block", "at.value")
    probes = windows.withColumn("at", F.explode(F.array(*asked))).select("*", "at.block", "at.value").drop("at")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    return probes.join(index, ["n", "block", "value"]).where(near).drop("block", "value").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, complete: bool = True) -> DataFrame:
    """The best window of each leaked item in each document.

    ``doc_key, doc_id, item_id, start_word, n_words, similarity, distance``.
    """
    items = written(
        benchmark.where("item_id is not null").select("item_id", words_of().alias("words")).where("size(words) > 0").dropDuplicates()
        .withColumn("n", F.size("words")).withColumn("k", F.least(F.lit(shingle), "n"))
        .withColumn("item_key", F.xxhash64("item_id", "words")),
        "items",
    )
    lengths = sorted(r.k for r in items.select("k").distinct().collect()) or [shingle]  # from 1 to ``shingle``
    of_length = lambda words: F.coalesce(*(F.when(F.col("k") == k, shingles_of(words, k)) for k in lengths))
    item_shingles = written(items.select("item_key", "n", "k", F.posexplode(of_length("words")).alias("q", "h")), "item-shingles")
    weights = written(item_shingles.groupBy("k", "h").agg((1.0 / F.countDistinct("item_key")).alias("weight")), "shingle-weights")

    corpus = docs.select("doc_id", "text", doc_key().alias("doc_key"))
    known = written(item_shingles.groupBy("k", "h").agg(F.array_distinct(F.collect_list(F.struct("n", "q"))).alias("places")), "item-places")
    numbered = lambda k: F.transform(shingles_of("words", k), lambda h, p: F.struct(F.lit(k).alias("k"), p.alias("p"), h.alias("h")))
    every_run = F.concat(*map(numbered, lengths))
    runs = corpus.select("doc_key", words_of().alias("words")).select("doc_key", F.explode(every_run).alias("r")).select("doc_key", "r.k", "r.p", "r.h")
    hit = join_checked(runs, known, ["k", "h"], "inner").select("doc_key", "k", "p", F.explode("places").alias("at"))
    laid = hit.select("doc_key", "k", F.col("at.n").alias("n"), (F.col("p") - F.col("at.q")).alias("start"))
    laid = written(laid.groupBy("doc_key", "k", "n").agg(F.array_sort(F.collect_set("start")).alias("starts")), "windows")

    held = join_checked(corpus, laid, "doc_key", "inner").select("doc_key", "doc_id", "k", "n", "starts", words_of().alias("words"))
    held = held.select("doc_key", "doc_id", "k", "n", "starts", F.size("words").alias("total"), of_length("words").alias("hs"))
    every = "flatten(transform(starts, (s, i) -> sequence(s, if(get(starts, i + 1) - s <= 2 * n, get(starts, i + 1) - 1, s))))"
    inside = f"array_distinct(transform({every}, s -> greatest(least(s, total - n), 0)))"
    windows = held.select("doc_key", "doc_id", "k", "n", "total", "hs", F.explode(F.expr(inside)).alias("start"))
    windows = windows.select("doc_key", "doc_id", "k", "n", "start", F.expr("least(n, total - start)").alias("n_words"), F.expr("slice(hs, start + 1, greatest(least(n, total - start) - k + 1, 0))").alias("hs"))
    windows = written(windows, "window-shingles")
    at = ["doc_key", "k", "n", "start"]  # doc_id may be null, so it is no join key
    bags = windows.dropDuplicates(at).select(*at, F.explode("hs").alias("h"))
    bags = bags.groupBy(*at, "h").agg(F.count("*").alias("c")).join(weights, ["k", "h"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    bags = written(bags, "window-bags")
    item_bags = item_shingles.groupBy("item_key", "n", "k", "h").agg(F.count("*").alias("ic")).join(weights, ["k", "h"])
    own, theirs = F.col("c") * F.col("weight"), F.col("ic") * F.col("weight")
    prints = written(bags.withColumn("mass", F.ceil(own * MASS_UNIT)).groupBy(*at).agg(simhash().alias("fp"), F.sum(own).alias("window_mass")), "window-prints")
    item_prints = written(item_bags.withColumn("mass", F.ceil(theirs * MASS_UNIT)).groupBy("item_key", "n").agg(simhash().alias("item_fp"), F.sum(theirs).alias("item_mass")), "item-prints")

    near = within_radius(prints.select(*at, "fp"), item_prints.select("item_key", "n", "item_fp"), radius).select(*at, "item_key")
    order = Window.partitionBy("item_key").orderBy("weight", F.col("h").desc())  # the rest from each shingle on, as a running sum from the lightest
    rest = item_bags.withColumn("rest", F.sum(theirs).over(order)).join(item_prints.select("item_key", "item_mass"), "item_key")
    prefix = rest.where(F.col("rest") >= F.col("item_mass") * (threshold / (2 - threshold)) - 1e-6).select("item_key", "n", "h")
    far = bags.select(*at, "h").join(prefix, ["n", "h"]).select(*at, "item_key")
    found = near.union(far).distinct() if complete else near
    shared = (
        found.join(bags, at).join(item_bags.select("item_key", "h", "ic"), ["item_key", "h"])
        .groupBy(*at, "item_key").agg(F.sum(F.least("c", "ic") * F.col("weight")).alias("shared"))
    )
    similarity = F.round(2 * F.col("shared") / (F.col("window_mass") + F.col("item_mass")), 9)
    scored = shared.join(prints, at).join(item_prints.drop("n"), "item_key").withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    best = scored.groupBy("doc_key", "item_key", "k", "n").agg(F.max(F.struct("similarity", -F.col("start"), distance)).alias("b"))
    best = written(best.select("doc_key", "item_key", "k", "n", (-F.col("b.col2")).alias("start"), "b.similarity", F.col("b.col3").alias("distance")), "best-windows")
    told = windows.dropDuplicates([*at, "doc_id"]).select(*at, "doc_id", "n_words")
    return best.join(told, at).join(items.select("item_key", "item_id"), "item_key").select("doc_key", "doc_id", "item_id", F.col("start").alias("start_word"), "n_words", "similarity", "distance")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    found = written(leaks(docs, benchmark).select("doc_key").distinct(), "leaked")
    name = "__corvane_doc_key"
    return join_checked(docs.withColumn(name, doc_key()), found.select(F.col("doc_key").alias(name)), name, "left_anti").drop(name)
