"""Queries of box forms, numeric plans, losses, rater agreement, tracks, and joins by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import labels as L
from corvane.functions import metrics as M
from corvane.operators import boxes as B
from corvane.operators import nesting as N
from corvane.operators import ranking as R
from corvane.operators import sampling as S
from corvane.plans import nesting as PN
from corvane.plans.geometry import _BOXES, _IOU, boxes, n_boxes
from corvane.session import load, spread
from corvane.streaming import tracks as T


def _joined(values) -> F.Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def q120_box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in every form: sized and back, as shares, clipped, cropped, lifted, rounded; summed by class."""
    rows = boxes(spark, sf_dir)
    width, height = F.lit(50.0), F.lit(60.0)
    back = G.unsized(G.sized(G.box()))
    crop, left = G.cropped(G.box(), F.lit(20.0), F.lit(15.0), F.lit(25.0), F.lit(30.0))
    share, cut = G.scaled(G.box(), width, height), G.clipped(G.box(), width, height)
    lift = G.lifted(tuple(F.rint(c) for c in G.box()))
    total = lambda c: F.round(F.sum(c), 4)
    return rows.groupBy("class").agg(
        total(sum(back[1:], back[0])).alias("back"), total(share[0] + 2 * share[1] + 3 * share[2] + 4 * share[3]).alias("shares"), total(cut[0] + 2 * cut[1] + 3 * cut[2] + 4 * cut[3]).alias("cut"),
        total(F.when(left, crop[0] + 2 * crop[1] + 3 * crop[2] + 4 * crop[3]).otherwise(0.0)).alias("cropped"), F.sum(left.cast("long")).alias("kept"), total(lift[1] + 2 * lift[2] + 3 * lift[4] + 4 * lift[5] + lift[3]).alias("lifted"),
        F.sum(G.half_even(F.col("x1") / 2).cast("long")).alias("rounded"),
    )


def q121_numeric_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch and resize plans, orientation, Hounsfield windows, affine rows and costs of every part."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_partkey") % 7 + 1).cast("double").alias("k"))
    s, k = F.col("s"), F.col("k")
    side = G.fitting_side((s * 40).cast("long"), k / 4)
    spacing, edges = F.array(s / 10, k / 2, F.lit(2.0)), F.array(F.lit(64), F.lit(64), (k * 16).cast("int"))
    fixed = G.affine([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), k / 8, F.lit(0.5)], [s, k, F.lit(3.0)], [F.lit(2.0), F.lit(3.0), k])
    shape = G.resized([(s * 10).cast("int"), (k * 30).cast("int")], 128)
    return p.select(
        "p_partkey", side.alias("side"), G.depth_patch(s * 4, 2, 4, 3).alias("patch"), shape[0].alias("height"), shape[1].alias("width"), L.orientation(spacing, edges).alias("plane"), G.patch_start(s, F.lit(16), F.lit(50)).alias("start"),
        F.round(G.inverse_sigmoid(s / 50), 6).alias("logit"), G.hounsfield(s * 40, F.lit(1.5), F.lit(-1000.0)).alias("hu"), F.round(sum((c for row in fixed for c in row), F.lit(0.0)), 6).alias("affine"), F.round(G.focal_cost(s / 51), 6).alias("focal"),
    )


def q122_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and scores of events by type: focal, soft Dice, weighted means, Dice with nulls, finite recall, exact matches, a linear score, logged means."""
    e = load(spark, sf_dir, "events").withColumns({"p": F.least(F.col("value") / 300, F.lit(0.99)), "t": (F.col("user_id") % 2).cast("int"), "w": (F.col("event_id") % 3).cast("double")})
    p, t = F.col("p"), F.col("t")
    recall = F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).otherwise(p)
    linear = M.linear_score(F.array(p, t.cast("double")), [0.5, 0.0], [2.0, 1.0], [3.0, -1.0], 0.25)
    logs = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), p)).otherwise(F.create_map(F.lit("a"), p, F.lit("b"), t.cast("double")))
    means = e.select("event_type", *M.log_means(logs)).groupBy("event_type").pivot("key", ["a", "b"]).agg(F.round(F.avg("value"), 6))
    rows = e.groupBy("event_type").agg(
        F.round(F.sum(M.focal_loss(p, t)), 4).alias("focal"), F.round(M.soft_dice_loss(p, t), 6).alias("soft"), F.round(M.reduced(p, F.col("w")), 6).alias("mean"), F.round(M.reduced(p, F.col("w"), "sum"), 3).alias("total"), F.round(M.reduced(p, F.col("w"), "mean", F.sum("w")), 6).alias("weighted"),
        F.round(M.dice_or_null(F.sum(t), F.sum(t), F.sum(F.lit(1))), 6).alias("dice"), F.round(M.finite_mean(recall), 5).alias("recall"), F.round(F.avg(M.exact_match(F.lower("event_type"), F.when(t == 1, F.col("event_type")))), 6).alias("exact"), F.round(F.avg(linear), 6).alias("linear"),
    )
    return rows.join(means, "event_type")


def q123_subset_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over a subset of ten classes, by index."""
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("c"), (F.col("value") > 50).cast("int").alias("ref"), (F.col("event_id") % 2).cast("int").alias("pred"))
    counts = e.groupBy("c").agg(*M.confusion(F.col("ref"), F.col("pred")))
    return M.subset_f1(counts, "c", [1, 4, 5, 7, 9]).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


def q124_chunks_and_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in seven equal chunks and in runs of eleven whose short tail is joined; a slice and the first of a shuffle."""
    docs = load(spark, sf_dir, "documents").select("source", "doc_id")
    ranked = R.ranked_in(docs, ["source"], [F.col("doc_id")], "r", "n")
    place = F.col("r") - 1
    rows = ranked.select("source", "doc_id", R.chunk_of(place, F.col("n"), 7).alias("a"), R.merged_tail_chunk(place, F.col("n"), 11).alias("b"))
    chunks = rows.groupBy("source").agg(F.max("a").alias("chunks"), F.max("b").alias("runs"), F.sum(F.col("a") * F.col("doc_id")).alias("code"), F.sum(F.col("b") * F.col("doc_id")).alias("tail_code"))
    part = ranked.where((F.col("r") > 3) & (F.col("r") <= 9)).groupBy("source").agg(F.sum("doc_id").alias("sliced"))
    first = S.first_shuffled(docs, "doc_id", 5, 60).groupBy("source").agg(F.count("*").alias("drawn"))
    return chunks.join(part, "source", "left").join(first, "source", "left").select("source", "chunks", "runs", "code", "tail_code", "sliced", F.coalesce("drawn", F.lit(0)).alias("drawn"))


def q125_same_rater_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact repeats of boxes dropped, then nearly equal boxes of one rater and class as one, with the rounded mean box."""
    rows = boxes(spark, sf_dir).select(F.floor(F.col("image") / 16).alias("image"), (F.col("image") * 100 + F.col("rn")).alias("ident"), (F.col("rater") % 2).alias("rater"), "class", *(F.col(c).alias(c) for c in B.CORNERS))
    n, equal = n_boxes(spark, sf_dir), ["image", "class", "rater", *B.CORNERS]
    left = B.distinct_boxes(spread(rows, n, *equal).groupBy(*equal).agg(F.min("ident").alias("ident")), ["image", "class", "rater"])
    merged = B.without_repeats(left, ["image", "class"], "ident", "rater", 0.9, n)
    return merged.select("image", "class", "ident", "rater", "n", *B.CORNERS)


def q126_consensus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (suppliers) that half of an order's raters (lines) set; orders of over four raters set apart; boxes and one-hot targets of cells."""
    votes = PN.numbered_lines(spark, sf_dir).select("l_orderkey", "rn", F.explode(F.array((F.col("l_suppkey") % 5), (F.col("l_partkey") % 5))).alias("cell")).distinct()
    raters = votes.groupBy("l_orderkey").agg(F.countDistinct("rn").alias("raters"))
    joined = votes.join(raters, "l_orderkey")
    found = B.consensus_cells(joined.where("raters <= 4"), ["l_orderkey"], ["cell"], "rn", F.col("raters"))
    spans = B.boxes_of_cells(found, ["l_orderkey"], ["cell"])
    hot = found.groupBy("l_orderkey").agg(*(F.bool_or(F.col("cell") == c).alias(f"c{c}") for c in range(5)))
    pos = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"c{c}"), F.lit(str(c))) for c in range(5)))), ",")
    out = spans.join(hot, "l_orderkey").select("l_orderkey", F.col("cell_min").alias("low"), F.col("cell_max").alias("high"), pos.alias("targets"))
    return out.unionByName(raters.where("raters > 4").select("l_orderkey", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit("set apart").alias("targets")))


def q127_shared_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of sequences whose slots share one id counter: the sequence is the event type, the slot the user."""
    obs = load(spark, sf_dir, "events").select(F.col("event_type").alias("seq"), F.col("event_id").alias("frame"), F.col("user_id").alias("slot"), (F.col("value") / 200).alias("score"))
    return T.track_sequences(obs, tolerance=3)


def q128_track_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses, false tracks, switches and MOTA of each event type, from a truth and a track of every event."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("seq"), F.col("event_id").alias("frame"), F.when(F.col("event_id") % 9 > 0, F.col("user_id")).alias("truth"), F.when(F.col("event_id") % 4 > 0, F.floor(F.col("value") / 40)).alias("track"))
    return T.accuracy(e, "seq", "frame", "truth", "track").withColumn("mota", F.round("mota", 6))


def q129_joins_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins without a key of their own: files zipped by line, rewritten rows put back, listed rows in order, prefixed keys, items by image, proposals by score."""
    n = load(spark, sf_dir, "nation")
    a = n.select(F.lit(0).alias("g"), F.col("n_nationkey").alias("line"), F.col("n_name").alias("q"))
    b = n.select(F.lit(0).alias("g"), (F.col("n_nationkey") * 2).alias("line"), F.col("n_regionkey").cast("string").alias("a"))
    row = lambda df, kind, key, fact: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), fact.alias("fact"))
    out = row(N.zipped(a, b, ["g"], "line"), "zip", F.col("q"), F.col("a"))
    done = n.where("n_regionkey = 2").select("n_nationkey", F.lower("n_name").alias("n_name"))
    out = out.union(row(N.scattered(n.select("n_nationkey", "n_name"), "n_nationkey", done, "n_name"), "scatter", F.col("n_nationkey"), F.col("n_name")))
    listed = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "place int, n_nationkey long")
    out = out.union(row(N.in_list_order(listed, "place", "n_nationkey", n.select("n_nationkey", "n_name")), "listed", F.col("place"), F.col("n_name")))
    keyed = n.select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("patient"))
    out = out.union(row(N.prefixed_join(keyed, n.select("n_nationkey", "n_name"), {"patient": "n_nationkey"}), "prefix", F.col("patient"), F.col("n_name")))
    c = load(spark, sf_dir, "supplier").where("s_nationkey % 4 > 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal")
    found = N.grouped_lookup(n.select("n_nationkey"), "n_nationkey", c, ["s_suppkey"], ["s_suppkey"], "items")
    out = out.union(row(found, "items", F.col("n_nationkey"), _joined(F.transform("items", lambda x: x["s_suppkey"]))))
    some = n.select("n_nationkey").join(c.select("n_nationkey").distinct(), "n_nationkey", "left_semi")
    best = N.with_proposals(some, "n_nationkey", c.withColumn("id", F.col("n_nationkey").cast("int")), "id", "s_acctbal", ["s_suppkey"])
    return out.union(row(best, "proposals", F.col("n_nationkey"), _joined(F.transform("proposals", lambda x: x["s_suppkey"]))))


def q130_nested_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested targets renamed, images with enough visible keypoints, and detections above score and area."""
    lines = PN.numbered_lines(spark, sf_dir)
    points = F.array(F.col("l_quantity"), F.col("l_discount"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0), F.lit(1.0), F.lit(1.0), F.when(F.col("l_linestatus") == "O", 2.0).otherwise(0.0))
    notes = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(points.alias("keypoints"))).alias("annotations"))
    kept = notes.where(N.enough_keypoints(F.col("annotations"), 3)).agg(F.lit("keypoints").alias("kind"), F.count("*").alias("n"), F.sum("l_orderkey").cast("string").alias("fact"))
    b = boxes(spark, sf_dir).where((F.col("score") > 0.5) & (G.area(G.box()) > 150)).agg(F.lit("detections"), F.count("*"), F.round(F.sum("score"), 3).cast("decimal(20,3)").cast("string"))
    maps = load(spark, sf_dir, "region").select("r_regionkey", F.create_map(F.lit("lung"), F.array(F.struct(F.col("r_name").alias("name"), F.lit(1).alias("n")))).alias("t"), F.create_map(F.lit("lung"), F.when(F.col("r_regionkey") % 2 == 0, F.array("r_name")).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("m"))
    pos, neg = N.renamed_targets(F.col("t"), F.col("m"), "nodule")
    named = maps.select(F.lit("renamed"), F.col("r_regionkey"), F.concat_ws("/", pos["lung"][0]["name"], F.array_join(neg["lung"], "+")))
    return kept.union(b).union(named)


def q131_document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many orders each return flag occurs, no flag too."""
    flags = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).otherwise("-")).alias("f"))
    return N.document_frequency(flags, F.col("f"))


def q132_bleu_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-2 and BLEU-4 of whole benchmark items against changed ones, as expressions."""
    from corvane.plans.metrics import _pairs

    return _pairs(spark, sf_dir).select("item_id", *(F.round(M.bleu_expression(k, F.col("p"), F.col("r")), 6).alias(f"bleu{k}") for k in (2, 4)))


def q133_meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METEOR of whole benchmark items against changed ones, by exact words and stems."""
    from corvane.plans.metrics import _pairs

    return _pairs(spark, sf_dir).select("item_id", F.round(M.meteor(F.col("p"), F.col("r")), 6).alias("meteor"))


def q134_slot_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries (other flags' boxes) of every order matched to truths (the first flag's boxes), negative and uncertain slots, counted by outcome."""
    rows = boxes(spark, sf_dir).select("image", "rn", "class", "score", *B.CORNERS)
    truth = rows.where("class = 'A'").select("image", F.col("rn").alias("truth"), *(F.col(c).alias(f"o_{c}") for c in B.CORNERS))
    pairs = rows.where("class <> 'A'").join(truth, "image", "left").select("image", F.col("rn").cast("long").alias("rn"), F.col("truth").cast("double").alias("truth"), F.coalesce(F.round(1 - G.iou(G.box(), G.box("o_")), 9), F.lit(0.0)).alias("cost"), F.least(F.col("score") / 2, F.lit(1.0)).alias("p"), (F.col("image") % 3).cast("double").alias("uncertain"))
    got = B.slot_matches(pairs, ["image"], "rn", "truth", "cost", "p", "uncertain")
    return got.groupBy(F.when(F.col("match") >= 0, "positive").when(F.col("match") == B.NEGATIVE, "negative").otherwise("uncertain").alias("outcome")).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_W = r"list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda w: w <> '')"
_CHANGED = """b as (select item_id, text r, array_to_string(list_transform(string_split(text, ' ')[2:], lambda w, i: case when i % 7 = 6 then w || 'x' else w end) || string_split(text, ' ')[3:3], ' ') p from benchmark)"""


def _bleu_sql(order: int) -> str:
    grams = lambda w, n: f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
    hits = lambda n: f"list_sum(list_transform(list_distinct(p{n}), lambda x: least(len(list_filter(p{n}, lambda y: y = x)), len(list_filter(r{n}, lambda y: y = x)))))"
    logs = " + ".join(f"ln(nullif(h{n}, 0)::double / nullif(np - {n - 1}, 0))" for n in range(1, order + 1))
    return f"""(with w as (select item_id, {_W.format('p')} p, {_W.format('r')} r from b),
g as (select item_id, len(p) np, len(r) nr, {', '.join(f'{grams("p", n)} p{n}, {grams("r", n)} r{n}' for n in range(1, order + 1))} from w),
h as (select item_id, np, nr, {', '.join(f'{hits(n)} h{n}' for n in range(1, order + 1))} from g)
select item_id, coalesce(round(exp(({logs}) / {order}) * case when np >= nr then 1 else exp(1 - nr / np::double) end, 6), 0) bleu{order} from h)"""


ORACLE_SQL = {
    "q120_box_forms": f"""with {_BOXES}, s as (select *, greatest(x1 - 20, 0) a1 from b),
c as (select class, x1, y1, x2, y2, least(greatest(x1 - 20, 0), 25) a, least(greatest(y1 - 15, 0), 30) b, least(greatest(x2 - 20, 0), 25) c, least(greatest(y2 - 15, 0), 30) d from b)
select class, round(sum(x1 + y1 + x2 + y2), 4) back, round(sum((x1 + x2) / 2 / 50 + 2 * (y1 + y2) / 2 / 60 + 3 * (x2 - x1) / 50 + 4 * (y2 - y1) / 60), 4) shares,
 round(sum(least(greatest(x1, 0), 50) + 2 * least(greatest(y1, 0), 60) + 3 * least(greatest(x2, 0), 50) + 4 * least(greatest(y2, 0), 60)), 4) cut,
 round(sum(case when c > a and d > b then a + 2 * b + 3 * c + 4 * d else 0 end), 4) cropped, cast(sum(case when c > a and d > b then 1 else 0 end) as bigint) kept,
 round(sum(round_even(y1, 0) + 2 * round_even(x1, 0) + 3 * round_even(y2, 0) + 4 * round_even(x2, 0) + 1), 4) lifted, cast(sum(round_even(x1 / 2, 0)) as bigint) rounded from c group by 1""",
    "q121_numeric_plans": """with p as (select p_partkey, p_size::double s, (p_partkey % 7 + 1)::double k from part),
t as (select p_partkey, max(t) side from p, range(0, 500) r(t) where t * ceil(k / 4 * t) <= s * 40 group by 1),
g as (select p_partkey, round(abs(k / 2 - 2.0::double), 9) g0, round(abs(s / 10 - 2.0::double), 9) g1, round(abs(s / 10 - k / 2), 9) g2, case when 64 = k * 16 then 0 else 1 end e from p)
select p_partkey, cast(side as bigint) side, cast(pow(2, least(greatest(round_even(log2(s * 4 / 8), 0), 0), 3)) as int) patch,
 cast(greatest(round_even(s * 10 * least(1, 128 / greatest(s * 10, k * 30)), 0), 1) as int) height, cast(greatest(round_even(k * 30 * least(1, 128 / greatest(s * 10, k * 30)), 0), 1) as int) width,
 case when g0 < g1 and g0 < g2 then 0 when g1 < g0 and g1 < g2 then 1 when g2 < g0 and g2 < g1 then 2
  when g0 = g1 and g0 < g2 then 0 when g1 = g0 and g1 < g2 then 0 when g0 = g2 and g0 < g1 then case when e = 0 then 0 else 2 end when g1 = g2 and g1 < g0 then case when e = 0 then 1 else 2 end else case when e = 0 then 0 else 2 end end plane,
 cast(greatest(least(floor(s - 8), 34), 0) as int) as start, round(ln(greatest(least(s / 50, 1), 1e-3) / greatest(1 - least(s / 50, 1), 1e-3)), 6) logit, least(greatest(s * 40 * 1.5::double - 1000, -500), 1000)::double hu,
 round(2 + s + 3 * k / 8 + k + 1.5 + 3.0 + (-0.5 * k + k / 8 * k) + 1, 6) affine,
 round(0.25::double * pow(1 - s / 51, 2) * -ln(s / 51 + 1e-8) - 0.75::double * pow(s / 51, 2) * -ln(1 - s / 51 + 1e-8), 6) focal from p join t using (p_partkey) join g using (p_partkey)""",
    "q122_losses": """with e as (select event_type, event_id, user_id, least(value / 300, 0.99::double) p, user_id % 2 t, (event_id % 3)::double w from events)
select event_type, round(sum(-(case when t = 1 then 0.25::double else 0.75 end) * pow(1 - case when t = 1 then p else 1 - p end, 2) * ln(greatest(case when t = 1 then p else 1 - p end, 1e-12))), 4) focal,
 round(1 - (2 * sum(p * t) + 1e-5) / (sum(p) + sum(t) + 1e-5), 6) soft, round(sum(p * w) / count(*), 6) mean, round(sum(p * w), 3) total, round(sum(p * w) / sum(w), 6) weighted, round(2.0::double * sum(t) / (sum(t) + count(*)), 6) dice,
 round(avg(case when user_id % 5 > 0 then p end) * 100, 5) recall, round(avg(case when t = 1 then 1.0::double else 0 end), 6) exact, round(avg((p - 0.5) / 2 * 3 - t + 0.25), 6) as "linear",
 round(avg(p), 6) a, round(avg(case when event_id % 2 = 1 then t::double end), 6) b from e group by 1""",
    "q123_subset_f1": """with c as (select user_id % 10 c, sum(case when value > 50 and event_id % 2 = 1 then 1 else 0 end) tp, sum(case when value <= 50 and event_id % 2 = 1 then 1 else 0 end) fp, sum(case when value > 50 and event_id % 2 = 0 then 1 else 0 end) fn from events group by 1)
select round(avg(2.0::double * tp / (2 * tp + fp + fn)), 6) macro, round(2.0::double * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) micro from c where c in (1, 4, 5, 7, 9)""",
    "q124_chunks_and_slices": """with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 p, count(*) over (partition by source) n, row_number() over (order by md5('5|' || doc_id), doc_id) d from documents),
c as (select *, floor(p / ceil(n / 7.0)) a, case when floor(p / 11) = floor((n - 1) / 11) and floor((n - 1) / 11) > 0 and n - floor((n - 1) / 11) * 11 < 5.5 then floor((n - 1) / 11) - 1 else floor(p / 11) end b from r)
select source, cast(max(a) as bigint) as chunks, cast(max(b) as bigint) runs, cast(sum(a * doc_id) as bigint) code, cast(sum(b * doc_id) as bigint) tail_code, cast(sum(case when p >= 3 and p < 9 then doc_id end) as bigint) sliced, cast(sum(case when d <= 60 then 1 else 0 end) as bigint) drawn from c group by 1""",
    "q125_same_rater_merge": f"""with recursive {_BOXES}, m as (select cast(floor(image / 16) as bigint) image, class, rater % 2 rater, x1, y1, x2, y2, min(image * 100 + rn) ident from b group by all),
e as (select a.ident s, b.ident t from m a join m b on a.image = b.image and a.class = b.class and a.rater = b.rater and a.ident < b.ident where {_IOU} >= 0.9),
l as (select s, t from e union all select t, s from e), r(ident, root) as (select ident, ident from m union select l.t, r.root from r join l on l.s = r.ident),
c as (select ident, min(root) root from r group by 1)
select image, class, root ident, min(rater) rater, count(*) n, round_even(avg(x1), 0) x1, round_even(avg(y1), 0) y1, round_even(avg(x2), 0) x2, round_even(avg(y2), 0) y2 from m join c using (ident) group by image, class, root""",
    "q126_consensus_cells": f"""with v as (select distinct l_orderkey, rn, unnest([l_suppkey % 5, l_partkey % 5]) cell from {PN.LINES}), n as (select l_orderkey, count(distinct rn) n from v group by 1),
f as (select l_orderkey, cell from v join n using (l_orderkey) where n <= 4 group by l_orderkey, cell, n having count(distinct rn) / n >= 0.5)
select l_orderkey, min(cell) low, max(cell) high, string_agg(cell, ',' order by cell) targets from f group by 1 union all select l_orderkey, null, null, 'set apart' from n where n > 4""",
    "q127_shared_tracks": """with o as (select event_type seq, user_id slot, event_id frame, value / 200 >= 0.6 act, row_number() over (partition by event_type, user_id order by event_id) n from events),
l as (select *, max(case when act then n end) over (partition by seq, slot order by frame) la, max(case when act then n end) over (partition by seq, slot order by frame rows between unbounded preceding and 1 preceding) pa from o),
b as (select *, act and (pa is null or n - pa - 1 >= 3) born from l), c as (select *, sum(case when born then 1 else 0 end) over (partition by seq, slot order by frame) births from b),
d as (select seq, slot, births, row_number() over (partition by seq order by frame, slot) - 1 id from c where born)
select seq, frame, slot, case when la is null or n - la >= 3 then -1 else id end track from c left join d using (seq, slot, births)""",
    "q128_track_accuracy": """with m as (select event_type seq, event_id frame, case when event_id % 9 > 0 then user_id end truth, case when event_id % 4 > 0 then cast(floor(value / 40) as bigint) end track from events),
w as (select *, last_value(track ignore nulls) over (partition by seq, truth order by frame rows between unbounded preceding and 1 preceding) was from m),
c as (select seq, count(*) filter (truth is not null and track is null) misses, count(*) filter (truth is null and track is not null) false_tracks, count(*) filter (truth is not null and track is not null and was <> track) switches, count(truth) truths from w group by 1)
select *, round(1 - (misses + false_tracks + switches) / truths::double, 6) mota from c""",
    "q129_joins_by_place": """with s as (select s_nationkey k, s_suppkey, s_acctbal from supplier where s_nationkey % 4 > 0)
select 'zip' kind, n_name as key, n_regionkey::varchar fact from nation union all select 'scatter', n_nationkey::varchar, case when n_regionkey = 2 then lower(n_name) else n_name end from nation
union all select 'listed', p::varchar, n_name from nation join (values (0, 3), (1, 1), (2, 3)) t(p, k) on k = n_nationkey union all select 'prefix', 'p' || n_nationkey, n_name from nation
union all select 'items', n_nationkey::varchar, coalesce(string_agg(s_suppkey, ',' order by s_suppkey), '') from nation left join s on k = n_nationkey group by n_nationkey
union all select 'proposals', k::varchar, string_agg(s_suppkey, ',' order by s_acctbal desc, s_suppkey) from s group by k""",
    "q130_nested_rewrites": f"""with {_BOXES}, o as (select l_orderkey k, sum(case when l_returnflag = 'R' then 1 else 0 end + case when l_linestatus = 'O' then 1 else 0 end) n from lineitem group by 1)
select 'keypoints' kind, count(*) n, cast(sum(k) as bigint)::varchar fact from o where n >= 3
union all select 'detections', count(*), round(sum(score), 3)::decimal(20,3)::varchar from b where score > 0.5 and (x2 - x1) * (y2 - y1) > 150
union all select 'renamed', r_regionkey, 'nodule/' || case when r_regionkey % 2 = 0 then 'nodule' else 'a+b' end from region""",
    "q131_document_terms": "select f term, count(distinct l_orderkey) n from (select l_orderkey, case when l_linenumber > 1 then l_returnflag else '-' end f from lineitem) group by 1",
    "q132_bleu_expression": f"with {_CHANGED} select item_id, a.bleu2, b4.bleu4 from {_bleu_sql(2)} a join {_bleu_sql(4)} b4 using (item_id)",
}
