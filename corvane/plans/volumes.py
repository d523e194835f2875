"""Queries over volumes, masks, trajectories, workbooks and composed records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import text as X
from corvane.operators import boxes as B
from corvane.operators import contours as Z
from corvane.operators import conversation as C
from corvane.operators import patches as P
from corvane.operators import sampling as S
from corvane.operators import surfaces as U
from corvane.plans.nesting import numbered_lines
from corvane.session import load, new_path
from corvane.sources import catalog as K
from corvane.sources import readers as R
from corvane.sources import workbooks as W
from corvane.streaming import tracks as T
from corvane.streaming import trajectories as J

SPACING, TOLERANCE = (1.5, 1.0, 0.75), 1.0
TILE = [2, 6, 6]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells of two masks: a case is 64 orders, a label the return flag."""
    row = load(spark, sf_dir, "lineitem")
    return row.select(F.floor(F.col("l_orderkey") / 64).alias("case"), F.col("l_returnflag").alias("label"), (F.col("l_partkey") % 7).cast("int").alias("z"), (F.col("l_suppkey") % 9).cast("int").alias("y"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("x"), (F.col("l_quantity") > 20).alias("truth"), (F.col("l_discount") > 0.04).alias("found"))


def q135_surface_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface Dice, robust Hausdorff distance and overlaps of two masks, by case and label."""
    scores = U.surface_scores(mask_cells(spark, sf_dir), ["case", "label"], ["z", "y", "x"], "truth", "found", SPACING, TOLERANCE)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 6))
    return scores.select("case", "label", *(finite(F.col(c)).alias(c) for c in ("surface_dice", "hausdorff", "truth_overlap", "found_overlap")))


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as pairs, truths and tracks: the sequence is the event type, a frame is 24 events, truth and track follow from user and value; boxes are ten wide."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("seq"), F.floor(F.col("event_id") / 24).alias("frame"), "user_id", "event_id", F.floor(F.col("value")).alias("v"))
    who = lambda name, ident, low: e.where("event_id % 7 > 0" if name == "truth" else "event_id % 5 > 0").groupBy("seq", "frame", ident.alias(name)).agg(F.min(low).alias(f"{name}_x"))
    truths = who("truth", F.col("user_id") % 6, F.col("v") % 20)
    tracks = who("track", (F.col("user_id") * 5 + F.floor(F.col("frame") / 15)) % 6, (F.col("v") + F.col("event_id") % 3) % 20)
    met = truths.join(tracks, ["seq", "frame"])
    shared = F.greatest(10 - F.abs(F.col("truth_x") - F.col("track_x")), F.lit(0))
    pairs = met.withColumn("similarity", shared / (20 - shared)).where("similarity > 0").select("seq", "frame", "truth", "track", "similarity")
    return pairs, truths.select("seq", "frame", "truth"), tracks.select("seq", "frame", "track")


def q136_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and alignment scores of whole trajectories, by sequence."""
    pairs, truths, tracks = observed(spark, sf_dir)
    rows = J.identity(pairs, truths, tracks).join(J.alignment(pairs, truths, tracks), "seq")
    return rows.select("seq", "idtp", "idfn", "idfp", *(F.round(c, 6).alias(c) for c in ("idr", "idp", "idf1", "hota", "deta", "assa", "detre", "detpr", "assre", "asspr", "loca")))


def sequence_stream(spark: SparkSession, sf_dir: str, files: int = 3, at_once: int = 1) -> DataFrame:
    """The rows of q127 as a stream of several files, the last of which moves the watermark beyond all others."""
    path = new_path(spark, "sequences")
    obs = load(spark, sf_dir, "events").select(F.col("event_type").alias("seq"), F.col("event_id").alias("frame"), F.col("user_id").alias("slot"), (F.col("value") / 200).alias("score"), F.col("ts").cast("timestamp").alias("ts"))
    obs.repartition(files).write.parquet(path)
    end = obs.select("seq").distinct().select("seq", F.lit(-1).cast("long").alias("frame"), F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("score"), F.lit("2200-01-01").cast("timestamp").alias("ts"))
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", at_once).parquet(path).withWatermark("ts", "1000 days")


def q137_stream_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of q127 from a stream with keyed map state and event-time timers."""
    from corvane.plans.state import _run_out

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return _run_out(T.stream_sequences(sequence_stream(spark, sf_dir), "seq", "frame", "slot", "score", "ts", tolerance=3), "append")
    finally:
        spark.conf.set(name, before)


def q138_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers as sheets of a workbook, written and read again; rows without a name left out, long sheet names cut."""
    W.register(spark)
    path = f"{new_path(spark, 'book')}/{uuid.uuid4().hex[:8]}.xlsx"
    n = load(spark, sf_dir, "nation").select(F.lit("the nations of the table, as a sheet").alias("sheet"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).alias("name"), F.col("n_nationkey").cast("long").alias("number"), F.lit(None).cast("double").alias("balance"), (F.col("n_regionkey") == 2).alias("flag"))
    s = load(spark, sf_dir, "supplier").select(F.lit("suppliers").alias("sheet"), F.concat(F.lit("<&\" "), F.col("s_name"), F.lit(" _x0041_\t")).alias("name"), F.col("s_suppkey").alias("number"), F.col("s_acctbal").alias("balance"), F.lit(None).cast("boolean").alias("flag"))
    n.unionByName(s).write.format(W.NAME).mode("append").save(path)
    back = spark.read.format(W.NAME).schema("sheet string, name string, number long, balance double, flag boolean").option("key", "name").load(path)
    return back.select("sheet", "name", "number", "balance", F.col("flag").cast("int").alias("flag"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as small volumes."""
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (1 + F.col("s_suppkey") % 3).cast("int").alias("nz"), (4 + F.col("s_suppkey") % 9).cast("int").alias("ny"), (10 + F.col("s_nationkey") % 7).cast("int").alias("nx"))


def q139_window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over every supplier's volume, each with a prediction of its cells, merged under a Gaussian weight; how many cells are set, and the sum."""
    cells = P.window_cells(P.spread_volumes(volumes(spark, sf_dir), ["k"], ["nz", "ny", "nx"]), ["nz", "ny", "nx"], TILE, ["z", "y", "x"])
    p = F.pmod(F.col("k") * 7 + F.col("window.z") * 3 + F.col("window.y") * 5 + F.col("window.x") * 11 + F.col("z") * 13 + F.col("y") * 17 + F.col("x") * 19, F.lit(23)) / 22.0
    made = P.merged(cells, ["k"], ["z", "y", "x"], p, P.gaussian_weight([F.col("in_z"), F.col("in_y"), F.col("in_x")], TILE))
    return made.groupBy("k").agg(F.count("*").alias("cells"), F.sum(F.col("set").cast("long")).alias("n_set"), F.round(F.sum("value"), 4).alias("total"))


def q140_patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of every order as a volume: size, scale and place, drawn by key; the line items are foreground cells."""
    k = F.col("o_orderkey")
    v = load(spark, sf_dir, "orders").select("o_orderkey", (1 + k % 12).cast("int").alias("nz"), (64 + F.col("o_custkey") % 200).cast("int").alias("ny"), (80 + k % 150).cast("int").alias("nx"), (1 + F.col("o_custkey") % 5).cast("double").alias("dz"), (0.5 + (k % 4) / 4.0).alias("dy"), (0.5 + (k % 4) / 4.0).alias("dx"))
    plan = P.patch_plan(v, k, ("nz", "ny", "nx"), ("dz", "dy", "dx"), 42)
    inside = load(spark, sf_dir, "lineitem").join(v.select(k.alias("l_orderkey"), "nz", "ny", "nx"), "l_orderkey")
    fg = inside.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % F.col("nz")).alias("z"), (F.col("l_partkey") % F.col("ny")).alias("y"), (F.col("l_suppkey") % F.col("nx")).alias("x"))
    out = P.drawn_centres(plan, fg, "o_orderkey", ["z", "y", "x"], ["nz", "ny", "nx"], ["patch_z", "patch_y", "patch_x"], 42)
    return out.select("o_orderkey", "depth_patch", "patch_z", "patch_y", "patch_x", F.round("scale_z", 6).alias("scale_z"), F.round("scale_xy", 6).alias("scale_xy"), F.col("on_cell").cast("int").alias("on_cell"), "start_z", "start_y", "start_x")


def q141_local_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composed record of every order: its lines are targets, found unless their flag is N, of anatomy or anomaly by line number."""
    t = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("part "), (F.col("l_partkey") % 17).cast("string")).alias("name")).agg(F.bool_or(F.col("l_returnflag") != "N").alias("pos"), (F.min("l_linenumber") % 2).alias("odd"))
    target = F.struct("name", F.when(F.col("odd") == 1, "anatomy").otherwise("anomaly").alias("category"))
    of = t.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("pos"), target)).alias("pos"), F.collect_list(F.when(~F.col("pos"), target)).alias("neg"))
    modalities = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("CT"), F.lit("MRI"))).otherwise(F.array(F.lit("X-Ray")))
    record = C.local_record(F.col("pos"), F.col("neg"), modalities, 7, F.col("l_orderkey"), 2, 2, p_modality=0.5, p_grounding=0.8, p_negative=0.5)
    rows = of.select("l_orderkey", record.alias("r"))
    said = F.array_join(F.transform("r.turns", lambda t: F.concat(t["prompt"], F.lit(" "), t["response"])), "\n")
    classes = F.array_join(F.transform("r.classes", lambda c: F.concat(F.when(c["positive"], "+").otherwise("-"), c["name"])), ",")
    return rows.select("l_orderkey", "r.modality", F.size("r.turns").alias("n_turns"), said.alias("said"), classes.alias("classes"), F.col("r.grounding").cast("int").alias("grounding"))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as contours: the lesion is the order, the rater the line number of four, the slice the supplier of two."""
    d = lambda c: F.col(c).cast("double")
    x, y, w, h = d("l_quantity") % 5, d("l_linenumber") / 2, 2 + d("l_discount") * 40, 3 + d("l_tax") * 25
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4).alias("rater"), (F.col("l_suppkey") % 2).alias("z"), "l_linenumber", F.array(corner(x, y), corner(x + w, y + 1), corner(x + w - 1, y + h), corner(x - 0.5, y + h - 1)).alias("points"))


def q142_contour_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that half of a lesion's raters drew, from contours, by slice; and how many slices are left of those at one place."""
    c = contours(spark, sf_dir)
    n = F.col("last").cast("long") - F.col("first") + 1
    runs = Z.consensus_runs(c, ["l_orderkey"], "rater", "z", "points", 3)
    by_slice = runs.groupBy("l_orderkey", "z").agg(F.sum(n).alias("cells"), F.sum(F.expr("((cast(first as long) + last) * (cast(last as long) - first + 1)) div 2") * 100 + n * F.col("y")).alias("code"))
    kept = Z.slices_once(c.select("l_orderkey", "z", "l_linenumber"), "l_orderkey", "z", "l_linenumber")
    return by_slice.join(kept.select("l_orderkey", "z", F.col("l_linenumber").alias("slice")), ["l_orderkey", "z"])


def q143_refilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hundred places of a seeded order of the orders, those of open orders filled from further on."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.refilled(orders, "o_orderkey", 11, 600, F.col("o_orderstatus") != "O")


def q144_full_match_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of flag A in every image matched at the least full cost: class (focal), L1 of the boxes as shares of the image, and GIoU."""
    rows = numbered_lines(spark, sf_dir)
    b = rows.select(F.col("l_orderkey").alias("image"), "rn", F.col("l_returnflag").alias("class"), F.least(F.col("l_extendedprice") / 100000, F.lit(0.99)).alias("score"), *(c.alias(n) for n, c in zip(B.CORNERS, _shares(), strict=True)))
    truth = b.where("class = 'A'").select("image", F.col("rn").alias("truth"), *(F.col(c).alias(f"o_{c}") for c in B.CORNERS))
    pairs = b.where("class <> 'A'").join(truth, "image")
    cost = G.match_cost(G.focal_cost(F.col("score")), G.centred(G.box()), G.centred(G.box("o_")), 2.0, 5.0, 0.0) - 2.0 * G.giou(G.box(), G.box("o_"))
    found = B.assigned(pairs.select("image", "rn", "truth", cost.alias("cost")), ["image"], "rn", "truth", "cost")
    return found.groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def _shares():
    """Corners of a line item's box as shares of an image 200 wide and high."""
    x, y = F.col("l_quantity") / 200, F.col("l_linenumber") / 20.0
    return x, y, x + 0.05 + F.col("l_discount") / 2, y + 0.05 + F.col("l_tax") / 2


def q145_overridden_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports: of a third a section is named by hand, of a third a range, and the rest is left to the splitter."""
    text = F.concat(F.lit("\n FINDINGS: "), F.md5("text"), F.lit("\n IMPRESSION: "), "lang", F.lit("!"))
    reports = load(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    names = reports.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "impression").otherwise("comparison").alias("name"))
    ranges = reports.where("doc_id % 3 = 1").select("doc_id", (F.col("doc_id") % 20).cast("int").alias("first"), (F.col("doc_id") % 20 + 15).cast("int").alias("last"))
    by_hand, rest = X.overridden(reports, "doc_id", "text", names, ranges)
    found = rest.select("doc_id", F.explode(X.sections(F.col("text"))).alias("s")).select("doc_id", "s.name", "s.text")
    return by_hand.unionByName(found)


def q146_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fragments of each of three bones every order's label values name; ten values a bone."""
    return K.pelvic_fragments(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") % 33).alias("value")))


def _decoded(content: bytes) -> dict | None:
    """A JSON file's ``key`` and ``size``; nothing for one that isn't JSON."""
    try:
        held = json.loads(content)
        return {"key": int(held["key"]), "size": len(content)}
    except (ValueError, KeyError):
        return None


def q147_decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation's suppliers, decoded in tasks; those that can't be decoded are left out."""
    path = new_path(spark, "blobs")
    s = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    text = F.when(F.col("s_nationkey") % 4 == 0, F.lit("broken {")).otherwise(F.concat(F.lit('{"key": '), F.col("s_nationkey").cast("string"), F.lit(', "n": '), F.col("n").cast("string"), F.lit("}")))
    s.select("s_nationkey", text.alias("value")).write.partitionBy("s_nationkey").text(path)
    return R.blobs(spark, path, "*.txt", _decoded, "key int, size int")


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_AREAS = ", ".join(f"({k}, {a!r}::double)" for k, a in enumerate(U.surface_areas(SPACING)))
_DRAW = lambda seed, key: f"(cast(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::bigint as double) / 4503599627370496.0)"
_STARTS = lambda size, crop: f"list_transform(range(0, greatest(cast(ceil({size} / {crop // 2}.0) as int) - 1, 1)), lambda i: greatest(least(i * {crop // 2}, {size} - {crop}), 0))"
_GAUSS = " + ".join(f"pow(({a} - {n // 2}) / ({n}::double / 8), 2)" for a, n in zip(("iz", "iy", "ix"), TILE, strict=True))
_NORMAL = lambda name: f"(sqrt(-2 * ln(1 - {_DRAW(f'42-{name}-a', 'k')})) * cos(2 * pi() * {_DRAW(f'42-{name}-b', 'k')}))"


def _plan_sql() -> str:
    u = lambda name: _DRAW(f"42-{name}", "k")
    bits = lambda mean, name: f"pow(2::double, least(greatest(round_even({mean} + 0.3::double * {_NORMAL(name)}, 0), 0), 4))"
    start = lambda a: f"cast(greatest(least(floor(case when on_cell = 1 then c{a} else floor(n{a} * {_DRAW(f'42-{a}', 'k')}) end - least(patch_{a}, n{a}) / 2), n{a} - least(patch_{a}, n{a})), 0) as int)"
    return f"""
with v as (select o_orderkey k, cast(1 + o_orderkey % 12 as int) nz, cast(64 + o_custkey % 200 as int) ny, cast(80 + o_orderkey % 150 as int) nx, (1 + o_custkey % 5)::double dz, 0.5::double + (o_orderkey % 4) / 4.0::double d from orders),
a as (select *, nz = 1 or {u('full')} < 0.2 as whole, case when nz > 4 then {bits('log2(nz / 4.0::double)', 'deep')} else 1 end step from v),
b as (select *, cast(case when whole and nz > 4 then least(ceil(nz / step), 4) else least(nz, 4) end as bigint) tz from a),
c as (select *, case when nz = 1 then 49 else 36 // tz end budget, least(ny, nx)::double short, greatest(ny, nx)::double long from b),
f as (select *, short / (greatest(list_max(list_filter(range(0, 50), lambda t: t * ceil(long / short * t) <= budget)), 1) * 16) bound from c),
g as (select *, case when whole then bound when least(bound, 1.6) <= 0.8 then least(bound, 1.6) when {u('xy?')} < 0.5 then 0.8 + (least(bound, 1.6) - 0.8) * {u('xy')} else 1 end::double scale_xy from f),
h as (select *, d * scale_xy plane, greatest(dz, 0.5 * (d * scale_xy)) held from g),
i as (select *, case when held < 3.0 * plane and {u('z?')} < 0.5 then held * (greatest(0.8, 0.5 * plane / held) + (least(1.6, 3.0 * plane / held) - greatest(0.8, 0.5 * plane / held)) * {u('z')}) else held end::double space from h),
j as (select *, cast(case when whole then step else {bits('log2(16::double * plane / space)', 'thick')} end as int) depth_patch from i),
l as (select *, cast(tz * depth_patch as int) patch_z, greatest(ceil(short / scale_xy / 16 - 1e-9), 1) ts, greatest(ceil(long / scale_xy / 16 - 1e-9), 1) tl, floor(sqrt(budget::double)) most from j),
m as (select *, least(ts, most) small, case when ts > most then most else least(floor(budget / least(ts, most)), tl) end large from l),
p as (select *, case when whole then nz / patch_z::double else space / dz end scale_z, cast((case when ny <= nx then small else large end) * 16 as int) patch_y, cast((case when ny <= nx then large else small end) * 16 as int) patch_x from m),
w as (select l_orderkey k, cast(l_linenumber % nz as int) cz, cast(l_partkey % ny as int) cy, cast(l_suppkey % nx as int) cx from lineitem join v on k = l_orderkey),
q as (select * from w qualify row_number() over (partition by k order by -ln(1 - {_DRAW('42-cell', "k || '|' || cz || '|' || cy || '|' || cx")}), cz, cy, cx) = 1),
r as (select p.*, cz, cy, cx, case when q.k is not null and {_DRAW('42-forced', 'p.k')} < 0.5 then 1 else 0 end on_cell from p left join q using (k))
select k o_orderkey, depth_patch, patch_z, patch_y, patch_x, round(scale_z, 6) scale_z, round(scale_xy, 6) scale_xy, on_cell, {start('z')} start_z, {start('y')} start_y, {start('x')} start_x from r"""


def _record_sql() -> str:
    toss = lambda name, p: f"{_DRAW(f'7-{name}', 'k')} < {p}"
    keyed = "md5('7-' || case when pos then 'pos-' else 'neg-' end || cat || '|' || k || '|' || name)"
    some = lambda cat, pos: f"list(name order by h) filter (cat = '{cat}' and {'pos' if pos else 'not pos'})"
    listed = "case when len({0}) < 3 then array_to_string({0}, ' and ') else array_to_string({0}[:-2], ', ') || ', and ' || {0}[-1] end"
    return f"""
with t as (select l_orderkey k, 'part ' || (l_partkey % 17) as name, bool_or(l_returnflag <> 'N') pos, case when min(l_linenumber) % 2 = 1 then 'anatomy' else 'anomaly' end cat from lineitem group by 1, 2),
s as (select *, {keyed} h from t qualify row_number() over (partition by k, cat, pos order by {keyed}, name) <= 2),
g as (select k, coalesce({some('anatomy', True)}, []) ap, coalesce({some('anatomy', False)}, []) an, coalesce({some('anomaly', True)}, []) lp, coalesce({some('anomaly', False)}, []) ln,
             string_agg(name, ', ' order by md5('7|' || k || '|' || name), name) filter (cat = 'anatomy') asked,
             string_agg(' ' || name || case when pos then ': yes' else ': no' end, ',' order by md5('7|' || k || '|' || name), name) filter (cat = 'anatomy') answers from s group by 1),
o as (select *, case when k % 2 = 0 then ['CT', 'MRI'] else ['X-Ray'] end ms, {toss('ground', 0.8)} as ground, {toss('negative', 0.5)} as also, {toss('lead', 0.5)} as first_turn from g),
m as (select *, ms[cast(floor({_DRAW('7-modality', 'k')} * len(ms)) as int) + 1] modality from o),
b as (select *, case when asked is not null then ['Are these present: ' || asked || '? Results:' || answers || '.'] else [] end || case when len(lp) + len(ln) > 0 then ['Which anomalies can be seen? ' || case when len(lp) > 0 then {listed.format('lp')} || '.' else 'No anomaly.' end] else [] end body from m),
e as (select *, case when len(body) = 0 or first_turn then ['What is the modality of the image? ' || modality || '.'] else [] end || body turns,
      case when ground then list_transform(ap, lambda x: '+' || x) || case when also then list_transform(an, lambda x: '-' || x) else [] end || list_transform(lp, lambda x: '+' || x) || case when also then list_transform(ln, lambda x: '-' || x) else [] end else [] end classes from b)
select k l_orderkey, modality, cast(len(turns) as int) n_turns, array_to_string(turns, chr(10)) said, array_to_string(classes, ',') classes, cast(ground as int) grounding from e"""


ORACLE_SQL = {
    "q135_surface_scores": f"""
with areas(code, area) as (values {_AREAS}),
c as (select l_orderkey // 64 "case", l_returnflag "label", l_partkey % 7 z, l_suppkey % 9 y, l_linenumber + l_partkey % 3 x, max(cast(l_quantity > 20 as int)) t, max(cast(l_discount > 0.04 as int)) f from lineitem group by all),
o as (select unnest(range(0, 8)) b), n as (select "case", "label", z + 1 - b // 4 z, y + 1 - b // 2 % 2 y, x + 1 - b % 2 x, sum(t * (1 << b)) t, sum(f * (1 << b)) f from c, o where t + f > 0 group by all),
p as (select "case", "label", z, y, x, unnest(['t', 'f']) m, unnest([t, f]) code from n), e as (select p.*, area from p join areas using (code) where code > 0 and code < 255),
d as (select a."case", a."label", a.m, a.z, a.y, a.x, a.area, min(sqrt(pow(1.5::double * (a.z - b.z), 2) + pow(a.y - b.y, 2) + pow(0.75::double * (a.x - b.x), 2))) d from e a left join e b on a."case" = b."case" and a."label" = b."label" and a.m <> b.m group by all),
r as (select *, sum(area) over (partition by "case", "label", m order by d nulls last, area, z, y, x rows unbounded preceding) run, sum(area) over (partition by "case", "label", m) whole from d),
h as (select "case", "label", m, min(d) filter (run / whole >= 0.95 - 1e-12) far, count(d) known, coalesce(sum(area) filter (d <= 1.0), 0) near, sum(area) whole from r group by all)
select "case", "label", round(sum(near) / sum(whole), 6) surface_dice, case when min(known) > 0 then round(max(far), 6) end hausdorff, round(max(near / whole) filter (m = 't'), 6) truth_overlap, round(max(near / whole) filter (m = 'f'), 6) found_overlap from h group by all""",
    "q138_workbook": """select right('the nations of the table, as a sheet', 31) sheet, n_name as name, cast(n_nationkey as bigint) as "number", null::double balance, cast(n_regionkey = 2 as int) flag from nation where n_nationkey % 5 > 0
union all select 'suppliers', '<&" ' || s_name || ' _x0041_' || chr(9), s_suppkey, s_acctbal, null from supplier""",
    "q139_window_merge": f"""
with v as (select s_suppkey k, 1 + s_suppkey % 3 nz, 4 + s_suppkey % 9 ny, 10 + s_nationkey % 7 nx from supplier),
a as (select *, unnest({_STARTS('nz', TILE[0])}) wz from v), b as (select *, unnest({_STARTS('ny', TILE[1])}) wy from a), c as (select *, unnest({_STARTS('nx', TILE[2])}) wx from b),
d as (select *, unnest(range(0, least(2, nz))) iz from c), e as (select *, unnest(range(0, least(6, ny))) iy from d), f as (select *, unnest(range(0, least(6, nx))) ix from e),
g as (select k, wz + iz z, wy + iy y, wx + ix x, ((k * 7 + wz * 3 + wy * 5 + wx * 11 + (wz + iz) * 13 + (wy + iy) * 17 + (wx + ix) * 19) % 23) / 22.0::double p, greatest(10 * exp(({_GAUSS}) * -0.5::double), pow(2::double, -24)) w from f),
m as (select k, z, y, x, sum(p * w) / sum(w) p from g group by all)
select k, count(*) cells, cast(sum(cast(p > 0.5 as int)) as bigint) n_set, round(sum(p), 4) total from m group by 1""",
    "q140_patch_plan": _plan_sql(),
    "q141_local_records": _record_sql(),
    "q142_contour_consensus": """
with c as (select row_number() over () i, l_orderkey, l_linenumber % 4 rater, l_suppkey % 2 z, l_linenumber, l_quantity % 5 x, l_linenumber / 2.0::double y, 2 + l_discount * 40 w, 3 + l_tax * 25 h from lineitem),
p as (select *, [x, x + w, x + w - 1, x - 0.5::double] xs, [y, y + 1, y + h, y + h - 1] ys from c),
e as (select i, unnest(xs) x1, unnest(ys) y1, unnest(xs[2:] || xs[:1]) x2, unnest(ys[2:] || ys[:1]) y2 from p),
g as (select i, l_orderkey, rater, z, unnest(range(cast(floor(list_min(ys)) as int), cast(ceil(list_max(ys)) as int) + 1)) gy, cast(floor(list_min(xs)) as int) - 1 low, cast(ceil(list_max(xs)) as int) + 1 high from p),
r as (select g.*, list(x1 + (gy - y1) * (x2 - x1) / (y2 - y1)) cuts from g join e using (i) where (y1 > gy) <> (y2 > gy) group by all),
s as (select *, unnest(range(low, high + 1)) gx from r),
f as (select l_orderkey, rater, z, gx x, gy y from s where len(list_filter(cuts, lambda c: c <= gx)) % 2 = 1 group by all having count(*) % 2 = 1),
n as (select l_orderkey, count(distinct rater) n from c group by 1),
k as (select l_orderkey, z, x, y from f join n using (l_orderkey) where n <= 3 group by l_orderkey, z, x, y, n having count(distinct rater) / n >= 0.5),
m as (select l_orderkey, z, min(l_linenumber) slice from c group by all)
select l_orderkey, z, count(*) cells, cast(sum(x * 100 + y) as bigint) code, any_value(slice) slice from k join m using (l_orderkey, z) group by all""",
    "q143_refilled": """
with o as (select o_orderkey, o_orderstatus, o_orderstatus <> 'O' as ok, row_number() over (order by md5('11|' || o_orderkey), o_orderkey) r from orders),
f as (select r place, o_orderkey asked, row_number() over (order by r) k from o where r <= 600 and not ok),
s as (select o_orderkey, o_orderstatus, row_number() over (order by r <= 600, r) k, count(*) over () n from o where ok)
select r place, o_orderkey asked, o_orderkey, o_orderstatus from o where r <= 600 and ok
union all select place, asked, s.o_orderkey, s.o_orderstatus from f join s on s.k = (f.k - 1) % s.n + 1""",
    "q146_fragments": "with l as (select l_orderkey as key, l_partkey % 33 v from lineitem) select key, " + ", ".join(f'count(distinct case when v between {10 * i + 1} and {10 * i + 10} then v end) "{n}"' for i, n in enumerate(("sacrum", "left hip bone", "right hip bone"))) + " from l group by 1",
    "q147_decoded_files": """select s_nationkey as key, cast(length('{"key": ' || s_nationkey || ', "n": ' || count(*) || '}') + 1 as int) as size from supplier where s_nationkey % 4 > 0 group by s_nationkey""",
    "q145_overridden_sections": """with r as (select doc_id, md5(text) f, lang || '!' i, chr(10) || ' FINDINGS: ' || md5(text) || chr(10) || ' IMPRESSION: ' || lang || '!' t from documents)
select doc_id, 'findings' as "name", substr(t, doc_id % 20 + 1, 15) as text from r where doc_id % 3 = 1
union all select doc_id, case when doc_id % 2 = 0 then 'impression' else 'comparison' end, case when doc_id % 2 = 0 then i else '' end from r where doc_id % 3 = 0
union all select doc_id, unnest(['preamble', 'findings', 'impression']), unnest([chr(10) || ' ', f, i]) from r where doc_id % 3 = 2""",
}
ORACLE_SQL["q137_stream_sequences"] = """with o as (select event_type seq, user_id slot, event_id frame, value / 200 >= 0.6 act, row_number() over (partition by event_type, user_id order by event_id) n from events),
l as (select *, max(case when act then n end) over (partition by seq, slot order by frame) la, max(case when act then n end) over (partition by seq, slot order by frame rows between unbounded preceding and 1 preceding) pa from o),
b as (select *, act and (pa is null or n - pa - 1 >= 3) born from l), c as (select *, sum(case when born then 1 else 0 end) over (partition by seq, slot order by frame) births from b),
d as (select seq, slot, births, row_number() over (partition by seq order by frame, slot) - 1 id from c where born)
select seq, frame, slot, case when la is null or n - la >= 3 then -1 else id end track from c left join d using (seq, slot, births)"""
