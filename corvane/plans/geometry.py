"""Queries over boxes: overlap joins, IoU, clusters, suppression, matching, window grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.operators import boxes as B
from corvane.plans.nesting import LINES, numbered_lines
from corvane.session import load


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: image is the order, rater the supplier, class the return flag."""
    lines = numbered_lines(spark, sf_dir)
    x1, y1 = F.col("l_quantity"), F.col("l_linenumber") * 10.0
    return lines.select(F.col("l_orderkey").alias("image"), "rn", F.col("l_suppkey").alias("rater"), F.col("l_returnflag").alias("class"), x1.alias("x1"), y1.alias("y1"), (x1 + 10 + 100 * F.col("l_discount")).alias("x2"), (y1 + 10 + 100 * F.col("l_tax")).alias("y2"), (F.col("l_extendedprice") / 100000).alias("score"))


def n_boxes(spark: SparkSession, sf_dir: str) -> int:
    """How many ``boxes`` there are, from the files' own counts."""
    return load(spark, sf_dir, "lineitem").count()


def q20_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of one image that meet, touching ones too, counted by image."""
    left = boxes(spark, sf_dir).select("image", "rn", *B.CORNERS)
    pairs = B.overlapping(left, left, ["image"], 32.0, n_boxes(spark, sf_dir)).where("rn < o_rn")
    return pairs.groupBy("image").agg(F.count("*").alias("n"), F.sum(F.col("rn") * 100 + F.col("o_rn")).alias("code"))


def q21_self_join_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by different raters whose IoU reaches one half."""
    rows = boxes(spark, sf_dir)
    pairs = B.agreeing_pairs(rows, ["image"], "rn", "rater", 0.5, n_rows=n_boxes(spark, sf_dir))
    return pairs.select("image", "src", "dst", F.round("iou", 4).alias("iou"))


def q48_box_convert_giou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box and its next one: centre form and back, IoU and GIoU, averaged by class."""
    w = Window.partitionBy("image").orderBy("rn")
    rows = boxes(spark, sf_dir).withColumns({f"o_{c}": F.lead(c).over(w) for c in B.CORNERS}).where("o_x1 is not null")
    back = G.corners(G.centred(G.box()))
    drift = sum((F.abs(a - b) for a, b in zip(back, G.box(), strict=True)), F.lit(0.0))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(G.iou(G.box(), G.box("o_"))), 6).alias("iou"), F.round(F.avg(G.giou(G.box(), G.box("o_"))), 6).alias("giou"), (F.max(drift) < 1e-6).alias("same"))


def q49_mean_box_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one image and class merged where raters agree, as connected components."""
    rows = boxes(spark, sf_dir).withColumn("ident", F.col("image") * 1000 + F.col("rn"))
    return B.mean_boxes(rows, ["image", "class"], "ident", "rater", 0.5, n_boxes(spark, sf_dir)).select("image", "class", "cluster", "n", *(F.round(c, 6).alias(c) for c in B.CORNERS))


def q50_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes left by greedy suppression of each image and class."""
    kept = B.suppressed(boxes(spark, sf_dir), ["image", "class"], "score", "rn", 0.3)
    return kept.groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def q55_window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-overlapping windows of 16 over every part size."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(G.window_starts(F.col("p_size") * 3, 16)).alias("no", "start"))
    return rows.groupBy("no").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def q81_threshold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the first return flag matched to those of the others by IoU: hit, miss, between, best of a truth."""
    rows = boxes(spark, sf_dir)
    truth = rows.where("class = 'A'").select("image", F.col("rn").alias("truth"), *(F.col(c).alias(f"o_{c}") for c in B.CORNERS))
    name = lambda c: (F.col("image") * 1000 + F.col(c)).alias
    queries = rows.where("class <> 'A'").select("image", "rn", *B.CORNERS)
    met = B.overlapping(queries, truth.toDF("image", "rn", *B.CORNERS), ["image"], 32.0, n_boxes(spark, sf_dir))
    pairs = met.select("image", "rn", name("rn")("query"), name("o_rn")("truth"), F.round(G.iou(G.box(), G.box("o_")), 9).alias("iou")).where("iou > 0")
    alone = queries.select("image", "rn").join(pairs.select("image", "rn"), ["image", "rn"], "left_anti").join(truth.groupBy("image").agg(F.min("truth").alias("truth")), "image")  # it meets no truth, so the first one counts, at 0
    pairs = pairs.select("query", "truth", "iou").unionByName(alone.select(name("rn")("query"), name("truth")("truth"), F.lit(0.0).alias("iou")))
    return B.threshold_matches(pairs, "query", "truth", "iou", 0.3, 0.7).groupBy("label").agg(F.count("*").alias("n"), F.sum("truth").alias("truths"))


def q82_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of least total cost between the flags' boxes of each image: pairs and cost by image."""
    rows = boxes(spark, sf_dir)
    truth = rows.where("class = 'A'").select("image", F.col("rn").alias("truth"), *(F.col(c).alias(f"o_{c}") for c in B.CORNERS))
    costs = rows.where("class <> 'A'").join(truth, "image").select("image", "rn", "truth", F.round(1 - G.giou(G.box(), G.box("o_")), 9).alias("cost"))
    return B.assigned(costs, ["image"], "rn", "truth", "cost").groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def q83_consensus_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean boxes of raters whose clusters are no larger than the raters are many."""
    return B.consensus_boxes(boxes(spark, sf_dir), ["image", "class"], "rater").groupBy("class").agg(F.count("*").alias("n"), F.sum("n").alias("boxes"), F.round(F.avg("x2"), 4).alias("x2"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_BOXES = f"""b as (select l_orderkey image, rn, l_suppkey rater, l_returnflag as class, l_quantity x1, l_linenumber * 10.0::double y1, l_quantity + 10 + 100 * l_discount x2, l_linenumber * 10.0::double + 10 + 100 * l_tax y2, l_extendedprice / 100000 score from {LINES})"""
_SHARED = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_UNION = f"({_AREA.format('a')} + {_AREA.format('b')} - {_SHARED})"
_IOU = f"({_SHARED}) / ({_UNION} + 1e-6)"
_HULL = "((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)))"
_GIOU = f"(({_SHARED}) / ({_UNION} + 1e-6) - ({_HULL} - {_UNION}) / ({_HULL} + 1e-6))"

ORACLE_SQL = {
    "q20_interval_overlap": f"with {_BOXES} select a.image, count(*) n, cast(sum(a.rn * 100 + b.rn) as bigint) code from b a join b on a.image = b.image and a.rn < b.rn and a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2 group by 1",
    "q21_self_join_iou": f"with {_BOXES} select a.image, cast(a.rn as int) src, cast(b.rn as int) dst, round({_IOU}, 4) iou from b a join b on a.image = b.image and a.rn < b.rn and a.rater <> b.rater where {_IOU} >= 0.5",
    "q48_box_convert_giou": f"with {_BOXES} select a.class, count(*) n, round(avg({_IOU}), 6) iou, round(avg({_GIOU}), 6) giou, true as same from b a join b on a.image = b.image and b.rn = a.rn + 1 group by 1",
    "q49_mean_box_cluster": f"""with recursive {_BOXES}, i as (select *, image * 1000 + rn id from b),
e as (select a.id s, b.id t from i a join i b on a.image = b.image and a.class = b.class and a.rater <> b.rater where {_IOU} >= 0.5),
r(id, root) as (select id, id from i union select e.t, r.root from r join e on e.s = r.id),
c as (select id, min(root) cluster from r group by 1)
select image, class, cluster, count(*) n, round(avg(x1), 6) x1, round(avg(y1), 6) y1, round(avg(x2), 6) x2, round(avg(y2), 6) y2 from i join c using (id) group by 1, 2, 3""",
    "q55_window_grid": """with p as (select p_partkey, p_size * 3 l, unnest(range(0, greatest(cast(ceil(p_size * 3 / 8.0) as int) - 1, 1))) i from part)
select cast(i as int) no, count(*) n, cast(sum(greatest(least(i * 8, l - 16), 0)) as bigint) starts from p group by 1""",
    "q81_threshold_match": f"""with {_BOXES}, p as (select a.image * 1000 + a.rn query, b.image * 1000 + b.rn truth, round({_IOU}, 9) iou from b a join b on a.image = b.image where a.class <> 'A' and b.class = 'A'),
m as (select query, iou, truth, row_number() over (partition by query order by iou desc, truth) r, max(iou) over (partition by truth) top from p),
f as (select distinct query from m where iou = top and iou > 0)
select case when f.query is not null or iou >= 0.7 then 1 when iou < 0.3 then 0 else -1 end "label", count(*) n, cast(sum(truth) as bigint) truths from m left join f using (query) where r = 1 group by 1""",
}
