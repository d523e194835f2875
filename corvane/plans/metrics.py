"""Queries over scores: confusion, roll-ups, overlap metrics, similarity, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.operators import nesting as N
from corvane.operators import ranking as R
from corvane.operators.similarity import nearest
from corvane.session import load


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference and a prediction for three classes of each event."""
    k = F.from_json("props", "k int")["k"]
    events = load(spark, sf_dir, "events").select("event_id", k.alias("k"), "value")
    rows = []
    for c, cut in (("a", 30), ("b", 60), ("c", 95)):
        rows.append(events.select("event_id", F.lit(c).alias("class"), (F.col("k") > cut).cast("int").alias("ref"), (F.col("k") + F.col("event_id") % 20 > cut + 10).cast("int").alias("pred")))
    return rows[0].union(rows[1]).union(rows[2])


def q26_f1_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each class, and their macro and micro means."""
    counts = _predictions(spark, sf_dir).groupBy("class").agg(*M.confusion(F.col("ref"), F.col("pred")))
    each = counts.select("class", F.round(M.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))
    both = M.macro_micro(counts)
    return each.union(both.select(F.lit("macro"), F.round("macro", 6))).union(both.select(F.lit("micro"), F.round("micro", 6)))


def q27_false_omission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of missed positives among predicted negatives, by class."""
    return _predictions(spark, sf_dir).groupBy("class").agg(F.round(M.false_omission_rate(F.col("ref"), F.col("pred")), 6).alias("rate"))


def q28_two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the return flags' mean discounts, by line status."""
    return N.two_level_mean(load(spark, sf_dir, "lineitem"), ["l_linestatus"], ["l_returnflag"], "l_discount").select("l_linestatus", F.round("l_discount", 8).alias("mean"))


def q29_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the nations' mean balances by region, regions without customers 0, and the mean of all regions."""
    per = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    means = per.join(nations, "c_nationkey").groupBy("r_regionkey").agg(F.avg("m").alias("m"), F.count("*").alias("n"))
    regions = load(spark, sf_dir, "region").join(means, "r_regionkey", "left")
    rows = regions.select(F.concat("r_name", F.lit("("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")")).alias("region"), F.coalesce("m", F.lit(0.0)).alias("m"))
    return rows.union(rows.agg(F.lit("all").alias("region"), F.avg("m"))).select("region", F.round("m", 4).alias("mean"))


def q30_overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices in three overlapping groups at once: priority, all, and status."""
    orders = load(spark, sf_dir, "orders").withColumn("g", F.explode(F.array(F.concat(F.lit("p:"), "o_orderpriority"), F.lit("overall"), F.concat(F.lit("s:"), "o_orderstatus"))))
    ratio = F.col("o_totalprice") / (F.col("o_totalprice") + F.col("o_custkey") + 1)
    return orders.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("price"), F.round(F.avg(ratio) * 100, 5).alias("relative"))


def q31_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line item of each (order, line number)."""
    rows = R.first_of(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")])
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def q45_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all vectors to every vector whose id is divisible by 100."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 3)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items against themselves with the first word gone, every seventh changed and one doubled."""
    words = F.split("text", " ")
    return load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("r"), F.array_join(F.concat(F.filter(F.transform(words, lambda w, i: F.when(i % 7 == 6, F.concat(w, F.lit("x"))).when(i > 0, w)), lambda w: w.isNotNull()), F.slice(words, 3, 1)), " ").alias("p"))


def q46_set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of word sets."""
    p, r, f = M.set_scores(F.split("p", " "), F.split("r", " "))
    return _pairs(spark, sf_dir).select("item_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def q47_bleu1_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-1 and ROUGE-1 as expressions."""
    return _pairs(spark, sf_dir).select("item_id", F.round(M.bleu1(F.col("p"), F.col("r")), 6).alias("bleu1"), F.round(M.rouge1(F.col("p"), F.col("r")), 6).alias("rouge1"))


def q75_bleu4_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-4 and ROUGE-L."""
    return _pairs(spark, sf_dir).select("item_id", F.round(M.bleu(4, F.col("p"), F.col("r")), 6).alias("bleu4"), F.round(M.rouge_l(F.col("p"), F.col("r")), 6).alias("rouge_l"))


def q56_quantile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower quartile of prices by order status, at a rank rounded half to even."""
    return R.nearest_rank(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", 0.25)


def q57_minmax_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances scaled within nations, summed up by nation."""
    rows, x = load(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), F.col("c_acctbal")
    stats = rows.groupBy("c_nationkey").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    rows = rows.join(stats, "c_nationkey").select("c_nationkey", F.try_divide(x - F.col("a"), F.col("b") - F.col("a")).alias("u"), F.try_divide(x - F.col("m"), F.col("s")).alias("z"))
    return rows.groupBy("c_nationkey").agg(F.round(F.avg("u"), 6).alias("u"), F.round(F.max("z"), 6).alias("z"))


def q76_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice of the parts that two priorities share, by supplier."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    sets = lines.groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.bool_or(F.col("o_orderpriority") == "2-HIGH").alias("b"))
    count = lambda c: F.sum(c.cast("long"))
    sums = sets.groupBy("l_suppkey").agg(count(F.col("a") & F.col("b")).alias("s"), count(F.col("a")).alias("p"), count(F.col("b")).alias("r"))
    return sums.select("l_suppkey", F.round(M.dice(F.col("s"), F.col("p"), F.col("r")), 6).alias("dice"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_PRED = """p as (select event_id, c as "class", cast(k > cut as int) ref, cast(k + event_id % 20 > cut + 10 as int) pred
 from (select event_id, cast(json_extract_string(props, '$.k') as int) k from events), (values ('a', 30), ('b', 60), ('c', 95)) t(c, cut)),
g as (select "class", sum(case when ref = 1 and pred = 1 then 1 else 0 end) tp, sum(case when ref = 0 and pred = 1 then 1 else 0 end) fp, sum(case when ref = 1 and pred = 0 then 1 else 0 end) fn from p group by 1)"""
_PAIRS = """b as (select item_id, text r, array_to_string(list_transform(string_split(text, ' ')[2:], lambda w, i: case when i % 7 = 6 then w || 'x' else w end) || string_split(text, ' ')[3:3], ' ') p from benchmark)"""
_W = r"list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "q26_f1_macro_micro": f"""with {_PRED} select "class", round(2.0 * tp / (2 * tp + fp + fn), 6) f1 from g
union all select 'macro', round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) from g union all select 'micro', round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) from g""",
    "q27_false_omission": f"""with {_PRED} select "class", round(sum(case when ref = 1 and pred = 0 then 1.0 else 0 end)::double / nullif(sum(case when pred = 0 then 1.0 else 0 end)::double, 0), 6) rate from p group by 1""",
    "q28_two_level_mean": "select l_linestatus, round(avg(m), 8) mean from (select l_linestatus, l_returnflag, avg(l_discount) m from lineitem group by 1, 2) group by 1",
    "q29_region_rollup": """with n as (select c_nationkey, avg(c_acctbal) m from customer group by 1),
r as (select n_regionkey, avg(m) m, count(*) n from n join nation on c_nationkey = n_nationkey group by 1),
t as (select r_name || '(' || coalesce(n, 0) || ')' region, coalesce(m, 0.0) m from region left join r on r_regionkey = n_regionkey)
select region, round(m, 4) mean from t union all select 'all', round(avg(m), 4) from t""",
    "q30_overlapping_groups": """with o as (select *, unnest(['p:' || o_orderpriority, 'overall', 's:' || o_orderstatus]) g from orders)
select g, count(*) n, round(avg(o_totalprice), 2) price, round(avg(o_totalprice / (o_totalprice + o_custkey + 1)) * 100, 5) relative from o group by 1""",
    "q31_dedup_first": """select l_linenumber, count(*) n, cast(sum(l_partkey) as bigint) parts from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) r from lineitem) where r = 1 group by 1""",
    "q45_cosine_topk": """with p as (select a.vec_id q, b.vec_id, round(list_cosine_similarity(b.embedding::double[], a.embedding::double[]), 6) similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
select q, vec_id, similarity, cast(r as int) "rank" from (select *, row_number() over (partition by q order by similarity desc, vec_id) r from p) where r <= 3""",
    "q46_set_prf": f"""with {_PAIRS}, s as (select item_id, list_distinct(string_split(p, ' ')) p, list_distinct(string_split(r, ' ')) r from b), h as (select item_id, len(list_intersect(p, r))::double h, len(p) np, len(r) nr from s)
select item_id, round(h / np, 6) "precision", round(h / nr, 6) recall, case when h = 0 then 0.0 else round(2 * (h / np) * (h / nr) / (h / np + h / nr), 6) end::double f1 from h""",
    "q47_bleu1_expr": f"""with {_PAIRS}, w as (select item_id, {_W.format('p')} p, {_W.format('r')} r from b),
o as (select item_id, len(p) n, len(r) m, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x)))))::double s from w)
select item_id, round(case when n = 0 then 0 when n >= m then s / n else exp(1 - m / n::double) * s / n end, 6) bleu1, round(2.0 * s / (n + m), 6)::double rouge1 from o""",
    "q56_quantile_nearest_rank": """select o_orderstatus, o_totalprice as quantile from (select *, row_number() over (partition by o_orderstatus order by o_totalprice) r, count(*) over (partition by o_orderstatus) n from orders) where r = greatest(cast(round_even(n * 0.25, 0) as int), 1)""",
    "q57_minmax_zscore": """with w as (select c_nationkey, c_acctbal x, min(c_acctbal) over p a, max(c_acctbal) over p b, avg(c_acctbal) over p m, stddev_samp(c_acctbal) over p s from customer window p as (partition by c_nationkey))
select c_nationkey, round(avg((x - a) / nullif(b - a, 0)), 6) u, round(max((x - m) / nullif(s, 0)), 6) z from w group by 1""",
    "q76_dice": """with l as (select l_suppkey, l_partkey, bool_or(o_orderpriority = '1-URGENT') a, bool_or(o_orderpriority = '2-HIGH') b from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
s as (select l_suppkey, sum(case when a and b then 1 else 0 end) s, sum(case when a then 1 else 0 end) p, sum(case when b then 1 else 0 end) r from l group by 1)
select l_suppkey, round(case when p = 0 and r = 0 then 1.0 when p = 0 or r = 0 then 0.0 else 2.0 * s / (p + r) end, 6)::double dice from s""",
}
