"""Queries of ranking, sampling and batching, ordered by md5 so that SQL can follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import ranking as R
from corvane.operators import sampling as S
from corvane.operators.conversation import chunked, padded
from corvane.session import load

SEED = 42


def q32_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each user's last twenty values at every event."""
    return R.trailing_median(load(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value", 20).select("event_id", F.round("median", 6).alias("median"))


def q34_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, shortest first, in batches of 32: rows and longest text."""
    rows = R.batches(load(spark, sf_dir, "documents").select("source", "n_chars", "doc_id"), ["source"], [F.col("n_chars"), F.col("doc_id")], 32)
    return rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def q35_topk_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest cells of each labelled vector, as (query, class) of eight by eight."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("scores"))
    return R.flat_top_k(vectors, "vec_id", "scores", 8, 5).select("vec_id", "query", "label", "score", "rank")


def q36_topk_per_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part its dearest items, as many as were returned, four at most."""
    lines = load(spark, sf_dir, "lineitem").withColumn("hit", F.col("l_returnflag") == "R")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")]
    return R.top_per_truth(lines, "l_partkey", order, 4, "hit").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def q37_fallback_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's purchases above 200; for a user without one the first event of the highest value."""
    order = [F.desc("value"), F.asc("event_id")]
    rows = R.passing_or_first(load(spark, sf_dir, "events"), ["user_id"], order, (F.col("event_type") == "purchase") & (F.col("value") > 200))
    return rows.select("user_id", "event_id", "value")


def q38_nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiple of four nearest to each part size, the smaller of two."""
    from corvane.functions.geometry import nearest_multiple

    return load(spark, sf_dir, "part").select(nearest_multiple(F.col("p_size") * 2).alias("d")).groupBy("d").agg(F.count("*").alias("n"))


def q39_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents held out of a seeded shuffle."""
    return S.holdout(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED, n=100)


def q40_mixture_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand draws from a weighted mixture of languages."""
    spec = spark.createDataFrame([("en", 1.0), ("de", 2.0), ("fr", 0.5)], "dataset string, weight double")
    rows = load(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), F.col("doc_id").alias("key"))
    return S.mixture(spec, rows.where("dataset in ('en', 'de', 'fr')"), 2000, SEED)


def q41_rebalance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that give documents labelled bad a fifth of the total."""
    rows = S.rebalanced(load(spark, sf_dir, "labels").withColumn("bad", F.col("quality") == 0), "bad", 0.2)
    return rows.groupBy("bad").agg(F.count("*").alias("n"), F.round(F.min("weight"), 8).alias("weight"))


def q42_repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts repeated by size over eight, rounded half to even, once at least."""
    times = F.greatest(F.rint(F.col("p_size") / 8.0), F.lit(1.0))
    return S.repeated(load(spark, sf_dir, "part").select("p_partkey", "p_size"), times).groupBy("copy").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("parts"))


def q43_pos_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events purchases first, four at most, and half as many others."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("pos"))
    return S.positives_first(events, "user_id", "pos", "event_id", SEED, 4, 0.5)


def q54_pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of orders padded to the longest of their batch of 16."""
    orders = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("v"))
    orders = orders.withColumn("batch", F.floor(F.col("l_orderkey") / 16))
    most = F.max(F.size("v")).over(Window.partitionBy("batch"))
    return orders.select("l_orderkey", F.array_join(F.transform(padded(F.col("v"), most, -1), lambda x: x.cast("string")), ",").alias("padded"))


def q77_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source and language, by seeded order."""
    return S.capped(load(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id", SEED, 3)


def q78_aspect_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full batches of 50 parts, small and large apart."""
    rows = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("wide"))
    return R.batches(rows, ["wide"], [F.col("p_partkey")], 50, keep_last=False).groupBy("wide", "batch").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def q79_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines in chunks of three with their bounds."""
    orders = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    parts = orders.select("l_orderkey", F.explode(chunked(F.col("v"), 3)).alias("c"))
    return parts.select("l_orderkey", F.col("c.start").alias("lo"), F.col("c.end").cast("int").alias("hi"), F.size("c.part").alias("n"))


def q80_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand with the brand's place in name order."""
    return R.dense_index(load(spark, sf_dir, "part"), "p_brand").groupBy("p_brand", "index").agg(F.count("*").alias("n"))


def q64_clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of clips of four at stride two, kept inside each order's lines."""
    w = Window.partitionBy("l_orderkey")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("last", F.max("l_linenumber").over(w) + 1)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform(S.clip_frames(F.col("l_linenumber"), F.col("last"), 2, 4), lambda x: x.cast("string")), ",").alias("frames"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_U = "cast(('0x' || substr(md5('42|' || {}), 1, 13))::bigint as double) / 4503599627370496.0"

ORACLE_SQL = {
    "q32_rolling_median": "select event_id, round(median(value) over (partition by user_id order by ts, event_id rows between 19 preceding and current row), 6) median from events",
    "q34_batches": """with b as (select source, n_chars, cast(floor((row_number() over (partition by source order by n_chars, doc_id) - 1) / 32) as bigint) batch from documents)
select source, batch, count(*) n, max(n_chars) longest from b group by 1, 2""",
    "q35_topk_flat": """with f as (select vec_id, unnest(range(0, len(embedding))) pos, unnest(embedding) x from embeddings), s as (select vec_id, pos, round(cast(x as double), 6) score from f),
r as (select *, row_number() over (partition by vec_id order by score desc, pos) rk from s)
select vec_id, cast(floor(pos / 8) as bigint) query, cast(pos % 8 as int) "label", score, cast(rk as int) "rank" from r where rk <= 5""",
    "q36_topk_per_gt": """with r as (select l_partkey, l_extendedprice, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey) r, least(4, sum(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_partkey)) q from lineitem)
select l_partkey, count(*) n, round(sum(l_extendedprice), 2) price from r where r <= q group by 1""",
    "q37_fallback_first": """with r as (select *, event_type = 'purchase' and value > 200 ok, row_number() over (partition by user_id order by value desc, event_id) r from events), a as (select *, bool_or(ok) over (partition by user_id) has_ok from r)
select user_id, event_id, value from a where ok or (not has_ok and r = 1)""",
    "q38_nearest_candidate": """with p as (select p_partkey, p_size * 2 x from part), c as (select p_partkey, d, row_number() over (partition by p_partkey order by abs(d - x), d) r from p, (select unnest(range(4, 65, 4)) d))
select cast(d as int) d, count(*) n from c where r = 1 group by 1""",
    "q39_holdout_split": "select doc_id, case when row_number() over (order by md5('42|' || doc_id), doc_id) > count(*) over () - 100 then 'validate' else 'train' end split from documents",
    "q40_mixture_draws": f"""with d as (select lang dataset, doc_id as key from documents where lang in ('en', 'de', 'fr')), z as (select dataset, count(*) size, count(*) * case dataset when 'en' then 1.0::double when 'de' then 2.0 else 0.5 end mass from d group by 1),
b as (select *, sum(mass) over (order by dataset rows unbounded preceding) high, sum(mass) over () total from z),
u as (select i draw_id, {_U.format('i')} u from range(2000) r(i)),
p as (select draw_id, dataset, size from u join b on u * total >= high - mass and u * total < high),
v as (select draw_id, dataset, size, row_number() over (partition by dataset order by draw_id) - 1 visit from p),
w as (select draw_id, dataset, cast(floor(visit / size) as bigint) epoch, visit % size place from v),
o as (select dataset, epoch, key, row_number() over (partition by dataset, epoch order by md5('42|' || epoch || '|' || key), key) - 1 place from d join (select distinct dataset, epoch from w) using (dataset))
select draw_id, dataset, epoch, key from w join o using (dataset, epoch, place)""",
    "q41_rebalance_weights": """with c as (select count(*) n, sum(case when quality = 0 then 1 else 0 end) neg from labels)
select quality = 0 bad, count(*) n, round(min(case when quality = 0 then 0.2 * (c.n - neg) / (0.8 * neg) else 1.0 end)::double, 8) weight from labels, c group by 1""",
    "q42_repeat_rows": """with r as (select p_partkey, unnest(range(0, cast(greatest(round_even(p_size / 8.0, 0), 1) as int))) c from part) select cast(c as int) "copy", count(*) n, cast(sum(p_partkey) as bigint) parts from r group by 1""",
    "q43_pos_first": """with e as (select user_id, event_id, event_type = 'purchase' pos from events), r as (select *, row_number() over (partition by user_id, pos order by md5('42|' || event_id), event_id) r, least(sum(case when pos then 1 else 0 end) over (partition by user_id), 4) p from e)
select user_id, event_id, pos from r where r <= case when pos then 4 when p = 0 then 4 else least(4 - p, floor(0.5 * p)) end""",
    "q54_pad_batch": """with o as (select l_orderkey, list_sort(list(l_linenumber)) v, cast(floor(l_orderkey / 16) as bigint) b from lineitem group by 1), m as (select *, max(len(v)) over (partition by b) m from o)
select l_orderkey, array_to_string(v || list_transform(range(0, m - len(v)), lambda i: -1), ',') padded from m""",
    "q77_class_cap": "select source, lang, doc_id from (select *, row_number() over (partition by source, lang order by md5('42|' || doc_id), doc_id) r from documents) where r <= 3",
    "q78_aspect_batches": """with r as (select p_partkey, p_size > 25 wide, row_number() over (partition by p_size > 25 order by p_partkey) - 1 r, count(*) over (partition by p_size > 25) n from part)
select wide, cast(floor(r / 50) as bigint) batch, count(*) n, min(p_partkey) as "first" from r where (floor(r / 50) + 1) * 50 <= n group by 1, 2""",
    "q79_chunks": """with o as (select l_orderkey, count(*) n from lineitem group by 1), c as (select l_orderkey, n, unnest(range(0, cast(ceil(n / 3.0) as int))) i from o)
select l_orderkey, cast(i * 3 as int) lo, cast(least(i * 3 + 3, n) as int) hi, cast(least(i * 3 + 3, n) - i * 3 as int) n from c""",
    "q80_dense_index": "select p_brand, dense_rank() over (order by p_brand) - 1 as \"index\", count(*) n from part group by 1",
    "q64_clip_frames": """with d as (select distinct l_orderkey, l_linenumber from lineitem), m as (select *, max(l_linenumber) over (partition by l_orderkey) + 1 t from d)
select l_orderkey, l_linenumber, array_to_string(list_transform(range(0, 4), lambda i: l_linenumber + least(i * 2, t - l_linenumber - 1)), ',') frames from m""",
}
