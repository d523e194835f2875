"""Queries of records: exploded studies, frames, masks, token labels, clipping, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as G
from corvane.functions import text as X
from corvane.operators import conversation as C
from corvane.operators import ranking as R
from corvane.operators import sampling as S
from corvane.plans.nesting import numbered_lines
from corvane.session import load
from corvane.sources.catalog import merged_targets


def q88_study_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of a conversation against every part of its system's images: questions outer, images inner."""
    turns = load(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("asked"))
    rows = asked.withColumn("image", F.transform(F.sequence(F.lit(0), (F.col("conv_id") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("im"), i.cast("string")).alias("path"), F.when(i % 2 == 0, "PA").otherwise("LATERAL").alias("plane"))))
    pairs = rows.select("conv_id", F.explode("asked").alias("turn"), "image").select("conv_id", "turn", F.explode(F.filter("image", lambda i: i["plane"] == "PA")).alias("i"))
    return pairs.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("i.path").alias("last"))


def q89_frontal_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an item in one of two wanted states, and their earliest such place."""
    lists = numbered_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("planes"))
    place = lambda v: F.nullif(F.array_position("planes", v), F.lit(0))
    return lists.where(F.exists("planes", lambda p: p.isin("A", "R"))).select(F.least(place("A"), place("R")).alias("first")).groupBy("first").agg(F.count("*").alias("n"))


def q90_exact_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of four forms made of documents' lines, split by the exact splitter: normal names, places, and texts."""
    lines = F.split("text", "\n")
    one, two, form = F.element_at(lines, 1), F.element_at(lines, -1), F.col("doc_id") % 4
    made = (
        F.when(form == 0, F.concat(F.lit("top\n FINDINGS: "), one, F.lit("\n IMPRESSION: "), two, F.lit("\n PATIENT HISTORY: none\n")))
        .when(form == 1, F.concat(F.lit("\n CONCLUSION:\n"), one, F.lit("\n EXAM: "), two, F.lit(" HISTORY: no header\n more")))
        .when(form == 2, F.concat(F.lit("top\n TECHNIQUE: "), one, F.lit("\n \nsecond\n \n"), two))
        .otherwise(one)
    )
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sections(made)).alias("no", "s"))
    return rows.select("doc_id", "no", F.col("s.name").alias("name"), F.col("s.start").alias("start"), F.md5("s.text").alias("digest"))


def q91_group_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run of four lines of an order the dearest, kept only if the cheapest is dear enough."""
    runs = numbered_lines(spark, sf_dir).withColumn("g", F.floor((F.col("rn") - 1) / 4))
    best = runs.groupBy("l_orderkey", "g").agg(F.max_by("rn", F.struct("l_extendedprice", -F.col("rn"))).alias("best"), F.min("l_extendedprice").alias("low"))
    return best.where("low >= 20000").groupBy("best").agg(F.count("*").alias("n"))


def q92_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between a user's first and last event, with that day's events or none."""
    days = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    spans = days.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    found = days.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return spans.join(found, ["user_id", "day"], "left").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def q93_mask_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (parts) of three targets (flags), one derived from two of them, the sources gone."""
    cells = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_returnflag").alias("target")).distinct()
    return merged_targets(cells, ["cell"], "target", {"AR": ["A", "R"]}, ["A"]).groupBy("target").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"))


def q94_foreground_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances above the nation's mean: interpolated 5 and 95 percent points, and the population deviation."""
    w = Window.partitionBy("c_nationkey")
    rows = load(spark, sf_dir, "customer").withColumn("m", F.avg("c_acctbal").over(w)).where("c_acctbal > m")
    cut = F.percentile("c_acctbal", F.array(F.lit(0.05), F.lit(0.95)))
    out = rows.groupBy("c_nationkey").agg(cut.alias("p"), F.stddev_pop("c_acctbal").alias("s"))
    return out.select("c_nationkey", F.round(F.col("p")[0], 4).alias("low"), F.round(F.col("p")[1], 4).alias("high"), F.round("s", 4).alias("deviation"))


def q95_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's exponential moving average of values, at the last event."""
    values = load(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return values.select("user_id", F.round(R.smoothed(F.col("v"), 0.9), 5).alias("average"))


def q96_token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys and sizes as prompt and answer tokens: labels, position ids and flags that survive a cut."""
    parts = load(spark, sf_dir, "part").select("p_partkey", F.array(F.lit(1), (F.col("p_partkey") % 7 + 3).cast("int"), F.lit(2)).alias("prompt"), F.array("p_size", F.lit(1), F.lit(9), F.lit(2)).alias("answer"))
    ids, labels = C.masked_labels(F.col("prompt"), F.col("answer"), 0, 6)
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    kept = C.kept_spans(ids, 2, F.array(F.lit(True), F.lit(False)))
    return parts.select("p_partkey", show(ids).alias("ids"), show(labels).alias("labels"), show(C.position_ids(ids, 1, 2)).alias("positions"), F.size(kept).alias("kept"))


def q97_weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of part sizes merged by weight: each cell's weighted mean and whether it passes."""
    rows = load(spark, sf_dir, "part").select(F.explode(G.window_starts(F.lit(64), 16)).alias("start"), F.col("p_size").alias("size"), "p_partkey")
    cells = rows.select((F.col("start") + F.col("p_partkey") % 16).alias("cell"), (F.col("size") / 50.0).alias("p"), (16 - F.abs(F.col("p_partkey") % 16 - 8)).cast("double").alias("w"))
    merged = cells.groupBy("cell").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("m"))
    return merged.select("cell", F.round("m", 6).alias("mean"), (F.col("m") > 0.5).alias("passes"))


def q98_tossed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded tosses and choices of every document, counted by language."""
    docs = load(spark, sf_dir, "documents").select("lang", S.toss(0.2, 7, F.col("doc_id")).alias("asked"), S.choice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 8, F.col("doc_id")).alias("template"))
    return docs.groupBy("lang", "asked", "template").agg(F.count("*").alias("n"))


def q99_study_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns built for every labelled document as a study: how many, and the first prompt."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    vqa = F.when(F.col("quality") == 1, F.array(F.struct(F.lit("Good?").alias("question"), F.lit("Yes.").alias("answer"))))
    turns = C.study_conversation(F.array(F.lit("X-ray")), F.array(F.lit("PA")), F.when(F.col("toxic") == 0, F.col("text")), vqa, 11, F.col("doc_id"))
    return docs.select("doc_id", turns.alias("t")).select("doc_id", F.size("t").alias("n"), F.element_at("t", 1)["prompt"].alias("first"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_LINES = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn from lineitem)"
_U = "cast(('0x' || substr(md5('{}|' || doc_id), 1, 13))::bigint as double) / 4503599627370496.0"

ORACLE_SQL = {
    "q88_study_explode": """with u as (select conv_id, count(*) n from conversations where role = 'user' group by 1)
select conv_id, n * (case when conv_id % 3 = 2 then 2 else 1 end) n, case when conv_id % 3 = 2 then 'im2' else 'im0' end as "last" from u""",
    "q89_frontal_studies": f"select f as \"first\", count(*) n from (select l_orderkey, min(rn) f from {_LINES} where l_returnflag in ('A', 'R') group by 1) group by 1",
    "q90_exact_sections": """with l as (select doc_id, string_split(text, chr(10))[1] a, string_split(text, chr(10))[-1] b, chr(10) n from documents),
s as (select doc_id, case doc_id % 4
 when 0 then [{'k': 'preamble', 't': 'top' || n || ' ', 's': 0}, {'k': 'findings', 't': a, 's': 15}, {'k': 'impression', 't': b, 's': 29 + length(a)}, {'k': 'history', 't': 'none' || n, 's': 29 + length(a) + length(b) + 19}]
 when 1 then [{'k': 'preamble', 't': n || ' ', 's': 0}, {'k': 'impression', 't': a, 's': 14}, {'k': 'examination', 't': b || ' HISTORY: no header' || n || ' more', 's': 14 + length(a) + 8}]
 when 2 then [{'k': 'preamble', 't': 'top' || n || ' ', 's': 0}, {'k': 'technique', 't': a, 's': 16}, {'k': 'last_paragraph', 't': 'second' || n || ' ' || n || b, 's': 16 + length(a)}]
 else [{'k': 'full report', 't': a, 's': 0}] end e from l),
f as (select doc_id, list_filter(e, lambda x: x.k not in ('findings', 'impression') or regexp_matches(x.t, '[^[:space:]]')) e from s), x as (select doc_id, e, unnest(range(0, len(e))) i from f)
select doc_id, cast(i as int) no, e[i + 1].k as "name", cast(e[i + 1].s as int) as start, md5(e[i + 1].t) digest from x""",
    "q91_group_argmax": f"""with g as (select l_orderkey, cast(floor((rn - 1) / 4) as int) g, rn, l_extendedprice p from {_LINES}), r as (select *, row_number() over (partition by l_orderkey, g order by p desc, rn) r, min(p) over (partition by l_orderkey, g) low from g)
select cast(rn as int) best, count(*) n from r where r = 1 and low >= 20000 group by 1""",
    "q92_frames": """with d as (select user_id, cast(ts as date) d from events), s as (select user_id, unnest(generate_series(min(d), max(d), interval 1 day))::date d from d group by 1), f as (select user_id, d, count(*) n from d group by 1, 2)
select user_id, strftime(s.d, '%Y-%m-%d') "day", coalesce(n, 0) n from s left join f using (user_id, d)""",
    "q93_mask_unions": """with c as (select distinct l_partkey cell, l_returnflag t from lineitem), u as (select cell, t from c where t <> 'A' union select cell, 'AR' from c where t in ('A', 'R'))
select t as target, count(*) n, cast(sum(cell) as bigint) cells from u group by 1""",
    "q94_foreground_stats": """with c as (select c_nationkey, c_acctbal x, avg(c_acctbal) over (partition by c_nationkey) m from customer)
select c_nationkey, round(quantile_cont(x, 0.05), 4) low, round(quantile_cont(x, 0.95), 4) high, round(stddev_pop(x), 4) deviation from c where x > m group by 1""",
    "q95_moving_average": """with v as (select user_id, list(value order by event_id) v from events group by 1)
select user_id, round(list_reduce(v, lambda a, x: a * 0.9::double + x * (1 - 0.9::double)), 5) average from v""",
    "q96_token_labels": """with p as (select p_partkey, (p_partkey % 7 + 3)::int k, p_size s from part)
select p_partkey, concat_ws(',', 1, k, 2, s, 1, 9) ids, concat_ws(',', -100, -100, -100, s, 1, 9) labels,
 case when s = 1 then '0,0,0,1,1,1' when s = 2 then '0,0,0,0,1,1' else '0,0,0,1,2,2' end positions, case when s = 2 then 2 else 1 end kept from p""",
    "q97_weighted_merge": """with s as (select unnest(range(0, 7)) * 8 as st), c as (select st + p_partkey % 16 cell, p_size / 50.0::double p, (16 - abs(p_partkey % 16 - 8))::double w from part, s),
m as (select cell, sum(p * w) / sum(w) m from c group by 1) select cell, round(m, 6) mean, m > 0.5 passes from m""",
    "q99_study_conversations": f"""with d as (select doc_id, quality = 1 v, case when toxic = 0 then length(text) > 0 else false end r, {_U.format('11-modality')} < 0.2 m, {_U.format('11-plane')} < 0.2 p, {_U.format('11-report')} < 0.8 t, {_U.format('11-prompt')} c from documents join labels using (doc_id)),
e as (select *, coalesce(r and not (v and t), false) rep, coalesce(v, false) has_v from d), f as (select *, rep or has_v body from e), g as (select *, m or not body m2 from f)
select doc_id, cast(case when m2 then 1 else 0 end + case when p then 1 else 0 end + case when body then 1 else 0 end as int) n,
 case when m2 then 'What is the modality of the images?' when p then 'What is the plane of the images?' when rep then ['Write a report of the images.', 'Describe the findings.', 'Report on this study.'][cast(floor(c * 3) as int) + 1] else 'Good?' end "first" from g""",
    "q98_tossed_turns": f"select lang, {_U.format(7)} < 0.2 asked, ['a', 'b', 'c'][cast(floor({_U.format(8)} * 3) as int) + 1] as template, count(*) n from documents group by all",
}
