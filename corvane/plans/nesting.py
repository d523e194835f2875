"""Queries over nested records, lookups, set operations, labels and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import labels as L
from corvane.operators import nesting as N
from corvane.session import load, spread

ORDER_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``rn``, their place in the order; line numbers alone repeat."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER_KEY)
    lines = load(spark, sf_dir, "lineitem")
    return spread(lines, lines.count(), "l_orderkey").withColumn("rn", F.row_number().over(w))


def q16_group_to_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as one nested list, serialised."""
    turns = N.nested(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn", "role"], "turns")
    return turns.select("conv_id", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["turn"], t["role"])), ",").alias("turns"))


def q17_lookup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's part brands in line order, one lookup an element, null for parts left out."""
    lines = numbered_lines(spark, sf_dir)
    orders = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    table = load(spark, sf_dir, "part").where("p_size > 5")
    found = N.looked_up_in_order(orders, "l_orderkey", "parts", table, "p_partkey", "p_brand", "brands", "-")
    return found.select("l_orderkey", F.array_join("brands", ",").alias("brands"))


def q18_consistency_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order that agree on flag and status, and those that don't, counted."""
    good, bad = N.consistent(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])
    return good.select(F.lit("agree").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("value")).union(bad.select(F.lit("differ"), F.lit("-"))).groupBy("kind", "value").agg(F.count("*").alias("n"))


def q22_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many orders each part brand occurs."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return lines.select("l_orderkey", "p_brand").distinct().groupBy("p_brand").agg(F.count("*").alias("n"))


def q23_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn roles of the labelled documents' conversations in lower case, nulls a group of their own."""
    role = F.when(F.col("role") != "system", F.lower("role"))
    return load(spark, sf_dir, "conversations").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def q24_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by return flag and line status as a table; missing cells are null."""
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


def q25_bool_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose items are all open, and those with any returned."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "O").alias("all_open"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


def q44_label_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition names of every document from three-valued marks and nulls."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    long_text = F.when(F.col("n_chars") > 2000, 1.0).when(F.col("n_chars") > 500, -1.0).otherwise(0.0)
    pos, neg = L.condition_names((F.col("doc_id") % 10 == 0).cast("double"), {"good": F.col("quality"), "toxic": F.col("toxic"), "long": long_text})
    return docs.select("doc_id", F.array_join(pos, ",").alias("pos"), F.array_join(neg, ",").alias("neg"))


def q58_union_except_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys of two priorities: in either, only in the first, in both."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    a, b = (lines.where(F.col("o_orderpriority") == p).select("l_partkey") for p in ("1-URGENT", "5-LOW"))
    sets = {"union": a.unionByName(b).distinct(), "except": a.distinct().subtract(b), "intersect": a.intersect(b)}
    out = None
    for name, rows in sets.items():
        part = rows.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.sum("l_partkey").alias("total"))
        out = part if out is None else out.union(part)
    return out


def q59_modality_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as modalities, grouped by the first group whose substring they hold."""
    groups = ((("ri", "wi"), "mri"), (("ga",), "ct"), (("pe",), "pet"))
    return load(spark, sf_dir, "part").groupBy(L.modality_group(F.col("p_name"), groups).alias("modality")).agg(F.count("*").alias("n"))


def q60_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, last segment and moved form of every page's URL."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    pages = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace(bare, "/+$", "").alias("path"))
    return pages.select("page_id", F.regexp_extract("path", r"^https?://([^/]+)", 1).alias("host"), F.element_at(F.split("path", "/"), -1).alias("last"), L.moved(F.col("path"), "http://", "https://").alias("moved"))


def q61_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON property of events, averaged by type."""
    events = load(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return events.groupBy("event_type").agg(F.count("k").alias("n"), F.sum(F.col("k").cast("long")).alias("total"), F.max("k").alias("top"))


def q63_crowd_filter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes of orders that have an item that isn't returned, all sizes 0 to 50 with zeros."""
    keep = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") != "R").alias("ok")).where("ok")
    parts = load(spark, sf_dir, "part").join(keep.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left_semi").select(F.col("p_size").cast("long").alias("size"))
    return N.histogram(parts, "size", 51)


def q68_strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' segments; every order must have one."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    known = orders.where("c_custkey is not null")
    return N.strict_join(known, load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def q69_longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as dotted keys, each with its longest known suffix."""
    keys = load(spark, sf_dir, "customer").select(F.concat_ws(".", F.lit("model"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("weight")).alias("key")).distinct()
    nations = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat_ws(".", F.col("n_nationkey").cast("string"), F.lit("weight")).alias("suffix"))
    table = nations.union(spark.range(1).select(F.lit("weight").alias("suffix"))).union(spark.range(1).select(F.lit("building.4.weight").alias("suffix")))
    return N.longest_suffix(keys, "key", table, "suffix")


def q70_group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags of each order with their quantity and running offset by first line."""
    lines = numbered_lines(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("long"))
    return N.group_offsets(lines, ["l_orderkey"], "l_returnflag", "rn", "q")


def q71_nested_two_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of each conversation in lists of their own."""
    got = N.nested_by(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn"], {"asked": F.col("role") == "user", "said": F.col("role") == "assistant"})
    flat = lambda c: F.array_join(F.transform(c, lambda t: t["turn"].cast("string")), ",")
    return got.select("conv_id", flat("asked").alias("asked"), flat("said").alias("said"))


def q72_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not labelled yet, by language."""
    return N.pending(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"]).groupBy("lang").agg(F.count("*").alias("n"))


def q73_whole_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers run from 1 without gap, with one status."""
    seen = N.sequence_verdicts(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_linestatus")
    return seen.groupBy(F.when(F.col("whole"), "whole").otherwise("broken").alias("kind")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


def q74_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of nations in a taxonomy of nation, region and world."""
    nations = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    regions = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return N.closure(nations.union(regions))


def q87_case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a file listing, turned into cases of a described dataset: key, image and class count."""
    from corvane.sources.catalog import DATASETS, cases

    name = F.concat(F.lit("labelsTr/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 10, ".nii.gz").otherwise(".txt"))
    rows = cases(load(spark, sf_dir, "part").select(name.alias("path")), DATASETS["MSD/Task03_Liver"])
    return rows.select("key", F.col("images")["_all"].alias("image"), F.size("class_mapping").alias("n_classes"), "complete_anomaly")


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

LINES = "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn from lineitem)"

ORACLE_SQL = {
    "q16_group_to_nested": "select conv_id, cast(count(*) as int) n, string_agg(turn || ':' || role, ',' order by turn, role) turns from conversations group by 1",
    "q17_lookup_ordered": f"select l_orderkey, string_agg(coalesce(p_brand, '-'), ',' order by rn) brands from {LINES} left join (select * from part where p_size > 5) on l_partkey = p_partkey group by 1",
    "q18_consistency_having": """with g as (select l_orderkey, l_suppkey, count(distinct l_returnflag || l_linestatus) d, min(l_returnflag || l_linestatus) v from lineitem group by 1, 2)
select case when d = 1 then 'agree' else 'differ' end kind, case when d = 1 then v else '-' end "value", count(*) n from g group by 1, 2""",
    "q22_doc_frequency": "select p_brand, count(distinct l_orderkey) n from lineitem join part on l_partkey = p_partkey group by 1",
    "q23_null_group": "select case when role <> 'system' then lower(role) end as role, count(*) n from conversations group by 1",
    "q24_pivot": "select l_suppkey, nullif(count(*) filter (l_returnflag = 'A'), 0) a, nullif(count(*) filter (l_returnflag = 'N'), 0) n, nullif(count(*) filter (l_returnflag = 'R'), 0) r from lineitem group by 1",
    "q25_bool_and_or": "select l_orderkey, bool_and(l_linestatus = 'O') all_open, bool_or(l_returnflag = 'R') any_returned from lineitem group by 1",
    "q44_label_ladder": """with d as (select doc_id, doc_id % 10 = 0 clear, [{'n': 'good', 'v': quality::double}, {'n': 'toxic', 'v': toxic::double}, {'n': 'long', 'v': case when n_chars > 2000 then 1.0 when n_chars > 500 then -1.0 else 0.0 end::double}] e
 from documents left join labels using (doc_id))
select doc_id, case when clear then '' else array_to_string(list_transform(list_filter(e, lambda x: coalesce(x.v = 1, false)), lambda x: x.n), ',') end pos,
 case when clear then 'good,toxic,long' else array_to_string(list_transform(list_filter(e, lambda x: not coalesce(x.v in (1, -1), false)), lambda x: x.n), ',') end neg from d""",
    "q58_union_except_intersect": """with a as (select l_partkey k from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'), b as (select l_partkey k from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '5-LOW')
select 'union' kind, count(*) n, cast(sum(k) as bigint) total from (select k from a union select k from b)
union all select 'except', count(*), cast(sum(k) as bigint) from (select k from a except select k from b)
union all select 'intersect', count(*), cast(sum(k) as bigint) from (select k from a intersect select k from b)""",
    "q59_modality_case": "select case when regexp_matches(p_name, 'ri|wi') then 'mri' when contains(p_name, 'ga') then 'ct' when contains(p_name, 'pe') then 'pet' else lower(p_name) end modality, count(*) n from part group by 1",
    "q60_path_parse": r"""with p as (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') path from pages)
select page_id, regexp_extract(path, '^https?://([^/]+)', 1) host, string_split(path, '/')[-1] as "last", regexp_replace(path, '^http://', 'https://') moved from p""",
    "q61_json_props": "select event_type, count(k) n, cast(sum(k) as bigint) total, max(k) top from (select event_type, cast(json_extract_string(props, '$.k') as int) k from events) group by 1",
    "q63_crowd_filter_histogram": """with k as (select l_partkey from lineitem group by 1 having bool_or(l_returnflag <> 'R')), c as (select p_size, count(*) n from part where p_partkey in (select l_partkey from k) group by 1)
select r.s as size, coalesce(n, 0) n from (select unnest(range(0, 51)) s) r left join c on c.p_size = r.s""",
    "q68_strict_lookup": "select c_mktsegment, count(*) n from orders join customer on o_custkey = c_custkey group by 1",
    "q69_longest_suffix": """with k as (select distinct 'model.' || lower(c_mktsegment) || '.' || c_nationkey || '.weight' as key from customer),
s as (select n_nationkey || '.weight' suffix from nation where n_nationkey % 2 = 0 union all select 'weight' union all select 'building.4.weight')
select key, max_by(s.suffix, length(s.suffix)) as suffix from k join s on k.key = s.suffix or suffix(k.key, '.' || s.suffix) group by key""",
    "q70_group_offsets": f"""with g as (select l_orderkey, l_returnflag, min(rn)::int first_at, cast(sum(cast(l_quantity as bigint)) as bigint) size from {LINES} group by 1, 2)
select *, cast(coalesce(sum(size) over (partition by l_orderkey order by first_at rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from g""",
    "q71_nested_two_ways": "select conv_id, coalesce(string_agg(turn, ',' order by turn) filter (role = 'user'), '') asked, coalesce(string_agg(turn, ',' order by turn) filter (role = 'assistant'), '') said from conversations group by 1",
    "q72_pending": "select lang, count(*) n from documents where doc_id not in (select doc_id from labels) group by 1",
    "q73_whole_sequences": """with g as (select l_orderkey k, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) and count(distinct l_linestatus) = 1 ok from lineitem group by 1)
select case when ok then 'whole' else 'broken' end kind, count(*) n, cast(sum(k) as bigint) total from g group by 1""",
    "q87_case_table": """with p as (select replace(p_name, ' ', '_') || '_' || p_partkey as key from part where p_size > 10)
select key, 'imagesTr/' || key || '.nii.gz' image, 2 n_classes, false complete_anomaly from p""",
    "q74_closure": "select 'n' || n_nationkey child, 'r' || n_regionkey ancestor, 1 as depth from nation union all select 'n' || n_nationkey, 'world', 2 from nation union all select 'r' || r_regionkey, 'world', 1 from region",
}
