"""Queries of sources and sinks: tables are written in each form, read back, and what came back is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import nesting as N
from corvane.session import load, new_path, written
from corvane.sources import readers as R
from corvane.sources import writers as W


def q112_json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as one JSON array a split and as JSON lines by split, and read back."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, "train").otherwise("test").alias("split"))
    out = None
    arrays, lines = (new_path(spark, f"json-{k}") for k in ("arrays", "lines"))
    W.json_arrays(p, arrays, "split", ["p_partkey"])
    W.by_split(p, lines, "split")
    for split in ("train", "test"):
        for form, df in (("array", R.json_array(spark, f"{arrays}/split={split}", "p_partkey long, p_name string")), ("lines", R.json_lines(spark, f"{lines}/split={split}", "p_partkey long, p_name string"))):
            part = df.agg(F.lit(form).alias("form"), F.lit(split).alias("split"), F.count("*").alias("n"), F.sum("p_partkey").alias("total"), F.max("p_name").alias("last"))
            out = part if out is None else out.unionByName(part)
    return out


def q113_nan_and_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV with commas and with semicolons, rewritten and joined up; and nations as JSON arrays with bare NaN."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('say "'), "c_name", F.lit('", ; ok')).alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    first, second, third, nans = (new_path(spark, k) for k in ("csv-a", "csv-b", "csv-c", "json-nan"))
    W.table_csv(c.where("c_custkey % 2 = 0"), first)
    c.where("c_custkey % 2 = 1").write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(second)
    schema = "c_custkey long, name string, segment string"
    W.table_csv(R.table_csv(spark, second, schema, ";"), third)
    back = W.results_union([R.table_csv(spark, first, schema, blank=("segment",)), R.table_csv(spark, third, schema, blank=("segment",))])
    rows = back.groupBy("segment").agg(F.count("*").alias("n"), F.sum("c_custkey").cast("double").alias("total"), F.max("name").alias("last"))
    lines = load(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat(F.lit('{"k": '), F.col("n_nationkey").cast("string"), F.lit(', "x": '), F.when(F.col("n_nationkey") % 2 == 0, "NaN").otherwise("1.5"), F.lit("}")).alias("v"))
    lines.agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ","), F.lit("]")).alias("value")).write.text(nans)  # 25 nations, one file
    seen = R.json_array(spark, nans, "k long, x double", nan=True).groupBy(F.isnan("x").alias("nan")).agg(F.count("*").alias("n"), F.sum("k").cast("double").alias("total"))
    return rows.unionByName(seen.select(F.concat(F.lit("nan "), F.col("nan").cast("string")).alias("segment"), "n", "total", F.lit("-").alias("last")))


def q114_piped_and_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pipe-parted lines, and regions as key: value files, a file a region."""
    s, r = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "region")
    pipes, confs = new_path(spark, "pipes"), new_path(spark, "settings")
    s.select(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string"))).alias("value")).write.text(pipes)
    got = R.piped(spark, pipes, {"key": 0, "nation": 2}).groupBy(F.coalesce("nation", F.lit("none")).alias("name")).agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("total"))
    r.select("r_regionkey", F.explode(F.array(F.concat(F.lit("Name: "), "r_name"), F.concat(F.lit("Ratio: 1: "), F.col("r_regionkey").cast("string")), F.lit("no pair"))).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(confs)
    read = R.settings(spark, f"{confs}/*/*.txt")
    return got.unionByName(read.select(F.concat(F.col("settings")["Name"], F.lit("/"), F.col("settings")["Ratio"]).alias("name"), F.size("settings").cast("long").alias("n"), F.lit(0).cast("long").alias("total")))


def q115_tracking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracking ground truth, a folder a type, read back with marks and skipped labels gone; frames of each; result lines."""
    e = load(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("frame"), (F.col("user_id") % 50).alias("id"), F.round("value", 2).alias("x"), (F.col("event_id") % 4 > 0).cast("int").alias("mark"), (F.col("event_id") % 7 + 1).alias("label"))
    root, lines = new_path(spark, "mot"), new_path(spark, "mot-lines")
    for kind in sorted(r[0] for r in e.select("event_type").distinct().collect()):  # a handful of sequences
        e.where(F.col("event_type") == kind).select(F.concat_ws(",", "frame", "id", "x", F.lit("2.0"), F.lit("3.0"), F.lit("4.0"), "mark", "label")).write.text(f"{root}/{kind}/gt")
    truth = written(R.mot_truth(spark, f"{root}/*/gt"), "mot-truth")
    frames = R.frame_ranges(truth).groupBy("seq").agg(F.count("*").alias("frames"), F.min("t_min").alias("t_min"))
    W.mot_lines(truth.select("seq", "frame", (F.col("id") - 1).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")), lines)
    said = spark.read.text(lines).groupBy("seq").agg(F.count("*").alias("lines"), F.sum(F.conv(F.substring(F.md5("value"), 1, 6), 16, 10).cast("long")).alias("digest"))
    return truth.groupBy("seq").agg(F.count("*").alias("n"), F.sum("label").alias("labels")).join(frames, "seq").join(said, "seq")


def q116_report_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as report files in a tree of region and nation, read whole; the file inventory; paths that exist."""
    root = new_path(spark, "reports")
    n = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat("n_name", F.lit("\nsecond line")).alias("value"))
    n.repartition("n_regionkey", "n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").text(root)
    tree = R.report_tree(spark, root).select(F.regexp_replace("group", ".*=", "").cast("long").alias("region"), F.regexp_replace("patient", ".*=", "").cast("long").alias("nation"), "text")
    files = R.inventory(spark, root, "*.txt", "part-", ".txt").select(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).alias("path"), "length")
    wanted = load(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("missing").alias("place"))
    found = N.existing(wanted, "place", files).groupBy(F.col("place").try_cast("long").alias("nation")).agg(F.count("*").alias("suppliers"))
    sizes = files.select(F.col("path").cast("long").alias("nation"), "length")
    return tree.join(sizes, "nation").join(found, "nation", "left").select("region", "nation", F.md5(F.trim(F.regexp_replace("text", r"\n$", ""))).alias("digest"), "length", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def q117_dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered tables joined up with their names; panoptic segments with contiguous ids; ids numbered in order."""
    held = R.Datasets()
    held.register("customers", lambda s: load(s, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), classes=25)
    held.register("suppliers", lambda s: load(s, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), classes=25)
    both = held.together(spark, ["customers", "suppliers"])
    index = R.contiguous(both.where("k % 2 = 1"), "k")
    rows = both.join(index, "k").groupBy("dataset", "index").agg(F.count("*").alias("n"))
    marks = load(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("int").alias("c"), "p_partkey").groupBy("c").agg(F.array_sort(F.collect_set(F.struct(F.col("c").cast("long").alias("id"), (F.col("c") * 10).alias("category_id")))).alias("segments_info"))
    things = R.segments(marks, {0: 0, 10: 1, 20: 2}, [10]).select(F.concat(F.lit("segment "), F.col("segments_info")[0]["isthing"].cast("string")).alias("dataset"), F.col("segments_info")[0]["category_id"].cast("long").alias("index"), F.lit(1).cast("long").alias("n"))
    return rows.unionByName(things)


def q118_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary merged over an older one, as JSON; sheets with their names cut; columns of metrics put into a table."""
    types = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    merged = W.merged_summary(types.withColumn("value", F.col("value") + 1), types.where("metric <> 'purchase'"))
    one = W.summary_json(merged.withColumn("value", F.col("value").cast("long"))).select(F.lit("summary").alias("kind"), F.col("summary").alias("value"))
    sheets = R.sheets(spark, {"a": [{"name": "x", "n": 1}, {"name": None, "n": 2}], "b" * 40: [{"name": "y", "n": 3}]}, "name string, n int")
    names = sheets.select(F.lit("sheet").alias("kind"), F.concat_ws("/", W.sheet_name(F.col("sheet")), "name", F.col("n").cast("string")).alias("value"))
    table = load(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit("old").alias("score"))
    scored = W.with_metrics(table, table.select("r_regionkey", F.concat("r_name", F.lit("!")).alias("score")).where("r_regionkey > 0"), ["r_regionkey"])
    return one.union(names).union(scored.select(F.lit("metric"), F.concat_ws("/", "r_name", F.coalesce("score", F.lit("none")))))


def q119_logs_and_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with ids, a log by day, bad keys written once, and a raw table that stays as first written."""
    asked, log, bad, raw = (new_path(spark, k) for k in ("answers", "log", "bad", "raw"))
    e = load(spark, sf_dir, "events")
    W.answers(e.where("event_type = 'purchase'").select("event_id"), asked)
    W.answers(e.where("event_type <> 'purchase'").select("event_id"), asked)
    seen = R.json_lines(spark, asked, "event_id long, answer_id string")
    out = seen.agg(F.lit("answers").alias("kind"), F.count("*").alias("n"), (F.countDistinct("answer_id") == F.count("*")).cast("string").alias("fact"))
    W.daily_log(e.select("event_id", "ts"), log)
    days = spark.read.schema("event_id long, tstamp double, date string").json(log)
    out = out.union(days.groupBy("date").agg(F.count("*").alias("n"), F.round(F.min("tstamp"), 1).cast("decimal(20,1)").cast("string").alias("fact")).select(F.concat(F.lit("day "), F.col("date").cast("string")), "n", "fact"))
    W.quarantine(e.where("value > 200").select("user_id"), bad, ["user_id"])
    W.quarantine(e.where("value > 150").select("user_id"), bad, ["user_id"])
    keys = spark.read.parquet(bad)
    out = out.union(keys.agg(F.lit("bad"), F.count("*"), (F.countDistinct("user_id") == F.count("*")).cast("string")))
    table = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    W.archived(table, raw)
    kept = W.archived(table.withColumn("n_name", F.lit("cleaned")), raw)
    return out.union(kept.agg(F.lit("archive"), F.count("*"), F.max("n_name")))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

ORACLE_SQL = {
    "q112_json_forms": """with p as (select p_partkey, p_name, case when p_size > 25 then 'train' else 'test' end split from part)
select f as form, split, count(*) n, cast(sum(p_partkey) as bigint) total, max(p_name) as "last" from p, (values ('array'), ('lines')) t(f) group by 1, 2""",
    "q113_nan_and_csv": """select case when c_custkey % 3 > 0 then c_mktsegment else '' end segment, count(*) n, cast(sum(c_custkey) as double) total, max('say "' || c_name || '", ; ok') as "last" from customer group by 1
union all select 'nan ' || (n_nationkey % 2 = 0), count(*), cast(sum(n_nationkey) as double), '-' from nation group by 1""",
    "q114_piped_and_settings": """select case when s_suppkey % 2 = 0 then s_nationkey::varchar else 'none' end as "name", count(*) n, cast(sum(s_suppkey) as bigint) total from supplier group by 1
union all select r_name || '/1: ' || r_regionkey, 2, 0 from region""",
    "q115_tracking_files": """with t as (select event_type seq, event_id frame, user_id % 50 id, round(value, 2) x, event_id % 7 + 1 l from events where event_id % 4 > 0 and event_id % 7 + 1 in (1, 2, 7)),
s as (select seq, case when id >= 1 then printf('%d,%d,%.2f,%.2f,%.2f,%.2f,1,-1,-1,-1', frame, id - 1, x, 2.0::double, 3.0::double, 4.0::double) end line from t)
select seq, count(*) n, cast(sum(l) as bigint) as labels, cast(max(frame) - min(frame) + 1 as bigint) frames, cast(min(frame) as int) t_min,
 (select count(line) from s where s.seq = t.seq) as lines, (select cast(sum(('0x' || substr(md5(line), 1, 6))::bigint) as bigint) from s where s.seq = t.seq) digest from t group by seq""",
    "q116_report_tree": """with s as (select s_nationkey, count(*) n from supplier where s_suppkey % 2 = 0 group by 1)
select n_regionkey region, n_nationkey nation, md5(n_name || chr(10) || 'second line') digest, cast(length(n_name) + 13 as bigint) as length, coalesce(n, 0) suppliers from nation left join s on s_nationkey = n_nationkey""",
    "q117_dataset_registry": """with b as (select 'customers' dataset, c_nationkey k from customer union all select 'suppliers', s_nationkey from supplier), i as (select k, row_number() over (order by k) - 1 i from (select distinct k from b where k % 2 = 1))
select dataset, i as "index", count(*) n from b join i using (k) group by 1, 2
union all select distinct 'segment ' || (p_size % 3 = 1), p_size % 3, 1 from part""",
    "q118_summaries": """with t as (select event_type m, count(*) n from events group by 1)
select 'summary' kind, '{' || string_agg('"' || m || '":' || (case when m = 'purchase' then n + 1 else n end), ',' order by m) || '}' "value" from t
union all select 'sheet', 'a/x/1' union all select 'sheet', repeat('b', 31) || '/y/3'
union all select 'metric', r_name || '/' || case when r_regionkey > 0 then r_name || '!' else 'none' end from region""",
    "q119_logs_and_archives": """select 'answers' kind, count(*) n, 'true' fact from events
union all select 'day ' || strftime(ts, '%Y-%m-%d'), count(*), round(min(epoch(ts)), 1)::decimal(20,1)::varchar from events group by 1
union all select 'bad', count(distinct user_id), 'true' from events where value > 150
union all select 'archive', count(*), max(n_name) from nation""",
}
