"""The minimum slice: cleaned, labelled document studies by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import load


def q01_min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ten words or more, cut before the first noted sentence, joined to labels, by source and language."""
    docs = load(spark, sf_dir, "documents").where("length(trim(text)) > 0")
    words = F.size(F.expr(r"filter(split(text, '[ \t-\r]+'), t -> t <> '')"))
    sentences = F.split("text", r"\.")
    first = F.expr("array_position(transform(parts, s -> contains(s, 'thth') or contains(s, 'ouen')), true)")
    kept = F.when(F.col("at") == 0, F.col("text")).when(F.col("at") == 1, "").otherwise(F.expr("concat(array_join(slice(parts, 1, int(at - 1)), '.'), '.')"))
    cleaned = docs.where(words >= 10).withColumn("parts", sentences).withColumn("at", first).withColumn("kept", kept)
    labels = load(spark, sf_dir, "labels")
    return (
        cleaned.join(labels, "doc_id")
        .groupBy("source", "lang")
        .agg(F.count("*").alias("n"), F.sum((F.length("kept") > 0).cast("long")).alias("n_kept"), F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("share_good"), F.sum(F.length("kept").cast("long")).alias("kept_chars"))
    )


QUERIES = {"q01_min_slice": q01_min_slice}

ORACLE_SQL = {
    "q01_min_slice": r"""
with d as (select *, string_split(text, '.') parts from documents
           where length(trim(text, ' ')) > 0 and len(list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda t: t <> '')) >= 10),
e as (select *, coalesce(list_position(list_transform(parts, lambda s: contains(s, 'thth') or contains(s, 'ouen')), true), 0) pos from d),
k as (select *, case when pos = 0 then text when pos = 1 then '' else array_to_string(parts[1:pos-1], '.') || '.' end kept from e)
select source, lang, count(*) n, cast(sum(cast(length(kept) > 0 as bigint)) as bigint) n_kept,
       round(avg(case when quality = 1 then 1.0 else 0.0 end), 6) share_good, cast(sum(length(kept)) as bigint) kept_chars
from k join labels using (doc_id) group by source, lang"""
}
