"""Writers: partitioned tables, merged summaries, quarantine, and formatted result lines.

Publishing is atomic through Spark's commit protocol: readers see a folder's ``_SUCCESS``
or nothing, and a failed task's files never show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_split(df: DataFrame, path: str, split: str = "split", form: str = "json") -> None:
    """A folder for each split."""
    df.write.mode("overwrite").partitionBy(split).format(form).save(path)


def json_arrays(df: DataFrame, path: str, split: str, order: list[str]) -> None:
    """One file for each split that is a single JSON array, a row a line, in order.

    A single file is written by a single task, which streams its rows; use ``by_split``
    where a split is too large for one file.
    """
    w = Window.partitionBy(split).orderBy(*order)
    lines = df.select(split, F.to_json(F.struct(*(c for c in df.columns if c != split))).alias("__json"), F.row_number().over(w).alias("__r"), F.lead(F.lit(1)).over(w).isNull().alias("__last"))
    line = F.concat(F.when(F.col("__r") == 1, "[").otherwise(","), "__json", F.when(F.col("__last"), "]").otherwise(""))
    lines.select(split, line.alias("value")).write.mode("overwrite").partitionBy(split).option("maxRecordsPerFile", 0).text(path)


def with_metrics(table: DataFrame, metrics: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the columns of ``metrics`` put in, those of the same name replaced; write it to a new path."""
    new = [c for c in metrics.columns if c not in key]
    return table.drop(*new).join(metrics, key, "left")


def archived(df: DataFrame, path: str) -> DataFrame:
    """The raw rows as first written to ``path``: later calls leave them as they are."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def results_union(frames: list[DataFrame]) -> DataFrame:
    """Result tables as one, columns by name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def merged_summary(old: DataFrame, new: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Old rows with the new ones put over them."""
    joined = old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full_outer")
    return joined.select(key, F.coalesce("__new", "__old").alias(value))


def summary_json(summary: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A summary as one JSON object; a summary has a row a metric."""
    return summary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("summary"))


def sheet_name(name: Column) -> Column:
    """The last 31 characters of a name."""
    return F.right(name, F.lit(31))


def mot_line(frame: Column, ident: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """``frame,id,x1,y1,w,h,1,-1,-1,-1`` with two decimals; null below id 0."""
    x1, y1, x2, y2 = box
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,1,-1,-1,-1", frame, ident, x1, y1, x2 - x1, y2 - y1)
    return F.when(ident >= 0, line)


def mot_lines(tracks: DataFrame, path: str) -> None:
    """A text folder for each sequence of ``tracks(seq, frame, id, x1, y1, x2, y2)``."""
    line = mot_line(F.col("frame"), F.col("id"), (F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    tracks.select("seq", "frame", "id", line.alias("line")).where(F.col("line").isNotNull()).sort("seq", "frame", "id").select("seq", "line").write.mode("overwrite").partitionBy("seq").text(path)


def answers(df: DataFrame, path: str) -> None:
    """JSON lines with an answer id of their own."""
    df.withColumn("answer_id", F.uuid()).write.mode("append").json(path)


def daily_log(events: DataFrame, path: str, at: str = "ts") -> None:
    """Events appended to a folder for each day, with the epoch to four decimals."""
    epoch = F.round(F.unix_micros(F.col(at).cast("timestamp")) / 1e6, 4)
    events.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "tstamp": epoch}).write.mode("append").partitionBy("date").json(path)


def quarantine(bad: DataFrame, path: str, key: list[str]) -> None:
    """Bad keys appended, those already there left out."""
    spark = bad.sparkSession
    keys = bad.select(*key).distinct()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        keys = keys.join(spark.read.schema(keys.schema).parquet(path), key, "left_anti")
    keys.write.mode("append").parquet(path)
