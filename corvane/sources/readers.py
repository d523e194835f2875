"""Typed readers: every id stays a string, every schema is given, nothing is inferred in a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.schemas import MOT_TRUTH

# Labels of the tracking ground truth that aren't evaluated.
MOT_SKIPPED = (3, 4, 5, 6, 9, 10, 11)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str, nan: bool = False) -> DataFrame:
    """Files that are one JSON array each; ``nan`` admits bare NaN literals."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", nan).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files of one JSON object a line."""
    return spark.read.schema(schema).json(path)


def table_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, separator: str = ",", blank: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header: all columns strings without a schema; empty cells are null but '' in the columns of ``blank``."""
    reader = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in blank}) if blank else df


def piped(spark: SparkSession, path: str, places: dict[str, int]) -> DataFrame:
    """Lines of ``|``-parted cells without a header; ``places`` gives each column's cell, null where a line is shorter."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).select(*(F.get(parts, at).alias(name) for name, at in places.items()))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``settings``, the ``key: value`` lines of each file as a map."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.contains(x, F.lit(": ")))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("key"), F.trim(F.substring(x, F.instr(x, F.lit(": ")) + 2, F.length(x))).alias("value")))
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.map_from_entries(pairs).alias("settings"))


def mot_truth(spark: SparkSession, path: str) -> DataFrame:
    """Tracking ground truth with its sequence, the second folder above the file; unmarked rows and skipped labels left out."""
    df = spark.read.schema(MOT_TRUTH).csv(path).withColumn("seq", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
    return df.where((F.col("mark") != 0) & ~F.col("label").isin(*MOT_SKIPPED))


def frame_ranges(truth: DataFrame) -> DataFrame:
    """Every frame between a sequence's first and last."""
    spans = truth.groupBy("seq").agg(F.min("frame").alias("t_min"), F.max("frame").alias("t_max"))
    return spans.select("seq", "t_min", "t_max", F.explode(F.sequence("t_min", "t_max")).alias("frame"))


def report_tree(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``group, patient, study, text`` of a tree group/patient/study.txt."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select(F.element_at(parts, -3).alias("group"), F.element_at(parts, -2).alias("patient"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("study"), F.col("value").alias("text"))


def inventory(spark: SparkSession, root: str, pattern: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """``path, key, length`` of the files below ``root`` that match; the key is the name without prefix and suffix. Contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    cut = F.substring(name, F.lit(len(prefix) + 1), F.length(name) - len(prefix) - len(suffix))
    return df.select("path", cut.alias("key"), "length")


def blobs(spark: SparkSession, root: str, pattern: str, decode, schema: T.StructType | str) -> DataFrame:
    """Files decoded in tasks by ``decode`` (bytes to a dict of ``schema``, or None to leave a file out)."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    names = [f.name for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields]

    def run(batches):
        for pdf in batches:
            rows = [{"path": p} | d for p, c in zip(pdf["path"], pdf["content"], strict=True) if (d := decode(bytes(c))) is not None]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def zstd_decode(content: bytes) -> bytes:
    """The content of a zstd-compressed blob."""
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(content)


def sheets(spark: SparkSession, tables: dict[str, list[dict]], schema: T.StructType | str, key: str = "name") -> DataFrame:
    """Small workbook sheets, already parsed, as one table with ``sheet``; rows without a key left out."""
    rows = [{"sheet": s} | r for s, found in tables.items() for r in found if r.get(key) is not None]
    full = T.StructType([T.StructField("sheet", T.StringType()), *(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields])
    return spark.createDataFrame([tuple(r.get(f.name) for f in full.fields) for r in rows], full)


def cells(column: str):
    """A ``; ``-parted cell as an array; empty for null."""
    return F.coalesce(F.split(F.col(column), "; "), F.array().cast("array<string>"))


def segments(annotations: DataFrame, ids: dict[int, int], things: list[int]) -> DataFrame:
    """Panoptic annotations with contiguous category ids and ``isthing``; an unknown id fails."""
    table = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    fixed = lambda s: F.struct(s["id"].alias("id"), table[s["category_id"]].alias("category_id"), s["category_id"].isin(things).alias("isthing"))
    return annotations.withColumn("segments_info", F.transform("segments_info", fixed))


def contiguous(df: DataFrame, ident: str) -> DataFrame:
    """Distinct ids numbered from 0 in order."""
    from corvane.operators.ranking import globally_ranked

    return globally_ranked(df.select(ident).distinct(), [F.col(ident)], "index").withColumn("index", F.col("index") - 1)


class Datasets:
    """A registry of named tables: each name has a loader and the facts that must agree when tables are joined up."""

    def __init__(self) -> None:
        self._held: dict[str, tuple] = {}

    def register(self, name: str, loader, **facts) -> None:
        if name in self._held:
            raise ValueError(f"{name} is registered already")
        self._held[name] = (loader, facts)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return self._held[name][0](spark).withColumn("dataset", F.lit(name))

    def together(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """The named tables as one; fails without names, on an empty table, and where facts differ."""
        if not names:
            raise ValueError("no dataset named")
        facts = [self._held[n][1] for n in names]
        if any(f != facts[0] for f in facts):
            raise ValueError("the datasets' facts differ")
        frames = [self.load(spark, n) for n in names]
        for name, df in zip(names, frames, strict=True):
            if df.isEmpty():
                raise ValueError(f"{name} is empty")
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def views(self, spark: SparkSession) -> None:
        """A temporary view of each table."""
        for name in self._held:
            self.load(spark, name).createOrReplaceTempView(name)
