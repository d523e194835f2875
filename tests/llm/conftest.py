import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EDGE = [None, "", "   \n\t ", "a", "One two three four.", "x " * 400, "\n\n\n", "Ünï cödé \U0001f600 ▁ text \\ <s> [INST]", "same words here " * 30, "line one\nline one\nline two\nline one"]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of the smallest table with edge rows, repeated rows, null ids and clashing extra columns."""
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    edge = [(100_000 + i, t, "en", "edge", len(t) if t is not None else None) for i, t in enumerate(EDGE)]
    rows = base + edge + base[:3] + [(None, "a text without an id of its own, ten words or more here", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, trusted string, h string, words string, shard string, k string"
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture()
def sql(docs):
    """Run SQL over the documents fixture and other given frames in DuckDB."""

    def run(query: str, **tables) -> pd.DataFrame:
        con = duckdb.connect()
        for name, df in ({"documents": docs} | tables).items():
            con.register(f"{name}_", df.toPandas() if hasattr(df, "toPandas") else df)
            con.execute(f"create view {name} as select * from {name}_")
        return con.execute(query).fetch_df()

    return run


@pytest.fixture(scope="session")
def table_dir(spark, docs, tmp_path_factory):
    """The fixture's documents written as a table folder, as the queries read it."""
    where = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", F.col("n_chars")).write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return str(where)
