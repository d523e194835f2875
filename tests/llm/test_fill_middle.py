import hashlib
import re

import duckdb
import pandas as pd
from corvane.llm.fill_middle import fill_in_middle, restored
from corvane.llm.queries import ORACLE_SQL, op11_fill_middle
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, suffix_first=80):
    """The operator's row, from the definition."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def keyed(rows):
    return sorted(map(str, rows))


def test_against_definition(spark, docs):
    more = [(200_000 + i, t) for i, t in enumerate(["a<P>b c", "<S", "x <", "<M> y", "\u0085 nel   nbsp", "tail  ", "  head", "\x1c\x1d words", "\x00 nul \x00", "a<", "P>", "<P", "\U0001f600" * 3 + "   z"] * 5)]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    rows = given.collect()
    for rate, first in ((50, 80), (100, 30)):
        made = fill_in_middle(given, rate=rate, suffix_first=first)
        got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
        assert keyed(tuple(r) for r in got) == keyed(plainly(r.doc_id, r.text, rate, first) for r in rows)
        assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert keyed((r.doc_id, r.text) for r in back) == keyed((r.doc_id, r.text or "") for r in rows)


def test_long_text_and_empty_table(spark, empty_docs):
    long = "naïve words\tin  a line \U0001f40d\n" * 80_000
    rows = [(1, long), (2, "short text"), (3, long + " "), (4, None)]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rate=100).collect()
    assert keyed(tuple(r) for r in got) == keyed(plainly(*r, rate=100) for r in rows)
    assert fill_in_middle(empty_docs).collect() == []


def test_query_and_twin(spark, table_dir):
    got = op11_fill_middle(spark, table_dir).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{table_dir}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op11_fill_middle"]).fetch_df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    value = lambda x: "-" if pd.isna(x) else str(int(x)) if not isinstance(x, str) else x
    text = lambda df: keyed(tuple(map(value, r)) for r in df[cols].itertuples(index=False))
    assert text(got) == text(want)
