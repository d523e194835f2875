from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from corvane.llm.decontaminate import leaks
from corvane.session import written
from tests.llm.test_dedup import _first_kept


def test_stages_one_after_the_other(spark, table_dir):
    read = spark.read.parquet(f"{table_dir}/documents.parquet")
    docs, seen = read, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, table_dir), name)
        seen.append((name, docs))
    kept = dict(seen)
    for name in ("quality_rules", "quality_classifier", "simhash_dedup", "decontamination"):
        assert kept[name].columns == read.columns
    assert kept["quality_rules"].count() < read.count()
    texts = [(r.doc_id, r.text) for r in kept["simhash_dedup"].collect()]
    assert {d for d, _ in texts} == {d for d, _ in _first_kept([(r.doc_id, r.text) for r in kept["quality_classifier"].collect()])} and len(texts) == len(set(texts))
    assert leaks(kept["decontamination"], spark.read.parquet(f"{table_dir}/benchmark.parquet")).count() == 0
    assert kept["piece_encoding"].count() == kept["decontamination"].count()
    assert kept["piece_encoding"].where(F.size("piece_ids") == 0).count() == 0


def test_empty_and_clashing_tables(spark, table_dir, empty_docs, tmp_path):
    """No documents give no rows; extra columns named like those of the stages change nothing."""
    none, wide = tmp_path / "none", tmp_path / "wide"
    documents = spark.read.parquet(f"{table_dir}/documents.parquet").where("doc_id < 40")
    for name in ("labels", "benchmark"):
        for where in (none, wide):
            spark.read.parquet(f"{table_dir}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    empty_docs.write.parquet(f"{none}/documents.parquet")
    clash = {c: F.lit("clash") for c in ("kept", "key", "node", "pool", "rank", "n", "fp", "h", "words", "doc_key", "score", "llr", "piece_ids")}
    documents.withColumns(clash).write.parquet(f"{wide}/documents.parquet")
    made = corpus_pipeline.run(spark, str(none))
    assert made.collect() == []
    rows = corpus_pipeline.run(spark, str(wide))
    assert rows.columns == made.columns and rows.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
